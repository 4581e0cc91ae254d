"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the
next. All but the last return the columns of documents. What a stage drops is gone; a text that a stage
cuts is passed on cut, with its new n_chars. What a stage wrote besides its result is deleted after it.

Defined cases, for all stages: a null text has no letter, so the first stage drops it, as it does the empty
one. Very long texts are treated whole. Decisions are by row: rows of one id, a null id too, are told apart by
their texts, and of equal rows one stays. Null lang, source and n_chars are passed on. Extra columns fall
away. No rows, or no benchmark items, give no rows, or no drops.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import byte_bpe, decontaminate, language_id, near_dups, repeats
from memspark.llm.common import by_rows, materialise, one_each, remove, scratch, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of a passage that must not stand twice. The shortest repeated run of over 50 words of prose has 259 bytes in
#: 10,000 documents (shorter ones repeat a single word); at 400 bytes 43 % of such runs would pass.
PASSAGE_BYTES = 250
#: Words folded beforehand: fewer than by default, for executors that have served other stages.
DICTIONARY = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, and those no language takes with at least half of the probability."""
    rated = language_id.identify(docs, PIECES, keep=("text", "lang", "source", "n_chars"))
    return rated.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: one with the smallest id; of ties, the one with the smallest text hash."""
    return one_each(docs.select(*COLUMNS), near_dups.kept_rows(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages (strings of PASSAGE_BYTES) that stand elsewhere too; a text with nothing left goes.

    No copy of such a passage stays, the first neither: what many documents share is boilerplate, and whole
    copies of documents have gone in the stage before. A character cut in two falls away.
    """
    cut = repeats.remove_repeats(docs, length=PASSAGE_BYTES, keep=("lang", "source", "n_chars", "text"), with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes"))).select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; equal rows share their fate."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    leaks = materialise(found.filter("contaminated").select(F.col("doc_id").alias("id"), "h").distinct(), "leaks")
    return by_rows(docs, leaks, "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document: token count, and digests of the ids and of the decoded bytes; of an empty text those of no bytes."""
    return byte_bpe.encode(docs, RANKS, dictionary=DICTIONARY)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("token_ids", token_ids)]
#: Segmentations and merges are not SQL; the tests hold run() against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark).rstrip('/')}/memspark/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
