"""Measures of retrieval quality over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sizes
from ..functions import text


def keyword_score(context: Column, expected: Column) -> Column:
    """Share of the expected keywords that the context holds, in either case; 0 without any."""
    return _share(F.lower(context), F.transform(expected, F.lower))


def _share(low: Column, expected: Column) -> Column:
    """The same of texts and keywords in lower case."""
    hits = F.size(F.filter(expected, lambda k: F.contains(low, k)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(F.lit(0.0))


def keyword_scores(docs: DataFrame, items: DataFrame, block_bytes: int = sizes.BROADCAST_BYTES) -> DataFrame:
    """(item_id, doc_id, score) of every item (item_id, expected) and every document (doc_id, text).

    The items are the stated query set: they go to the documents in broadcast blocks of block_bytes or
    about that, dealt by hash, and each block meets all documents in one pass.
    """
    low = docs.select("doc_id", F.lower("text").alias("_low"))
    items = items.select("item_id", F.transform("expected", F.lower).alias("_expected"))
    return sizes.join_blocks(low, items, None, "item_id", block_bytes).select("item_id", "doc_id", _share(F.col("_low"), F.col("_expected")).alias("score"))


def cleaned(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(answer), r"(?U)[^\w\s]", ""))


def exact_match(answer: Column, expected: Column) -> Column:
    return (cleaned(answer) == cleaned(expected)).cast("double")


def token_overlap(answer: Column, expected: Column) -> Column:
    """Share of the expected distinct words that the answer holds."""
    words = lambda c: F.array_distinct(text.white_split(F.lower(c)))
    n = F.size(words(expected))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words(expected), words(answer))) / n)


def density(quality: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, quality / tokens).otherwise(F.lit(0.0))


def distance_score(distance: Column) -> Column:
    """A distance of a vector store as a score."""
    return 1 / (1 + distance)


def averages(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """Means and medians by category and over all."""
    return df.rollup(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"avg_{c}") for c in columns), *(F.median(c).alias(f"median_{c}") for c in columns)).withColumn(by, F.coalesce(by, F.lit("overall")))


def best_by_overlap(questions: DataFrame, memories: DataFrame, floor: float = 0.1) -> DataFrame:
    """(query_id, id, overlap): the memory that shares most words with each question, found through shared words."""
    words = lambda c: F.array_distinct(text.white_split(F.lower(c)))
    q = questions.select("query_id", words(F.col("query")).alias("w")).select("query_id", F.size("w").alias("n"), F.explode("w").alias("word"))
    m = memories.select("id", F.explode(words(F.col("content"))).alias("word"))
    shared = q.join(m, "word").groupBy("query_id", "id").agg((F.count("*") / F.first("n")).alias("overlap")).filter(F.col("overlap") >= floor)
    return shared.groupBy("query_id").agg(F.max_by(F.struct("id", "overlap"), F.struct("overlap", -F.col("id"))).alias("x")).select("query_id", "x.id", "x.overlap")


def rates(checks: DataFrame) -> DataFrame:
    """(kind, n, ok, rate) of boolean checks by kind."""
    return checks.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), (F.count_if("ok") / F.count("*")).alias("rate"))
