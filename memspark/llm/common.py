"""What the text operators share: shared-folder tables, id checks, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: A word: a run of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. One is made up only where the session names none (local tests)."""
    try:
        found = spark.conf.get(CHECKPOINT_KEY)
    except Exception:
        found = None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found


#: Folders written since each open scratch began; the innermost is last.
_scratch: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/memspark/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised inside is deleted at the end: for work whose result is written before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: extra columns, whatever they are called, fall away here."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in columns.items()))


#: Bytes of row keys that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Keys that hold more than this share of the rows are met by broadcast: there are at most as many of them as its inverse.
HOT_SHARE = 1e-4


#: Bytes of an Arrow batch: texts lie in several copies in a task and its worker, so a batch is to be small.
ARROW_KEY, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def in_workers(df: DataFrame, run, layout: str) -> DataFrame:
    """df.mapInArrow(run, layout), in batches of ARROW_BYTES at most. The session's setting is lowered where it allows more."""
    spark = df.sparkSession
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if as_bytes(spark.conf.get(ARROW_KEY)) > ARROW_BYTES:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    return df.mapInArrow(run, layout)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of df are of a size to be broadcast; strings and binaries are measured, not assumed."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    fixed = 16 + 16 * len(df.columns)
    return (df.agg(F.sum(sum(wide, F.lit(fixed)))).first()[0] or 0) <= limit


def join_spread(rows: DataFrame, info: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with info (one row for each of the keys; weight: how many of the rows have them), without a task for a hot key.

    Keys with more than HOT_SHARE of the rows are few, so their info is broadcast; the others are shuffled.
    """
    total = info.agg(F.sum(weight)).first()[0] or 0
    hot = info.filter(F.col(weight) > max(1.0, total * HOT_SHARE))
    cold = info.filter(F.col(weight) <= max(1.0, total * HOT_SHARE))
    if hot.isEmpty():
        return rows.join(info, keys, how)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rows.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def text_hash(column: str = "text"):
    """The hash that tells rows of one id apart; null is as the empty text."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def by_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with their hash h, joined by how with keys (id, h and others): equal are the id, null being one too, and the text. Broadcast where the keys' checked size allows, so that no text is shuffled."""
    small = F.broadcast(keys) if keys.count() * 24 <= BROADCAST_BYTES else keys
    d, k = docs.withColumn("h", text_hash()).alias("d"), small.alias("k")
    return d.join(k, F.col("d.doc_id").eqNullSafe(F.col("k.id")) & (F.col("d.h") == F.col("k.h")), how)


def one_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of docs for each of the distinct (id, h, copies) in kept; rows that copy another are merged, the others not shuffled."""
    kept, names = materialise(kept, "kept"), docs.columns
    rows = by_rows(docs, kept, "inner").select(*(f"d.{c}" for c in names), "k.h", "k.copies")
    if kept.filter("copies > 1").isEmpty():
        return rows.select(*names)
    least = F.min(F.struct(*(c for c in names if c != "doc_id"))).alias("x")
    merged = rows.filter("copies > 1").groupBy("doc_id", "h").agg(least).select("doc_id", "x.*").select(*names)
    return rows.filter("copies = 1").select(*names).unionByName(merged)


def crc_bucket(id_col, mod: int):
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]
