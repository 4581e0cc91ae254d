"""Shards of near equal bytes, by sampled splitters.

Records are ordered by (hash of the text, hash of the id). A sample of keys, drawn with chances in
proportion to record sizes, gives the quantiles that cut this order into many ranges of about equal
bytes; equal texts are neighbours in it, and a text with very many copies is cut by the ids' hashes. A range
with too many rows (many tiny records) is subdivided once more. Sizes and counts of the ranges are
summed, so each record's exact place in the whole order follows inside its own range; the shard is the
share of the bytes before it. A shard's bytes are off its even share by less than the largest record at either
end, so two shards differ by less than twice that; its ends may fall inside a group of equal texts. Slots
number a shard's records in order.

Defined cases: a null text has size 1 and the checksum of no bytes. A text of any length is one record, so a
longer one than an even share makes its shard so large, and others may be left empty. Repeated rows are placed
each; rows equal in id and text have one place in the order, so all of them are numbered by one task. A null id
is ordered like any other. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, picked

#: Ranges at most; their splitters and sums are what the driver holds.
MOST_RANGES = 4096


def _before(splitters: list[tuple[int, int]], key, tie):
    """How many splitters are not after (key, tie): looked up among every 64th, then among the 64 that follow."""
    as_rows = lambda rows: F.from_json(F.lit("[" + ",".join(f'{{"k":{k},"t":{t}}}' for k, t in rows) + "]"), "array<struct<k:bigint,t:bigint>>")
    count = lambda rows: F.size(F.filter(rows, lambda s: (s.k < key) | ((s.k == key) & (s.t <= tie))))
    if len(splitters) <= 64:
        return count(as_rows(splitters)) if splitters else F.lit(0)
    coarse = count(as_rows(splitters[63::64]))
    return coarse * 64 + count(F.slice(as_rows(splitters), coarse * 64 + 1, F.lit(64)))


def shard_by_bytes(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4000, sample_per_range: int = 64) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``."""
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    own = picked(df, id=id_col, text=text_col).select("id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("k"))
    own = materialise(own.withColumn("t", F.xxhash64("id", "k")), "sizes")  # the texts are read once
    sums = own.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    total, n = sums["bytes"] or 0, sums["n"]
    ranges = max(shards * 8, min(MOST_RANGES, math.ceil(n / rows_per_range)))
    # size-weighted sample: whole shares always, the fraction by a hash of the key
    share = F.col("size") * F.lit(ranges * sample_per_range / max(1, total))
    luck = F.shiftrightunsigned(F.xxhash64("t", F.lit(17)), 11) / F.lit(float(1 << 53))
    times = F.floor(share).cast("int") + (luck < share - F.floor(share)).cast("int")
    sample = sorted(tuple(r) for r in own.filter(times > 0).select("k", "t", F.explode(F.sequence(F.lit(1), times)).alias("i")).select("k", "t").collect())  # ranges * sample_per_range expected
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    placed = own.withColumn("range", _before(splitters, F.col("k"), F.col("t")))
    # ranges overfull in rows are cut again, by the ids' hashes
    rows = {r["range"]: r["n"] for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect()}
    fair = max(1, math.ceil(n / ranges))
    parts = [(k, math.ceil(v / fair)) for k, v in rows.items() if v > 2 * fair]
    cut = spark.createDataFrame(parts, "range int, parts int")
    placed = placed.join(F.broadcast(cut), "range", "left").withColumn("part", F.coalesce(F.pmod(F.shiftright("t", 20), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    cells = sorted((r["range"], r["part"], r["n"], r["b"]) for r in placed.groupBy("range", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())  # twice the ranges at most
    at, first_row, first_byte = [], 0, 0
    for r, p, c, b in cells:
        at.append((r, p, first_row, first_byte))
        first_row, first_byte = first_row + c, first_byte + b
    offsets = spark.createDataFrame(at, "range int, part int, row0 bigint, byte0 bigint")
    order = W.partitionBy("range", "part").orderBy("k", "t", "id", "size", "crc")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = placed.withColumn("r", F.row_number().over(order)).withColumn("b", F.sum("size").over(running) - F.col("size")).join(F.broadcast(offsets), ["range", "part"])
    # whole-number arithmetic: the product stays below 2**63 up to an exabyte at 8 shards
    shard = F.least(F.expr(f"(byte0 + b) * {shards} div {max(1, total)}"), F.lit(shards - 1)).cast("int")
    ranked = materialise(ranked.select("id", "size", "crc", shard.alias("shard"), (F.col("row0") + F.col("r") - 1).alias("rank")), "ranked")
    first = ranked.groupBy("shard").agg(F.min("rank").alias("rank0"))
    return ranked.join(F.broadcast(first), "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("rank0")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
