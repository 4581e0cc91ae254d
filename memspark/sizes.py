"""Measured sizes: what may be broadcast, and blocks of stated rows that may."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that may be broadcast at once.
BROADCAST_BYTES = 16 << 20


def size_of(df: DataFrame) -> int:
    """Bytes of the rows, about: strings and arrays are measured, the rest counts 16 a column."""
    wide = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            wide.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind == "array<string>":
            wide.append(F.coalesce(F.octet_length(F.array_join(c, "")) + F.size(c) * 16, F.lit(0)))
        elif kind.startswith("array"):
            wide.append(F.greatest(F.size(c), F.lit(0)) * 16)
    return df.agg(F.sum(sum(wide, F.lit(16 + 16 * len(df.columns))).cast("bigint"))).first()[0] or 0


def blocks(df: DataFrame, key: str, block_bytes: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The rows in blocks to be broadcast, dealt by a hash of key; one where they are few."""
    n = max(1, math.ceil(size_of(df) / block_bytes))
    return [F.broadcast(df if n == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def join_blocks(rows: DataFrame, stated: DataFrame, on, key: str = "query_id", block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with stated rows under a condition that is no equality, a broadcast block after another."""
    out = None
    for block in blocks(stated, key, block_bytes):
        part = rows.join(block, on) if on is not None else rows.crossJoin(block)
        out = part if out is None else out.unionByName(part)
    return out


def few(df: DataFrame, stated: DataFrame, k: int, row_bytes: int = 256) -> DataFrame:
    """A frame of at most k rows, of few columns, for each stated row: to be broadcast, if that is little."""
    return F.broadcast(df) if stated.count() * k * row_bytes <= BROADCAST_BYTES else df
