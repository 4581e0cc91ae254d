"""Filling a token budget, for every query at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def fill(df: DataFrame, budget: Column | int, order: list, by: str | list[str] = "query_id", content: str = "content", count=text.count_tokens, cut=text.truncate_to_budget) -> DataFrame:
    """Take rows in order while they fit; cut the first that does not to what is left, and stop there.

    Adds tokens (of the text as packed), packed (the text) and before (tokens taken so far). count(text) and
    cut(text, budget) may be a tokenizer's own, see plug.token_counter and plug.token_cutter.
    """
    b = F.lit(budget) if isinstance(budget, int) else budget
    w = W.partitionBy(by).orderBy(*order)
    whole = df.withColumn("tokens", count(F.col(content)))
    run = whole.withColumn("before", F.coalesce(F.sum("tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = run.filter((F.col("before") < b) | (F.col("before") + F.col("tokens") <= b))
    packed = F.when(F.col("before") + F.col("tokens") > b, cut(F.col(content), b - F.col("before"))).otherwise(F.col(content))
    return kept.withColumn("packed", packed).withColumn("tokens", count(F.col("packed")))


def fill_skipping(df: DataFrame, budget: Column | int, order: list[str | Column], by: str = "query_id", content: str = "content", count=text.count_tokens) -> DataFrame:
    """Walk rows in order and take each that still fits, skipping those that do not. (by, taken: array of content, used).

    A fold over the rows of a key in one array: for the bounded lists a context tier is packed from.
    """
    b = F.lit(budget) if isinstance(budget, int) else budget
    item = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], F.col(content).alias("content"), count(F.col(content)).alias("tokens"))
    rows = df.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("rows"), F.first(b).alias("budget"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("taken"))
    step = lambda a, x: F.when(a.used + x.tokens <= F.col("budget"), F.struct((a.used + x.tokens).alias("used"), F.concat(a.taken, F.array(x.content)).alias("taken"))).otherwise(a)
    return rows.select(by, F.aggregate("rows", zero, step).alias("x")).select(by, "x.taken", "x.used")
