"""Procedures: look-up by context or name, ranking, success statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import sizes
from ..functions import score, text


def by_context(procedures: DataFrame, query: Column | str, min_success: float = 0.0, agent: str | None = None) -> DataFrame:
    """Whole query in name, description or the contexts (as JSON); best and most used first."""
    q = F.lit(query) if isinstance(query, str) else query
    hit = text.like_everywhere(q, F.col("name"), F.col("description"), F.to_json("applicable_contexts")) & (F.col("success_rate") >= min_success)
    hit = hit & (F.col("agent_id") == agent) if agent is not None else hit
    return procedures.filter(hit).orderBy(F.desc("success_rate"), F.desc("execution_count"), "id")


def by_name(procedures: DataFrame, name: str) -> DataFrame:
    return procedures.filter(text.like_everywhere(F.lit(name), F.col("name"))).orderBy(F.desc("success_rate"), F.desc("execution_count"), "id")


def listing(procedures: DataFrame, agent: str | None = None, limit: int = 50) -> DataFrame:
    rows = procedures.filter(F.col("agent_id") == agent) if agent is not None else procedures
    return rows.orderBy(F.desc("created_at"), "id").limit(limit)


def ranked(procedures: DataFrame, queries: DataFrame, min_success: float = 0.0, query_col: str = "query", agent_col: str | None = None) -> DataFrame:
    """Queries' keywords against procedures: (query_id, id, matches, first_hit, success_rate, execution_count, pos).

    A query without a keyword is looked up whole. Ranked by keywords matched, success, the first keyword
    that hit, uses. The stated queries (a bounded batch) meet all procedures.
    """
    from pyspark.sql import Window as W

    kw = text.keywords(F.col(query_col))
    terms = queries.select("query_id", *([F.col(agent_col).alias("_agent")] if agent_col else []), F.posexplode(F.when(F.size(kw) > 0, kw).otherwise(F.array(query_col))).alias("kw_pos", "kw"))
    # equal keywords of an agent are looked up once
    asked = terms.select(*(["_agent"] if agent_col else []), "kw").distinct()
    hit = (F.col("success_rate") >= min_success) & text.like_everywhere(F.col("kw"), F.col("name"), F.col("description"), F.to_json("applicable_contexts"))
    rows = procedures.select("id", "name", "description", "applicable_contexts", *(["agent_id"] if agent_col else []), "success_rate", "execution_count")
    thin = ["id", "success_rate", "execution_count", *asked.columns]
    if agent_col:
        # an agent's procedures meet its own terms only
        own = sizes.join_blocks(rows, asked.filter(F.col("_agent").isNotNull()), (F.col("agent_id") == F.col("_agent")) & hit, key="kw").select(*thin)
        pairs = own.unionByName(sizes.join_blocks(rows, asked.filter(F.col("_agent").isNull()), hit, key="kw").select(*thin))
    else:
        pairs = sizes.join_blocks(rows, asked, hit, key="kw").select(*thin)
    again = terms.withColumnRenamed("kw", "_kw")
    same = F.col("kw") == F.col("_kw")
    if agent_col:
        again = again.withColumnRenamed("_agent", "_of")
        same = same & F.col("_agent").eqNullSafe(F.col("_of"))
    pairs = sizes.join_blocks(pairs, again, same)
    found = pairs.groupBy("query_id", "id").agg(F.count("*").alias("matches"), F.min("kw_pos").alias("first_hit"), F.first("success_rate").alias("success_rate"), F.first("execution_count").alias("execution_count"))
    order = W.partitionBy("query_id").orderBy(F.desc("matches"), F.desc("success_rate"), "first_hit", F.desc("execution_count"), "id")
    return found.withColumn("pos", F.row_number().over(order))


def best(procedures: DataFrame, queries: DataFrame, most: int = 1, **more) -> DataFrame:
    return ranked(procedures, queries, **more).filter(F.col("pos") <= most)


def record_executions(base: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, success_rate, execution_count) after all outcomes (id, seq, success), in the order of seq.

    The moving average in closed form: 0.7^n r + sum of 0.3 * 0.7^(n-i) o_i. The position of an outcome
    comes from a window over its procedure; sums are partial before the shuffle.
    """
    from pyspark.sql import Window as W

    keep = 1 - score.EMA_RATE
    back = F.row_number().over(W.partitionBy("id").orderBy(F.desc("seq"))) - 1
    folded = outcomes.withColumn("_b", back).groupBy("id").agg(F.sum(F.lit(score.EMA_RATE) * F.pow(F.lit(keep), F.col("_b")) * F.col("success").cast("double")).alias("_s"), F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    rate = F.pow(F.lit(keep), n) * F.col("success_rate") + F.coalesce("_s", F.lit(0.0))
    return base.join(folded, "id", "left").select("id", rate.alias("success_rate"), (F.col("execution_count") + n).alias("execution_count"))
