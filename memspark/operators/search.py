"""Vector search over episodic rows, for batches of queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sizes
from ..functions import score, vector


def visible(agent: Column | str, scope: Column | str | None = None, team: str | None = None, strict_scope: bool = False) -> Column:
    """Who sees a row. By default own rows, and those of scope team and org.

    A scope asked for replaces the check of the agent, so private rows of others show too; strict_scope
    keeps the check. team narrows rows of scope team to that team, if given.
    """
    me = F.lit(agent) if isinstance(agent, str) else agent
    shared = F.col("scope").isin("team", "org")
    if team is not None:
        shared = (F.col("scope") == "org") | ((F.col("scope") == "team") & (F.col("team_id") == team))
    default = (F.col("agent_id") == me) | shared
    if scope is None:
        return default
    asked = F.lit(scope) if isinstance(scope, str) else scope
    only = (F.col("scope") == asked) & (default if strict_scope else F.lit(True))
    return F.when(asked.isNull(), default).otherwise(only)


def candidate_filter(agent: Column | str, scope: Column | str | None = None, min_importance: float = 0.0, start=None, end=None, **more) -> Column:
    """Visibility, importance floor (on the raw importance) and creation time (both ends included)."""
    keep = visible(agent, scope, **more)
    if min_importance > 0:
        keep = keep & (F.col("importance") >= min_importance)
    if start is not None:
        keep = keep & (F.col("created_at") >= F.lit(start))
    if end is not None:
        keep = keep & (F.col("created_at") <= F.lit(end))
    return keep


def nearest(candidates: DataFrame, queries: DataFrame, k: int | Column = 20, extra: Column | None = None) -> DataFrame:
    """Exact: the k candidates nearest to each query (query_id, vec), by cosine distance, then id.

    extra: a condition on query and candidate columns (visibility per query). Rows without a vector, or of
    another dimension than the query, fall away. The stated queries meet all rows, in broadcast blocks;
    ranking keeps k per query in each task before the shuffle.
    """
    ok = vector.dimension_ok(F.col("embedding"), F.size("vec"))
    # lengths once a row, not once a pair
    rows = candidates.withColumn("_n", vector.norm(F.col("embedding")))
    pairs = None
    for asked in sizes.blocks(queries.withColumn("_m", vector.norm(F.col("vec"))), "query_id"):
        met = rows.join(asked, ok if extra is None else ok & extra)
        met = met.withColumn("dist", vector.distance_of(vector.dot(F.col("vec"), F.col("embedding")), F.col("_m") * F.col("_n"))).drop("embedding", "vec", "_n", "_m")
        pairs = met if pairs is None else pairs.unionByName(met)
    order = W.partitionBy("query_id").orderBy("dist", "id")
    return pairs.withColumn("near_rank", F.row_number().over(order)).filter(F.col("near_rank") <= k)


def ranked_by_importance(hits: DataFrame, rank_by: str = "importance") -> DataFrame:
    """Position within the result: by effective importance, as the store returns it, or by similarity."""
    eff = score.effective_importance(F.col("importance"), F.col("decay_score"))
    order = [F.desc("eff"), "dist", "id"] if rank_by == "importance" else ["dist", "id"]
    return hits.withColumn("eff", eff).withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def nearest_approximate(candidates: DataFrame, queries: DataFrame, k: int = 20, bucket_length: float = 0.8, tables: int = 8, extra: Column | None = None) -> DataFrame:
    """By locality-sensitive hashing of unit vectors: the k nearest, exactly ranked, of the rows that share a bucket of any table with the query.

    Rows meet the broadcast queries where they lie, each pair once, whatever the number of tables; vectors are
    not shuffled. extra, a condition on query and candidate columns, holds before the k are chosen.
    """
    as_unit = lambda df, c: df.filter(F.col(c).isNotNull()).withColumn("_u", array_to_vector(vector.unit(F.col(c))))
    asked = as_unit(queries, "vec")
    if asked.isEmpty():
        return nearest(candidates, queries, k, extra)
    # of what it is fitted to, the model takes the dimension only
    model = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=7).fit(asked)
    hashed = lambda df, name: model.transform(df).withColumn(name, F.transform("_h", lambda h: vector_to_array(h)[0])).drop("_u", "_h")
    met = reduce(or_, (F.col("_rows")[i] == F.col("_asked")[i] for i in range(tables)))
    return nearest(hashed(as_unit(candidates, "embedding"), "_rows"), hashed(asked, "_asked"), k, met if extra is None else met & extra).drop("_rows", "_asked")


def choose_strategy(n: int, threshold: int = 5000) -> str:
    return "exact" if n < threshold else "approximate"


def find(candidates: DataFrame, queries: DataFrame, k: int = 20, extra: Column | None = None, threshold: int | None = 5000, strategy: str | None = None) -> DataFrame:
    """The k nearest, exactly below threshold candidates and approximately from there on; without one always exactly. strategy overrides the choice."""
    how = strategy or (choose_strategy(candidates.count(), threshold) if threshold is not None else "exact")
    return nearest(candidates, queries, k, extra) if how == "exact" else nearest_approximate(candidates, queries, k, extra=extra)


def search(episodic: DataFrame, queries: DataFrame, k: int = 20, threshold: int = 5000, strategy: str | None = None, **filters) -> DataFrame:
    """Filter, find, rank by importance."""
    agent = filters.pop("agent", None)
    found = episodic.filter(candidate_filter(agent, **filters)) if agent is not None else episodic
    return ranked_by_importance(find(found, queries, k, None, threshold, strategy))
