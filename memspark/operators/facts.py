"""Temporal facts and the graph they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def is_open() -> Column:
    return F.col("valid_until").isNull()


def is_valid_at(ts: Column) -> Column:
    return (F.col("valid_from") <= ts) & (F.col("valid_until").isNull() | (ts <= F.col("valid_until")))


def supersede(writes: DataFrame) -> DataFrame:
    """Close each fact at the time of the next write of the same subject and predicate with another object.

    Writes carry write_seq and written_at; that order alone decides, across agents. Repeats of an object
    stay open beside each other. A fact that comes closed stays as it came, and closes others all the same.
    Adds superseded to the metadata (JSON) of closed facts.
    """
    w = W.partitionBy("subject", "predicate").orderBy("write_seq")
    changed = F.coalesce((F.col("object") != F.lag("object").over(w)).cast("int"), F.lit(0))
    islands = writes.withColumn("_changed", changed).withColumn("_island", F.sum("_changed").over(w))
    later = W.partitionBy("subject", "predicate").orderBy("_island").rangeBetween(1, 1)
    closing = F.min("written_at").over(later)
    ended = islands.withColumn("_closed", closing)
    flag = F.when(F.col("valid_until").isNull() & F.col("_closed").isNotNull(), merge_flag(F.col("metadata"), "superseded")).otherwise(F.col("metadata")) if "metadata" in writes.columns else None
    out = ended.withColumn("metadata", flag) if flag is not None else ended
    return out.withColumn("valid_until", F.coalesce("valid_until", "_closed")).drop("_changed", "_island", "_closed")


def merge_flag(metadata: Column, name: str) -> Column:
    """JSON metadata (an object, or null) with a key set to true: in its place where it has it, in front where not."""
    text_ = F.trim(F.coalesce(metadata, F.lit("{}")))
    rest = F.regexp_replace(text_, r"^\{\s*", "")
    added = F.when(rest == "}", F.lit(f'{{"{name}":true}}')).otherwise(F.concat(F.lit(f'{{"{name}":true,'), rest))
    keys = F.json_object_keys(text_)
    kept = F.map_filter(F.from_json(text_, "map<string,string>"), lambda k, _: k != name)
    flat = F.to_json(F.map_concat(kept, F.create_map(F.lit(name), F.lit("true"))))
    return F.when(F.array_contains(keys, name), F.when(F.get_json_object(text_, f"$.{name}") == "true", text_).otherwise(flat)).otherwise(added)


def subject_scan(triples: DataFrame, subject: str, open_only: bool = True, agent: str | None = None) -> DataFrame:
    keep = F.col("subject") == subject
    keep = keep & is_open() if open_only else keep
    return triples.filter(keep & (F.col("agent_id") == agent) if agent is not None else keep)


def search_text(triples: DataFrame, query: Column | str) -> DataFrame:
    """Open facts that hold the whole query in subject, predicate or object."""
    q = F.lit(query) if isinstance(query, str) else query
    return triples.filter(is_open() & text.like_everywhere(q, F.col("subject"), F.col("predicate"), F.col("object")))


def edges(triples: DataFrame) -> DataFrame:
    """The graph: one edge for each open fact."""
    return triples.filter(is_open())


def entities(triples: DataFrame) -> DataFrame:
    e = edges(triples)
    return e.select(F.col("subject").alias("entity")).union(e.select("object")).distinct()


def neighbours(triples: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """(entity, neighbours: sorted, distinct) by edges in either direction; of the entities in some, if given."""
    e = edges(triples)
    both = e.select(F.col("subject").alias("entity"), F.col("object").alias("other")).union(e.select("object", "subject"))
    both = both.join(some.select("entity").distinct(), "entity", "left_semi") if some is not None else both
    return both.groupBy("entity").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def graph_size(triples: DataFrame) -> DataFrame:
    return edges(triples).agg(F.count("*").alias("n_edges")).join(entities(triples).agg(F.count("*").alias("n_nodes")))


def reach(triples: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, entity, dist) within depth hops in either direction, the start at 0.

    A join of the frontier with the edges per hop; entities already reached are left out, so walks do not
    multiply. The edges and each frontier are kept while the hops go on, not worked out again. A start that
    no edge touches reaches nothing.
    """
    e = edges(triples)
    both = e.select(F.col("subject").alias("u"), F.col("object").alias("v")).union(e.select("object", "subject")).distinct().persist()
    frontier = starts.select(F.col("entity").alias("start")).distinct().join(both.select(F.col("u").alias("start")).distinct(), "start", "left_semi").select("start", F.col("start").alias("entity"), F.lit(0).alias("dist")).persist()
    seen = frontier
    for hop in range(1, depth + 1):
        step = frontier.join(both, F.col("entity") == F.col("u")).select("start", F.col("v").alias("entity")).distinct()
        frontier = step.join(seen, ["start", "entity"], "left_anti").withColumn("dist", F.lit(hop)).persist()
        seen = seen.unionByName(frontier)
    return seen


def traverse(triples: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """(start, facts) whose nearer end is less than depth hops from the start; each fact once. Depth 0: none."""
    if depth <= 0:
        return edges(triples).select(F.col("subject").alias("start"), "*").limit(0)
    inner = reach(triples, starts, depth - 1).select("start", "entity")
    e = edges(triples)
    near = e.join(inner, e["subject"] == inner["entity"]).select("start", e["id"]).union(e.join(inner, e["object"] == inner["entity"]).select("start", e["id"])).distinct()
    return near.join(e, "id").select("start", *e.columns)


def own_or_any(triples: DataFrame, agent: Column | str) -> DataFrame:
    """Per subject the agent's own open facts, or everybody's where it has none."""
    me = F.lit(agent) if isinstance(agent, str) else agent
    own = (F.col("agent_id") == me).cast("int")
    return edges(triples).withColumn("_own", own).withColumn("_any", F.max("_own").over(W.partitionBy("subject"))).filter(F.col("_own") == F.col("_any")).drop("_own", "_any")
