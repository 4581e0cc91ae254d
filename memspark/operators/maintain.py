"""Maintenance: decay and eviction, consolidation, and the views derived from the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import score, text
from . import facts


def decay_pass(episodic: DataFrame, now, half_life: float = 168.0, threshold: float = 0.05, agent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(surviving rows with fresh decay scores, ids to evict), in one projection each. Other agents' rows stay as they are."""
    fresh = score.decay(score.hours_between(F.col("accessed_at"), F.lit(now).cast("timestamp")), half_life)
    mine = F.lit(True) if agent is None else F.col("agent_id") == agent
    scored = episodic.withColumn("decay_score", F.when(mine, fresh).otherwise(F.col("decay_score")))
    gone = mine & (F.col("decay_score") < threshold)
    return scored.filter(~F.coalesce(gone, F.lit(False))), scored.filter(gone).select("id")


def decay_changes(episodic: DataFrame, now, half_life: float = 168.0, threshold: float = 0.05, agent: str | None = None) -> DataFrame:
    """Only the surviving rows whose decay score changes, and only the agent's, with the fresh score."""
    mine = episodic if agent is None else episodic.filter(F.col("agent_id") == agent)
    fresh = score.decay(score.hours_between(F.col("accessed_at"), F.lit(now).cast("timestamp")), half_life)
    rows = mine.withColumn("_fresh", fresh).filter((F.col("_fresh") >= threshold) & ~F.col("_fresh").eqNullSafe(F.col("decay_score")))
    return rows.withColumn("decay_score", F.col("_fresh")).drop("_fresh")


def due_for_consolidation(episodic: DataFrame, least: int = 10) -> DataFrame:
    return episodic.groupBy("agent_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def extract_statements(episodic: DataFrame) -> DataFrame:
    """(agent_id, id, subject, predicate, object) of every sentence with a statement, as written."""
    per = episodic.select("agent_id", "id", F.explode(text.sentences(F.col("content"))).alias("s")).select("agent_id", "id", text.statement(F.col("s")).alias("t"))
    return per.filter(F.col("t").isNotNull()).select("agent_id", "id", "t.subject", "t.predicate", "t.object")


def recurring_statements(episodic: DataFrame, max_episodes: int | None = 100, least: int = 2, extract=extract_statements) -> DataFrame:
    """(agent_id, subject, predicate, object, n, confidence, source_episodes) of statements made at least twice.

    max_episodes: the newest of an agent that a pass reads; None reads all. extract may be replaced, by an
    extractor of the caller's.
    """
    rows = episodic
    if max_episodes is not None:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("agent_id").orderBy(F.desc("created_at"), "id"))).filter(F.col("_r") <= max_episodes).drop("_r")
    total = rows.groupBy("agent_id").agg(F.count("*").alias("episodes"))
    s = extract(rows).select("agent_id", "id", text.trimmed(F.lower("subject")).alias("subject"), "predicate", text.trimmed(F.lower("object")).alias("object"))
    n = s.groupBy("agent_id", "subject", "predicate", "object").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("id")).alias("source_episodes")).filter(F.col("n") >= least)
    return n.join(total, "agent_id").select("agent_id", "subject", "predicate", "object", "n", score.consolidation_confidence(F.col("n"), F.col("episodes")).alias("confidence"), "source_episodes")


def new_facts(recurring: DataFrame, triples: DataFrame) -> DataFrame:
    """Recurring statements that no open fact of the agent already says."""
    known = facts.edges(triples).select("agent_id", "subject", "predicate", F.lower("object").alias("object"))
    return recurring.join(known, ["agent_id", "subject", "predicate", "object"], "left_anti")


def latest(log: DataFrame, store: str | None = None) -> DataFrame:
    """The last entry of every id; ids whose last entry is a delete are gone. One aggregate, no sort of the log."""
    rows = log.filter(F.col("store") == store) if store is not None else log
    key = ["id"] if store is not None else ["store", "id"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), "seq").alias("_x")).select(*key, "_x.*")
    return last.filter(F.col("op") != "delete")


def replay(log: DataFrame, store: str, layout: str) -> DataFrame:
    """The current table of a store, from its log."""
    return latest(log, store).select(F.from_json("payload", layout).alias("x")).select("x.*")


def without(df: DataFrame, tombstones: DataFrame) -> DataFrame:
    return df.join(tombstones.select("id").distinct(), "id", "left_anti")


def update_columns(base: DataFrame, updates: DataFrame, columns: list[str], metadata: str | None = "metadata") -> DataFrame:
    """Rows of base with the non-null columns of updates (one row per id); JSON metadata keys are merged in."""
    u = updates.select("id", *(F.col(c).alias(f"_u_{c}") for c in columns if c in updates.columns), *([F.col(metadata).alias("_u_meta")] if metadata and metadata in updates.columns else []))
    out = base.join(u, "id", "left")
    for c in columns:
        if c in updates.columns:
            out = out.withColumn(c, F.coalesce(f"_u_{c}", c))
    if "_u_meta" in u.columns:
        as_map = lambda c: F.from_json(c, "map<string,string>")
        both = F.map_from_entries(F.concat(F.map_entries(F.map_filter(as_map(F.coalesce(F.col(metadata), F.lit("{}"))), lambda k, _: ~F.map_contains_key(as_map(F.col("_u_meta")), k))), F.map_entries(as_map(F.col("_u_meta")))))
        out = out.withColumn(metadata, F.when(F.col("_u_meta").isNull(), F.col(metadata)).otherwise(F.to_json(both)))
    return out.select(*base.columns)


def touch(df: DataFrame, at: Column) -> DataFrame:
    return df.withColumn("access_count", F.col("access_count") + 1).withColumn("accessed_at", at)


def stats(episodic: DataFrame, triples: DataFrame, procs: DataFrame, agent: str | None = None) -> DataFrame:
    """(store, n): rows of each store (facts: open ones), and in all."""
    mine = lambda df: df.filter(F.col("agent_id") == agent) if agent is not None else df
    one = lambda df, s: mine(df).select(F.lit(s).alias("store"))
    rows = one(episodic, "episodic").unionByName(one(facts.edges(triples), "semantic")).unionByName(one(procs, "procedural"))
    return rows.rollup("store").agg(F.count("*").alias("n")).select(F.coalesce("store", F.lit("total")).alias("store"), "n")


def page(episodic: DataFrame, limit: int, offset: int = 0, agent: str | None = None) -> DataFrame:
    """(id, accessed_at, decay_score), longest untouched first."""
    rows = episodic.filter(F.col("agent_id") == agent) if agent is not None else episodic
    return rows.select("id", "accessed_at", "decay_score").orderBy("accessed_at", "id").offset(offset).limit(limit)
