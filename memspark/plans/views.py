"""Memory tables derived from the general test tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-03-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    # all minutes of 30 days, in no order of the ids
    at = F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 7919 % 43_200 * 60_000_000)
    return d.join(e, d.doc_id == e.vec_id, "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit("episodic").alias("memory_type"), F.col("source").alias("agent_id"),
        F.element_at(F.array(*map(F.lit, ("private", "team", "org", "session"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("scope"), F.lit(None).cast("string").alias("team_id"),
        (F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("importance"), (1 - F.col("doc_id") * 17 % 50 / F.lit(100.0)).alias("decay_score"), (F.col("doc_id") % 7).alias("access_count"), at.alias("created_at"), at.alias("accessed_at"), "embedding", "lang",
    )


EPISODIC = """episodic AS (
  SELECT d.doc_id AS id, d.text AS content, d.source AS agent_id, ['private','team','org','session'][CAST(d.doc_id % 4 AS INT) + 1] AS scope,
         CAST(d.doc_id * 37 % 101 AS DOUBLE) / 100 AS importance, 1 - CAST(d.doc_id * 17 % 50 AS DOUBLE) / 100 AS decay_score, d.doc_id % 7 AS access_count,
         TIMESTAMP '2024-01-01' + to_minutes(d.doc_id * 7919 % 43200) AS created_at, CAST(e.embedding AS DOUBLE[]) AS embedding, d.lang
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def query_batch(spark: SparkSession, sf_dir: str, budget: int = 500, types: tuple[str, ...] = ("episodic",)) -> DataFrame:
    b, e, d = (read(spark, sf_dir, t) for t in ("benchmark", "embeddings", "documents"))
    rows = b.select("item_id", F.col("text").alias("query")).join(e, F.col("item_id") == F.col("vec_id")).join(d.select("doc_id", "source"), F.col("item_id") == F.col("doc_id"))
    return rows.select(F.col("item_id").alias("query_id"), "query", F.col("embedding").alias("vec"), F.col("source").alias("agent"), F.array(*map(F.lit, types)).alias("types"), F.lit(budget).alias("budget"))


QUERIES = """queries AS (
  SELECT b.item_id AS query_id, b.text AS query, CAST(e.embedding AS DOUBLE[]) AS vec, d.source AS agent
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id JOIN documents d ON d.doc_id = b.item_id)"""


def writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts: user, kind of event, hundreds of its value; written in the order of time and id."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user "), F.col("user_id") % 50).alias("subject"), F.col("event_type").alias("predicate"), F.floor(F.col("value") / 100).cast("string").alias("object"), F.concat(F.lit("agent "), F.col("user_id") % 3).alias("agent_id"),
        ((F.col("event_id") % 11 + 1) / F.lit(11.0)).alias("confidence"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"), F.struct("ts", "event_id").alias("write_seq"), F.col("ts").alias("written_at"),
    )


# the island of a write: how often the object has changed before it
FACTS = """writes AS (
  SELECT event_id AS id, 'user ' || (user_id % 50) AS subject, event_type AS predicate, CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS object, 'agent ' || (user_id % 3) AS agent_id,
         (event_id % 11 + 1) / 11.0::DOUBLE AS confidence, ts AS valid_from, ts AS written_at FROM events),
changes AS (SELECT *, CASE WHEN object <> lag(object) OVER (PARTITION BY subject, predicate ORDER BY written_at, id) THEN 1 ELSE 0 END AS c FROM writes),
islands AS (SELECT *, sum(c) OVER (PARTITION BY subject, predicate ORDER BY written_at, id ROWS UNBOUNDED PRECEDING) AS island FROM changes),
starts AS (SELECT subject, predicate, island, min(written_at) AS began FROM islands GROUP BY ALL),
facts AS (SELECT i.*, s.began AS valid_until FROM islands i LEFT JOIN starts s ON s.subject = i.subject AND s.predicate = i.predicate AND s.island = i.island + 1)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open facts: who lives where, and which nation lies in which region."""
    c, s, n, r = (read(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    n = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    one = lambda df, subject, predicate, object_: df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"))
    rows = one(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")), F.concat(F.lit("customer "), F.col("c_custkey")), "lives in", F.col("n_name"))
    rows = rows.union(one(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), F.concat(F.lit("supplier "), F.col("s_suppkey")), "works in", F.col("n_name"))).union(one(n, F.col("n_name"), "lies in", F.col("r_name")))
    return rows.select(F.concat_ws("|", "subject", "predicate", "object").alias("id"), "subject", "predicate", "object", F.concat(F.lit("agent "), F.length("subject") % 3).alias("agent_id"), ((F.length("object") % 5 + 1) / F.lit(5.0)).alias("confidence"), F.lit(None).cast("timestamp").alias("valid_until"))


GRAPH = """n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
e0 AS (SELECT 'customer ' || c_custkey AS subject, 'lives in' AS predicate, n_name AS object FROM customer JOIN n ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier ' || s_suppkey, 'works in', n_name FROM supplier JOIN n ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'lies in', r_name FROM n),
edges AS (SELECT subject || '|' || predicate || '|' || object AS id, *, 'agent ' || (length(subject) % 3) AS agent_id, CAST(length(object) % 5 + 1 AS DOUBLE) / 5 AS confidence FROM e0),
both_ways AS (SELECT subject AS u, object AS v FROM edges UNION SELECT object, subject FROM edges)"""


def procs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    contexts = F.concat(F.array("p_brand"), F.split("p_type", " "))
    steps = F.transform(contexts, lambda c: F.struct(F.concat(F.lit("check "), c).alias("action"), F.when(F.length(c) % 2 == 0, F.lower(c)).alias("tool")))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("agent "), F.col("p_partkey") % 3).alias("agent_id"), ((F.col("p_partkey") % 10 + 1) / F.lit(10.0)).alias("success_rate"),
        (F.col("p_partkey") % 13).alias("execution_count"), F.timestamp_micros(F.lit(1704067200000000) + F.col("p_partkey") * 1_000_000).alias("created_at"), contexts.alias("applicable_contexts"), steps.alias("steps"),
    )


PROCS = """procs AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS description, 'agent ' || (p_partkey % 3) AS agent_id, CAST(p_partkey % 10 + 1 AS DOUBLE) / 10 AS success_rate, p_partkey % 13 AS execution_count,
         TIMESTAMP '2024-01-01' + to_seconds(p_partkey) AS created_at, list_concat([p_brand], string_split(p_type, ' ')) AS contexts FROM part)"""
