"""The facade: a memory database over a store, with batched operations behind single calls."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import score, text
from .operators import facts, maintain, metadata_schema, procedures, recall
from .schemas import EPISODIC, PROCEDURES, SCOPES, TRIPLES, Config
from .sources.store import CLAIM_BITS, Store

Embed = Callable[[list[str]], list[list[float]]]


def hashed_words(dim: int) -> Embed:
    """A stand-in embedder: hashed bags of words at length one."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 1 << 31 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class MemoryDB:
    def __init__(self, spark: SparkSession, path: str, agent_id: str = "default", config: Config | None = None, embed: Embed | None = None):
        self.spark, self.agent_id, self.config = spark, agent_id, config or Config()
        self.store = Store.at(spark, path)
        self.embed = embed or hashed_words(self.config.embedding_dim)
        self.registry = self.store.load_schemas(self.config.strict_schemas)

    # -- writing
    def remember(self, content: str, agent_id: str | None = None, importance: float = 0.5, scope: str = "private", metadata: dict | None = None, memory_type: str = "episodic", team_id: str | None = None) -> str:
        return self.remember_many([{"content": content, "agent_id": agent_id, "importance": importance, "scope": scope, "metadata": metadata, "memory_type": memory_type, "team_id": team_id}])[0]

    def remember_many(self, rows: list[dict]) -> list[str]:
        out, t = [], _now()
        for r, v in zip(rows, self.embed([r["content"] for r in rows])):
            if r.get("scope", "private") not in SCOPES:
                raise ValueError(f"unknown scope {r['scope']}")
            out.append((str(uuid.uuid4()), r["content"], r.get("memory_type") or "episodic", r.get("agent_id") or self.agent_id, r.get("scope", "private"), r.get("team_id"), float(r.get("importance", 0.5)), 1.0, 0, t, t, v, json.dumps(r.get("metadata") or {})))
        df = self.spark.createDataFrame(out, EPISODIC)
        self.registry.validate_and_raise(df)
        self.store.append(df, "episodic")
        return [r[0] for r in out]

    def learn(self, subject: str, predicate: str, object: str, agent_id: str | None = None, confidence: float = 1.0, valid_from: datetime | None = None, source_episodes: list[str] | None = None) -> str:  # noqa: A002
        return self.learn_many([(subject, predicate, object, agent_id, confidence, valid_from, source_episodes)])[0]

    def learn_many(self, rows: list[tuple]) -> list[str]:
        t, n = _now(), self.store.claim()
        out = [(str(uuid.uuid4()), s, p, o, a or self.agent_id, float(c), f or t, None, e or [], "{}", (n << CLAIM_BITS) + i, t) for i, (s, p, o, a, c, f, e) in enumerate(rows)]
        self.store.append(self.spark.createDataFrame(out, TRIPLES), "triples", order=[F.col("write_seq")], claim=n)
        return [r[0] for r in out]

    def learn_procedure(self, name: str, steps: list[dict], description: str = "", agent_id: str | None = None, applicable_contexts: list[str] | None = None, success_rate: float = 1.0, source_episodes: list[str] | None = None) -> str:
        t = _now()
        own = [(s.get("action"), s.get("tool"), json.dumps(s.get("parameters") or {}), s.get("expected_output"), s.get("fallback_action")) for s in steps]
        row = (str(uuid.uuid4()), name, description, agent_id or self.agent_id, float(success_rate), 0, t, t, own, source_episodes or [], applicable_contexts or [])
        self.store.append(self.spark.createDataFrame([row], PROCEDURES), "procedures")
        return row[0]

    def record_execution(self, id: str, success: bool) -> bool:  # noqa: A002
        old = self.store.get("procedures", id)
        if old.isEmpty():
            return False
        new = procedures.record_executions(old, self.spark.createDataFrame([(id, 1, success)], "id string, seq int, success boolean"))
        rest = [c for c in old.columns if c not in ("success_rate", "execution_count")]
        self.store.append(old.select(*rest).join(new, "id").withColumn("updated_at", F.current_timestamp()).select(*old.columns), "procedures")
        return True

    def update_metadata(self, id: str, **updates) -> bool:  # noqa: A002
        """Columns of the row by their names; everything else goes into its metadata."""
        old = self.store.get("episodic", id)
        if old.isEmpty():
            return False
        kinds = {"importance": "double", "decay_score": "double", "access_count": "bigint", "accessed_at": "timestamp", "content": "string", "scope": "string"}
        own = {k: v for k, v in updates.items() if k in kinds}
        extra = {k: v if isinstance(v, str) else json.dumps(v) for k, v in updates.items() if k not in kinds}
        row = self.spark.range(1).select(F.lit(id).alias("id"), *(F.lit(v).cast(kinds[k]).alias(k) for k, v in own.items()), *([F.lit(json.dumps(extra)).alias("metadata")] if extra else []))
        self.store.append(maintain.update_columns(old, row, list(own)), "episodic")
        return True

    def forget(self, id: str, memory_type: str = "episodic") -> bool:  # noqa: A002
        store = {"episodic": "episodic", "semantic": "triples", "procedural": "procedures"}[memory_type]
        return self.store.delete(self.spark.createDataFrame([(id,)], "id string"), store) > 0

    def forget_agent(self, agent_id: str | None = None) -> int:
        """All rows of an agent, and nobody else's."""
        me, n = agent_id or self.agent_id, 0
        for s, df in (("episodic", self.episodic()), ("triples", self.triples()), ("procedures", self.procedures())):
            n += self.store.delete(df.filter(F.col("agent_id") == me).select("id"), s)
        return n

    # -- tables
    def episodic(self) -> DataFrame:
        return self.store.table("episodic")

    def triples(self) -> DataFrame:
        return self.store.facts() if self.config.contradiction_check else self.store.table("triples")

    def procedures(self) -> DataFrame:
        return self.store.table("procedures")

    def get(self, id: str, memory_type: str = "episodic") -> dict | None:  # noqa: A002
        """One row by its id."""
        row = self.get_many(self.spark.createDataFrame([(id,)], "id string"), memory_type).first()
        return row.asDict(recursive=True) if row else None

    def get_many(self, ids: DataFrame, memory_type: str = "episodic") -> DataFrame:
        """The rows of a frame of ids; unknown ones are passed over."""
        if memory_type == "semantic":
            return self.triples().join(ids.select("id").distinct(), "id", "left_semi")  # a fact's interval depends on others
        return self.store.get({"episodic": "episodic", "procedural": "procedures"}[memory_type], ids)

    # -- reading
    def queries(self, texts: list[str], agent_id: str | None = None, budget: int = 0, types: tuple[str, ...] = ("episodic", "semantic"), scope: str | None = None) -> DataFrame:
        rows = [(i, t, v, agent_id or self.agent_id, list(types), budget, scope) for i, (t, v) in enumerate(zip(texts, self.embed(texts)))]
        return self.spark.createDataFrame(rows, "query_id int, query string, vec array<float>, agent string, types array<string>, budget int, asked_scope string")

    def recall(self, query: str, agent_id: str | None = None, token_budget: int | None = None, memory_types: tuple[str, ...] = ("episodic", "semantic"), scope_filter: str | None = None, min_importance: float = 0.0, max_results: int = 20, routed: bool = False) -> DataFrame:
        q = self.queries([query], agent_id, token_budget or 0, memory_types, scope_filter)
        q = recall.route(q).withColumn("types", F.col("routed")).drop("routed") if routed else q
        return recall.recall(q, self.episodic(), self.triples(), self.procedures(), max_results, self.config, min_importance, touch_at=_now(), ann_threshold=self.config.ann_threshold).orderBy("out_pos")

    def explain(self, query: str, memory_types: tuple[str, ...] = ("episodic", "semantic")) -> dict:
        r = recall.explain_route(self.queries([query], types=memory_types)).first()
        return {"stores": list(r["stores"]), "reasoning": r["reasoning"], "token_budget": self.config.default_token_budget}

    def get_context(self, agent_id: str | None = None, level: int = 2, task_hint: str | None = None, token_budget: int | None = None, identity: str = "") -> DataFrame:
        q = self.queries([task_hint or ""], agent_id, token_budget or 0)
        return recall.context(q, self.episodic(), self.triples(), self.procedures(), level, identity, self.config).orderBy("tier", "pos")

    def query_knowledge(self, entity: str, depth: int = 1) -> DataFrame:
        return facts.traverse(self.triples(), self.spark.createDataFrame([(entity,)], "entity string"), depth)

    def search_procedures(self, context: str, min_success: float = 0.0) -> DataFrame:
        q = self.spark.createDataFrame([(0, context)], "query_id int, query string")
        p = self.procedures()
        return procedures.ranked(p, q, min_success).select("id", "matches", "pos").join(p, "id").orderBy("pos")

    def stats(self, agent_id: str | None = None) -> dict[str, int]:
        return {r["store"]: r["n"] for r in maintain.stats(self.episodic(), self.triples(), self.procedures(), agent_id).collect()}

    # -- maintenance
    def consolidate(self, agent_id: str | None = None, max_episodes: int = 100) -> int:
        me = agent_id or self.agent_id
        found = maintain.new_facts(maintain.recurring_statements(self.episodic().filter(F.col("agent_id") == me), max_episodes), self.triples())
        rows = found.orderBy("subject", "predicate", "object").collect()  # at most the statements of max_episodes texts
        if rows:
            self.learn_many([(r["subject"], r["predicate"], r["object"], me, r["confidence"], None, list(r["source_episodes"])) for r in rows])
        return len(rows)

    def run_decay(self, agent_id: str | None = None, now: datetime | None = None) -> int:
        rows, at = self.episodic(), now or _now()
        rule = (at, self.config.decay_half_life_hours, self.config.eviction_threshold, agent_id)
        gone = maintain.decay_pass(rows, *rule)[1].persist()
        n = self.store.delete(gone, "episodic")
        self.store.append(maintain.decay_changes(rows, *rule), "episodic")
        gone.unpersist()
        return n

    def refresh_decay(self, id: str, now: datetime | None = None) -> float | None:  # noqa: A002
        """The decay score of one episodic row, worked out anew and kept; none for an unknown id."""
        at = F.lit(now or _now()).cast("timestamp")
        row = self.store.get("episodic", id).select(score.decay(score.hours_between(F.col("accessed_at"), at), self.config.decay_half_life_hours).alias("d")).first()
        if row is None:
            return None
        self.update_metadata(id, decay_score=row["d"])
        return row["d"]

    # -- schemas
    def register_schema(self, agent_id: str, name: str, fields: dict[str, metadata_schema.Field]) -> metadata_schema.Schema:
        s = self.registry.register(agent_id, name, fields)
        self.store.save_schemas(self.registry)
        return s

    def get_schema(self, agent_id: str):
        return self.registry.get(agent_id)

    def list_schemas(self) -> list:
        return self.registry.list()

    def migrate_schema(self, migration: metadata_schema.Migration, backfill: bool = True) -> metadata_schema.Schema:
        s = migration.apply(self.registry)
        self.store.save_schemas(self.registry)
        if backfill:
            rows = self.episodic().filter(F.col("agent_id") == migration.agent_id)
            self.store.append(rows.withColumn("metadata", migration.backfill(F.col("metadata"))), "episodic")
        return s

    def checkpoint(self) -> str:
        return self.store.checkpoint(self.config.contradiction_check)

    def close(self) -> None:
        self.store.close()

    def render(self, rows: DataFrame, content: str = "packed") -> str:
        return "\n".join(r[content] for r in rows.collect())


__all__ = ["MemoryDB", "hashed_words", "text"]
