"""Thin shapes of the facade for agent frameworks. None imports a framework; each speaks plain Python values."""

from __future__ import annotations

import asyncio
import json
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import MemoryDB
from .functions import text
from .operators import search

#: Importance of checkpoints, of their writes, and of messages by role.
CHECKPOINT_IMPORTANCE, WRITE_IMPORTANCE = 0.9, 0.7
ROLE_IMPORTANCE = {"user": 0.6}


def role_importance(role: str) -> float:
    return ROLE_IMPORTANCE.get(role, 0.5)


class ChatMemory:
    """add, query, get_all, put, set, save, search, reset: memory of a conversation's messages."""

    def __init__(self, db: MemoryDB, agent_id: str | None = None, token_budget: int = 800):
        self.db, self.agent_id, self.budget = db, agent_id or db.agent_id, token_budget

    def add(self, content: str, role: str = "assistant", **metadata) -> str:
        return self.db.remember(content, self.agent_id, role_importance(role), metadata={"role": role, **metadata})

    put = add

    @classmethod
    def from_defaults(cls, db: MemoryDB, messages: list[dict] | None = None, **settings) -> ChatMemory:
        own = cls(db, **settings)
        own.set(messages or [])
        return own

    def set(self, messages: list[dict]) -> None:
        """Adds messages to those that are there; reset begins anew."""
        if messages:
            self.db.remember_many([{"content": m["content"], "agent_id": self.agent_id, "importance": role_importance(m.get("role", "")), "metadata": {"role": m.get("role", "")}} for m in messages])

    def query(self, text_: str, budget: int | None = None, k: int = 20) -> list[str]:
        return [r["packed"] for r in self.db.recall(text_, self.agent_id, budget or self.budget, max_results=k).collect()]

    get = query

    def save(self, value: str, metadata: dict | None = None) -> str:
        """A storage backend's write; importance may come with the metadata."""
        meta = dict(metadata or {})
        return self.db.remember(value, self.agent_id, float(meta.pop("importance", 0.5)), metadata=meta)

    def search(self, query: str, limit: int = 3, score_threshold: float = 0.0) -> list[dict]:
        """A storage backend's read: the best rows with their scores, those below the threshold left out."""
        rows = self.db.recall(query, self.agent_id, self.budget, max_results=limit).filter(F.col("score") >= score_threshold)
        return [{"id": r["id"], "content": r["packed"], "score": r["score"]} for r in rows.limit(limit).collect()]

    def get_all(self) -> list[str]:
        return [r["content"] for r in self.db.episodic().filter(F.col("agent_id") == self.agent_id).orderBy("created_at", "id").toLocalIterator()]

    def update_context(self, text_: str) -> str:
        """What half the budget recalls, to be put before a prompt."""
        return "\n".join(self.query(text_, self.budget // 2))

    def reset(self) -> int:
        return self.db.forget_agent(self.agent_id)

    clear = reset

    def close(self) -> None:
        self.db.close()


class AgentMemory(ChatMemory):
    """remember, recall and a rendered context, as tools of an agent."""

    def remember(self, content: str, importance: float = 0.5) -> str:
        return self.db.remember(content, self.agent_id, importance)

    def recall(self, query: str) -> str:
        return "\n".join(self.query(query)) or "nothing found"

    def context(self, task_hint: str | None = None, identity: str = "") -> str:
        label = {0: "Identity: ", 1: "Fact: "}
        return "\n".join(label.get(r["tier"], "") + r["content"] for r in self.db.get_context(self.agent_id, 2, task_hint, self.budget, identity).collect())

    def tools(self) -> dict:
        return {"remember": self.remember, "recall": self.recall, "context": self.context}


class KeyValueStore:
    """Items under a namespace (a tuple of names) and a key, found by exact key; searched by content."""

    def __init__(self, db: MemoryDB):
        self.db = db

    def _id(self, namespace: tuple[str, ...], key: str) -> str:
        one = self.db.spark.range(1).select(text.item_id(F.lit(self.db.agent_id), F.array(*map(F.lit, namespace)) if namespace else F.array().cast("array<string>"), F.lit(key)).alias("id"))
        return one.first()["id"]

    def put(self, namespace: tuple[str, ...], key: str, value: dict, importance: float = 0.5) -> str:
        id_ = self._id(namespace, key)
        meta = {"namespace": list(namespace), "key": key}
        new = self.db.spark.createDataFrame([(json.dumps(value),)], "content string")
        row = new.select(
            F.lit(id_).alias("id"), "content", F.lit("episodic").alias("memory_type"), F.lit(self.db.agent_id).alias("agent_id"), F.lit("private").alias("scope"), F.lit(None).cast("string").alias("team_id"), F.lit(importance).alias("importance"),
            F.lit(1.0).alias("decay_score"), F.lit(0).cast("bigint").alias("access_count"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("accessed_at"), F.lit(self.db.embed([json.dumps(value)])[0]).cast("array<float>").alias("embedding"), F.lit(json.dumps(meta)).alias("metadata"),
        )
        self.db.store.append(row, "episodic")
        return id_

    def get(self, namespace: tuple[str, ...], key: str) -> dict | None:
        r = self.db.episodic().filter(F.col("id") == self._id(namespace, key)).select("content").first()
        return json.loads(r["content"]) if r else None

    def delete(self, namespace: tuple[str, ...], key: str) -> bool:
        return self.db.forget(self._id(namespace, key))

    def _items(self) -> DataFrame:
        rows = self.db.episodic().filter(F.col("agent_id") == self.db.agent_id)
        m = rows.withColumn("m", F.from_json("metadata", "namespace array<string>, key string"))
        return m.filter(F.col("m.key").isNotNull()).select("id", "content", "created_at", F.col("m.namespace").alias("namespace"), F.col("m.key").alias("key"))

    def search(self, prefix: tuple[str, ...], query: str | None = None, limit: int | None = 10, offset: int = 0) -> list[dict]:
        """Items below a prefix: by age, or the nearest to a query. No limit gives all."""
        items = self._items().filter(under(F.col("namespace"), prefix))
        if query:
            rows = self.db.episodic().select(F.col("id").alias("id"), "embedding").join(items, "id")
            q = self.db.spark.createDataFrame([(0, self.db.embed([query])[0])], "query_id int, vec array<float>")
            most = (1 << 30) if limit is None else offset + limit
            items = search.nearest(rows, q, most).orderBy("near_rank")
        else:
            items = items.orderBy("created_at", "id")
        items = items.offset(offset) if limit is None else items.offset(offset).limit(limit)
        return [{"namespace": tuple(r["namespace"]), "key": r["key"], "value": json.loads(r["content"])} for r in items.collect()]

    def delete_under(self, prefix: tuple[str, ...]) -> int:
        """All items below a prefix, in one change."""
        return self.db.store.delete(self._items().filter(under(F.col("namespace"), prefix)).select("id"), "episodic")

    def list_namespaces(self, prefix: tuple[str, ...] = (), suffix: tuple[str, ...] = (), max_depth: int | None = None, limit: int = 100, offset: int = 0) -> list[tuple[str, ...]]:
        """Distinct, in the order first seen."""
        return [tuple(r["namespace"]) for r in namespaces(self._items(), prefix, suffix, max_depth).offset(offset).limit(limit).collect()]

    async def aput(self, *a, **k):
        return await asyncio.to_thread(self.put, *a, **k)

    async def aget(self, *a, **k):
        return await asyncio.to_thread(self.get, *a, **k)

    async def adelete(self, *a, **k):
        return await asyncio.to_thread(self.delete, *a, **k)

    async def asearch(self, *a, **k):
        return await asyncio.to_thread(self.search, *a, **k)

    async def alist_namespaces(self, *a, **k):
        return await asyncio.to_thread(self.list_namespaces, *a, **k)


def under(namespace, prefix: tuple[str, ...]):
    return F.lit(True) if not prefix else F.slice(namespace, F.lit(1), F.lit(len(prefix))) == F.array(*map(F.lit, prefix))


def namespaces(items: DataFrame, prefix: tuple[str, ...] = (), suffix: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    ns = F.col("namespace")
    keep = under(ns, prefix)
    if suffix:
        n = len(suffix)
        keep = keep & F.when(F.size(ns) >= n, F.slice(ns, F.size(ns) - n + 1, F.lit(n)) == F.array(*map(F.lit, suffix))).otherwise(F.lit(False))
    cut = F.slice(ns, F.lit(1), F.lit(max_depth)) if max_depth is not None else ns
    return items.filter(keep).groupBy(cut.alias("namespace")).agg(F.min(F.struct("created_at", "id")).alias("first")).orderBy("first")


class Checkpointer:
    """Checkpoints of threads: the latest, or one by its id; pending writes with them."""

    def __init__(self, db: MemoryDB):
        self.kv = KeyValueStore(db)

    def put(self, thread: str, checkpoint: dict, metadata: dict | None = None) -> str:
        self.kv.put(("checkpoint", thread), str(checkpoint["id"]), {"checkpoint": checkpoint, "metadata": metadata or {}}, CHECKPOINT_IMPORTANCE)
        return str(checkpoint["id"])

    def put_writes(self, thread: str, checkpoint_id: str, task: str, writes: list) -> None:
        self.kv.put(("writes", thread, checkpoint_id), task, {"writes": writes}, WRITE_IMPORTANCE)

    def list(self, thread: str, limit: int | None = 100, before: str | None = None, filter: dict | None = None) -> list[dict]:  # noqa: A002
        """The newest first; only those older than the checkpoint ``before``, and with these values in their metadata."""
        rows = self.kv._items().filter(under(F.col("namespace"), ("checkpoint", thread)))
        if before is not None:
            edge = rows.filter(F.col("key") == before).select(F.struct("created_at", "key").alias("edge"))
            rows = rows.join(F.broadcast(edge)).filter(F.struct("created_at", "key") < F.col("edge"))
        for k, v in (filter or {}).items():
            rows = rows.filter(F.get_json_object("content", f"$.metadata['{k}']") == (v if isinstance(v, str) else json.dumps(v)))
        rows = rows.orderBy(F.desc("created_at"), F.desc("key"))
        return [json.loads(r["content"]) for r in (rows.limit(limit) if limit is not None else rows).collect()]

    def get_tuple(self, thread: str, checkpoint_id: str | None = None) -> dict | None:
        if checkpoint_id is None:
            last = self.list(thread, 1)
            found = last[0] if last else None
        else:
            found = self.kv.get(("checkpoint", thread), checkpoint_id)
        if found is not None:
            found["writes"] = [w["value"]["writes"] for w in self.kv.search(("writes", thread, str(found["checkpoint"]["id"])), limit=None)]
        return found


class Collections:
    """Collections of records with keys: upsert, get, remove, nearest, one or many at a time."""

    def __init__(self, db: MemoryDB):
        self.db, self.kv = db, KeyValueStore(db)

    async def create_collection(self, name: str) -> None:
        await self.kv.aput(("collections",), name, {"name": name})

    async def get_collections(self) -> list[str]:
        return sorted(r["key"] for r in await self.kv.asearch(("collections",), limit=None))

    async def does_collection_exist(self, name: str) -> bool:
        return await self.kv.aget(("collections",), name) is not None

    async def delete_collection(self, name: str) -> None:
        await self.kv.adelete(("collections",), name)
        await asyncio.to_thread(self.kv.delete_under, ("records", name))

    async def upsert(self, collection: str, key: str, record: dict) -> str:
        await self.kv.aput(("records", collection), key, record)
        return key

    async def upsert_batch(self, collection: str, records: dict[str, dict]) -> list[str]:
        return [await self.upsert(collection, k, r) for k, r in records.items()]

    async def get(self, collection: str, key: str) -> dict | None:
        return await self.kv.aget(("records", collection), key)

    async def get_batch(self, collection: str, keys: list[str]) -> list[dict]:
        return [r for k in keys if (r := await self.get(collection, k)) is not None]

    async def remove(self, collection: str, key: str) -> None:
        await self.kv.adelete(("records", collection), key)

    async def remove_batch(self, collection: str, keys: list[str]) -> None:
        for k in keys:
            await self.remove(collection, k)

    async def get_nearest_matches(self, collection: str, embedding: list[float], limit: int = 5, min_relevance: float = 0.7) -> list[tuple[dict, float]]:
        """By the embedding; of matches below the floor only the best is kept, if none is above."""
        return await asyncio.to_thread(self._nearest, collection, embedding, limit, min_relevance)

    async def get_nearest_match(self, collection: str, embedding: list[float], min_relevance: float = 0.7) -> tuple[dict, float] | None:
        found = await self.get_nearest_matches(collection, embedding, 1, min_relevance)
        return found[0] if found else None

    def _nearest(self, collection: str, embedding: list[float], limit: int, floor: float) -> list[tuple[dict, float]]:
        items = self.kv._items().filter(under(F.col("namespace"), ("records", collection))).select("id")
        rows = self.db.episodic().join(items, "id", "left_semi")
        q = self.db.spark.createDataFrame([(0, embedding)], "query_id int, vec array<float>")
        hits = relevance_floor(search.nearest(rows, q, limit).withColumn("relevance", 1 - F.col("dist")), floor)
        return [(json.loads(r["content"]), r["relevance"]) for r in hits.orderBy("near_rank").collect()]


def relevance_floor(hits: DataFrame, floor: float) -> DataFrame:
    return hits.filter((F.col("relevance") >= floor) | (F.col("near_rank") == 1))


class VectorIndex:
    """insert, query, delete of texts."""

    def __init__(self, db: MemoryDB, token_budget: int = 1000):
        self.db, self.budget = db, token_budget

    def insert(self, texts: list[str]) -> list[str]:
        return self.db.remember_many([{"content": t} for t in texts])

    def query(self, text_: str, k: int = 5) -> list[tuple[str, str, float]]:
        return [(r["id"], r["packed"], r["score"]) for r in self.db.recall(text_, token_budget=self.budget, memory_types=("episodic",), max_results=k).collect()]

    def delete(self, id_: str) -> bool:
        return self.db.forget(id_)


class ToolServer:
    """Named tools with JSON answers; one call at a time. Errors come back as JSON too."""

    def __init__(self, db: MemoryDB):
        self.db, self.lock = db, threading.Lock()
        rows = lambda df, *c: [r.asDict() for r in df.select(*c).collect()]
        self.tools = {
            "remember": lambda **a: {"id": db.remember(**a)},
            "recall": lambda **a: {"memories": rows(db.recall(**a), "id", "store", "packed", "score")},
            "learn": lambda **a: {"id": db.learn(**a)},
            "query_knowledge": lambda **a: {"facts": rows(db.query_knowledge(**a), "id", "subject", "predicate", "object", "confidence")},
            "learn_procedure": lambda **a: {"id": db.learn_procedure(**a)},
            "forget": lambda **a: {"forgotten": db.forget(**a)},
            "get_context": lambda **a: {"context": rows(db.get_context(**a), "tier", "pos", "content")},
            "stats": lambda **a: db.stats(**a),
        }

    def dispatch(self, name: str, arguments: dict | None = None) -> str:
        with self.lock:
            try:
                return json.dumps(self.tools[name](**(arguments or {})), default=str)
            except Exception as e:  # the caller gets the error as an answer
                return json.dumps({"error": f"{type(e).__name__}: {e}"})
