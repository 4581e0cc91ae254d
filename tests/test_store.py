"""The store, the facade, the adapters and the streams."""

import asyncio
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memspark import adapters
from memspark.api import MemoryDB
from memspark.operators.metadata_schema import Field, Migration, SchemaValidationError
from memspark.schemas import Config
from memspark.sources import store as store_module
from memspark.streaming import online


@pytest.fixture
def db(spark, tmp_path):
    db = MemoryDB(spark, str(tmp_path / "db"), "coder", Config(embedding_dim=32))
    yield db
    db.close()


def test_memory_life(db):
    a, b = db.remember_many([{"content": "the deploy failed with an error", "importance": 0.9}, {"content": "tea is nice", "importance": 0.2, "scope": "org"}])
    c = db.remember("someone else's secret", agent_id="other")
    got = [r.id for r in db.recall("the deploy failed").collect()]
    assert got == [a, b]
    assert db.stats() == {"episodic": 3, "total": 3}
    assert db.update_metadata(a, importance=0.1, note="x") and not db.update_metadata("nope", importance=1)
    row = db.episodic().filter(F.col("id") == a).first()
    assert row.importance == 0.1 and json.loads(row.metadata) == {"note": "x"}
    assert db.forget(b) and not db.forget(b) and not db.forget("not-a-uuid")
    db.checkpoint()
    db.remember("after the checkpoint")
    again = MemoryDB(db.spark, db.store.path, "coder", db.config)
    assert again.stats()["episodic"] == 3
    assert db.forget_agent("other") == 1 and db.episodic().filter(F.col("id") == c).isEmpty()


def test_facts_and_procedures(db):
    db.learn("ann", "works_at", "Acme")
    db.learn("ann", "works_at", "Globex")
    db.learn("Globex", "based_in", "Springfield")
    open_ = db.triples().filter("valid_until is null")
    assert sorted(r.object for r in open_.collect()) == ["Globex", "Springfield"]
    assert len(db.query_knowledge("ann", 1).collect()) == 1 and len(db.query_knowledge("ann", 2).collect()) == 2
    p = db.learn_procedure("fix_cors", [{"action": "edit config", "tool": "vim"}, {"action": "restart"}], "Fix CORS", applicable_contexts=["cors"], success_rate=0.5)
    db.learn_procedure("deploy_vercel", [{"action": "push"}], "Deploy", applicable_contexts=["vercel"])
    assert db.search_procedures("what about the cors error").first().id == p
    assert db.record_execution(p, True) and not db.record_execution("x", True)
    row = db.procedures().filter(F.col("id") == p).first()
    assert row.success_rate == pytest.approx(0.65) and row.execution_count == 1
    got = db.recall("cors", memory_types=("procedural",)).collect()
    assert got[0].packed == "Procedure 'fix_cors': Fix CORS. Steps: edit config (vim) → restart"
    tiers = {r.tier for r in db.get_context(level=3, task_hint="cors", identity="I am coder").collect()}
    assert {0, 1, 2} <= tiers
    assert db.explain("how to deploy", ("semantic", "procedural"))["stores"][0] == "procedural"


def test_maintenance(db):
    db.remember_many([{"content": "Ann prefers tea. More text."}, {"content": "ann prefers Tea"}, {"content": "Bob uses vim"}])
    assert db.consolidate() == 1 and db.consolidate() == 0
    t = db.triples().first()
    assert (t.subject, t.predicate, t.object) == ("ann", "prefers", "tea") and t.confidence == 1.0 and len(t.source_episodes) == 2
    assert db.run_decay(now=dt.datetime.now() + dt.timedelta(days=1)) == 0
    assert db.run_decay(now=dt.datetime.now() + dt.timedelta(days=365)) == 3


def test_schemas(db):
    db.register_schema("coder", "tools", {"tool": Field("str", True)})
    with pytest.raises(SchemaValidationError) as e:
        db.remember("x", metadata={"tool": 1})
    assert e.value.fields == ["metadata.tool: expected str, got int"]
    a = db.remember("x", metadata={"tool": "t"})
    db.migrate_schema(Migration("coder", 1).add("level", Field("int", default=3)))
    assert json.loads(db.episodic().filter(F.col("id") == a).first().metadata) == {"tool": "t", "level": 3}
    assert MemoryDB(db.spark, db.store.path, "coder", db.config).get_schema("coder").version == 2


def test_adapters(db):
    chat = adapters.AgentMemory(db)
    chat.add("hello there", "user")
    chat.remember("the build is red")
    assert set(chat.get_all()) == {"hello there", "the build is red"} and "red" in chat.recall("build red")
    assert "build" in chat.context("build") and chat.update_context("build")
    chat.set([{"role": "user", "content": "added to the rest"}])
    assert set(chat.get_all()) == {"hello there", "the build is red", "added to the rest"} and chat.reset() == 3
    own = adapters.ChatMemory.from_defaults(db, [{"role": "user", "content": "only this"}], agent_id="other")
    own.save("a saved thing", {"importance": 0.9, "k": 1})
    assert own.search("saved thing", 1)[0]["content"] == "a saved thing" and own.search("saved thing", 5, 2.0) == [] and own.reset() == 2
    kv = adapters.KeyValueStore(db)
    kv.put(("a", "b"), "k", {"v": 1})
    kv.put(("a", "c"), "k", {"v": 2})
    kv.put(("a", "b"), "k", {"v": 3})
    assert kv.get(("a", "b"), "k") == {"v": 3} and kv.get(("a",), "k") is None
    assert sorted(kv.list_namespaces(("a",))) == [("a", "b"), ("a", "c")] and kv.list_namespaces(max_depth=1) == [("a",)]
    assert len(kv.search(("a",))) == 2 and len(kv.search(("a",), "v", limit=1)) == 1 and kv.delete(("a", "c"), "k")
    cp = adapters.Checkpointer(db)
    cp.put("t", {"id": "1", "x": 1})
    cp.put("t", {"id": "2", "x": 2})
    cp.put_writes("t", "2", "task", [1, 2])
    cp.put("t", {"id": "3", "x": 3}, {"kind": "last"})
    assert [c["checkpoint"]["id"] for c in cp.list("t")] == ["3", "2", "1"] and [c["checkpoint"]["id"] for c in cp.list("t", before="3")] == ["2", "1"]
    assert [c["checkpoint"]["id"] for c in cp.list("t", filter={"kind": "last"})] == ["3"] and cp.kv.db.forget(cp.kv._id(("checkpoint", "t"), "3"))
    assert cp.get_tuple("t", "1")["checkpoint"]["x"] == 1 and cp.get_tuple("t")["writes"] == [[1, 2]] and cp.get_tuple("u") is None
    ix = adapters.VectorIndex(db)
    (i,) = ix.insert(["a vector text"])
    assert ix.query("a vector text", 1)[0][0] == i and ix.delete(i)
    t = adapters.ToolServer(db)
    assert "id" in json.loads(t.dispatch("remember", {"content": "z"})) and "error" in json.loads(t.dispatch("nothing"))


def test_collections(db):
    async def go():
        c = adapters.Collections(db)
        await c.create_collection("x")
        assert await c.does_collection_exist("x") and await c.get_collections() == ["x"]
        await c.upsert_batch("x", {"1": {"t": "alpha"}, "2": {"t": "beta"}})
        assert await c.get("x", "1") == {"t": "alpha"} and len(await c.get_batch("x", ["1", "2", "3"])) == 2
        found = await c.get_nearest_match("x", db.embed([json.dumps({"t": "beta"})])[0])
        assert found[0] == {"t": "beta"} and found[1] == pytest.approx(1)
        await c.remove("x", "1")
        assert await c.get("x", "1") is None
        await c.delete_collection("x")
        assert await c.get_collections() == [] and await c.get("x", "2") is None

    asyncio.run(go())


def test_sessions(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"sessions": [{"session_id": "s", "agent_id": "a", "date": "d", "messages": [{"role": "user", "content": "hi"}]}], "questions": [{"question_id": "q", "question": "?", "category": "c"}]}, indent=1))
    m, q = store_module.read_sessions(spark, str(p))
    assert m.first().content == "hi" and q.first().category == "c"
    e = store_module.as_episodic(m, "content", F.col("agent_id"), F.current_timestamp())
    assert e.first().importance == 0.5


def test_streams(spark, db, tmp_path):
    rows = [("a", "p", "x", 1), ("a", "p", "x", 2), ("a", "p", "y", 3), ("b", "p", "x", 4), ("a", "p", "x", 5)]
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(*r, t + dt.timedelta(seconds=r[3])) for r in rows], "subject string, predicate string, object string, write_seq bigint, written_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = online.supersede_online(s).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    none = (None, None)
    assert {r.write_seq: (r.closed_first, r.closed_last) for r in spark.table("changes").collect()} == {1: none, 2: none, 3: (1, 2), 4: none, 5: (3, 3)}
    db.remember("x")
    db.episodic().write.parquet(str(tmp_path / "ep"))
    db.forget_agent()
    q = online.read_table(spark, str(tmp_path / "ep"), "episodic").writeStream.foreachBatch(online.append_to(db.store, "episodic")).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert db.stats()["episodic"] == 1


def test_writers_never_share_a_number(db):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        ids = list(pool.map(lambda i: db.learn("ann", "works_at", f"place {i}"), range(8)))
    log = db.store.log()
    assert len(set(ids)) == log.select("seq").distinct().count() == log.count() == 8
    assert db.triples().filter("valid_until IS NULL").count() == 1


def test_a_half_written_append_is_not_read(db):
    db.remember("whole")
    n = db.store.claim()
    rows = db.episodic().withColumn("id", F.lit("half"))
    seq = F.lit(n << store_module.CLAIM_BITS).alias("seq")
    rows.select(seq, F.current_timestamp().alias("ts"), F.lit("upsert").alias("op"), F.lit("episodic").alias("store"), "id", F.to_json(F.struct(*rows.columns)).alias("payload")).write.mode("append").parquet(f"{db.store.path}/log")
    later = db.remember("later")
    assert {r.content for r in db.episodic().collect()} == {"whole", "later"} and db.get("half") is None
    db.checkpoint()
    assert db.get(later)["content"] == "later" and db.episodic().count() == 2
    db.store.abandon(n)
    assert db.episodic().count() == 3
    db.checkpoint()
    after = db.remember("after")
    assert db.episodic().count() == 4 and db.get(after)["content"] == "after"
    with pytest.raises(Exception, match="raise|boom"):
        db.store.append(db.spark.range(1).select(F.lit("x").alias("id"), F.raise_error(F.lit("boom")).cast("string").alias("c")), "episodic")
    assert db.episodic().count() == 4


def test_intervals_are_kept_at_a_checkpoint(db):
    a, b = db.learn("ann", "works_at", "Acme"), db.learn("ann", "works_at", "Globex")
    before = {r.id: r.valid_until for r in db.triples().collect()}
    db.checkpoint()
    assert {r.id: r.valid_until for r in db.triples().collect()} == before and before[a] is not None and before[b] is None
    assert json.loads(db.get(a, "semantic")["metadata"]) == {"superseded": True}
    c = db.learn("ann", "works_at", "Initech")
    db.checkpoint()
    assert [r.id for r in db.triples().filter("valid_until IS NULL").collect()] == [c] and db.forget(c, "semantic")
    assert db.triples().filter("valid_until IS NULL").isEmpty()


def test_decay_writes_what_changes(db):
    mine, other = db.remember("mine"), db.remember("not mine", agent_id="other")
    n = db.store.log().count()
    assert db.run_decay("coder", dt.datetime.now() + dt.timedelta(days=1)) == 0
    assert db.store.log().count() == n + 1
    assert db.get(mine)["decay_score"] < 1 and db.get(other)["decay_score"] == 1
    fresh = db.refresh_decay(other, dt.datetime.now() + dt.timedelta(days=7))
    assert fresh == pytest.approx(0.5, abs=0.05) and db.get(other)["decay_score"] == fresh and db.refresh_decay("nope") is None
    assert {r.id for r in db.get_many(db.spark.createDataFrame([(mine,), (other,), ("x",)], "id string")).collect()} == {mine, other}


def test_collections_and_writes_beyond_a_thousand(db):
    kv = adapters.KeyValueStore(db)
    row = db.spark.range(1).select(F.lit("x").alias("id"))
    many = 1_200
    meta = lambda ns, key: F.to_json(F.struct(ns.alias("namespace"), key.alias("key")))
    own = F.concat(F.lit("k"), F.col("i"))
    base = db.spark.range(many).select(F.col("id").alias("i")).select(F.concat(F.lit("w"), F.col("i")).alias("id"), F.lit(json.dumps({"writes": [1]})).alias("content"), F.lit("episodic").alias("memory_type"), F.lit("coder").alias("agent_id"), F.lit(1.0).alias("importance"), F.lit(1.0).alias("decay_score"), F.current_timestamp().alias("created_at"), meta(F.array(F.lit("writes"), F.lit("t"), F.lit("1")), own).alias("metadata"))
    db.store.append(base, "episodic")
    cp = adapters.Checkpointer(db)
    cp.put("t", {"id": "1"})
    assert len(cp.get_tuple("t")["writes"]) == many and row.count() == 1
    assert kv.delete_under(("writes",)) == many


def test_tool_server(db):
    import io

    from memspark import server

    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "remember", "arguments": {"content": "the sky is red"}}}]
    asked += [{"id": 4, "method": "tools/call", "params": {"name": "recall", "arguments": {"query": "red sky"}}}, {"id": 5, "method": "tools/call", "params": {"name": "recall", "arguments": {}}}, {"id": 6, "method": "nothing"}]
    out = io.StringIO()
    server.serve(adapters.ToolServer(db), [*map(json.dumps, asked), "", "{"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None]
    names = {t["name"] for t in got[1]["result"]["tools"]}
    assert names == set(adapters.ToolServer(db).tools) and {"remember", "recall", "learn", "learn_procedure", "get_context", "forget"} <= names
    assert "the sky is red" in got[3]["result"]["content"][0]["text"] and got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601


def test_default_model_and_units(spark):
    from memspark.operators import importance

    m = importance.default_model(spark)
    assert m is importance.default_model(spark)
    now = dt.datetime(2024, 1, 3)
    rows = [("critical error: the db password leaked in v2.1", "episodic", 0, now), ("maybe a test sample", "episodic", 0, now - dt.timedelta(days=3))]
    df = spark.createDataFrame(rows, "content string, memory_type string, access_count bigint, created_at timestamp")
    for model in (None, m):
        a, b = importance.score_units(df, F.lit(now).cast("timestamp"), model).orderBy("created_at", ascending=False).collect()
        assert 0 <= b.score < a.score <= 1 and "recency_hours" not in a.__fields__


def test_a_tokenizer_fills_budgets(spark):
    from memspark.functions import plug
    from memspark.operators import budget

    count = plug.token_counter(lambda: lambda texts: [len(t.split()) for t in texts])
    cut = plug.token_cutter(lambda: (lambda t: t.split(), " ".join))
    df = spark.createDataFrame([(0, 1, "a b c"), (0, 2, "d e f g"), (0, 3, "h")], "query_id int, o int, content string")
    got = budget.fill(df, 5, ["o"], count=count, cut=cut).orderBy("o").collect()
    assert [(r.packed, r.before) for r in got] == [("a b c", 0), ("d...", 3)]
    taken = budget.fill_skipping(df, 4, ["o"], count=count).first()
    assert taken.taken == ["a b c", "h"] and taken.used == 4


def test_approximate_search_from_a_threshold(spark):
    from memspark import sizes
    from memspark.operators import search

    rows = [(i, [1.0, i / 50, 0.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>").withColumn("scope", F.lit("org")).withColumn("agent_id", F.lit("a"))
    q = spark.createDataFrame([(0, [1.0, 0.2, 0.5]), (1, [1.0, 0.9, 0.5])], "query_id int, vec array<float>")
    exact = {(r.query_id, r.id) for r in search.find(df, q, 3, F.col("id") % 2 == 0, 51).collect()}
    near = {(r.query_id, r.id) for r in search.find(df, q, 3, F.col("id") % 2 == 0, 50).collect()}
    assert len(exact) == 6 and len(exact & near) >= 5
    blocks = sizes.blocks(q, "query_id", 100)
    assert len(blocks) > 1 and sum(b.count() for b in blocks) == 2
    rows = spark.createDataFrame([(i,) for i in range(5)], "n int")
    assert sorted((r.n, r.query_id) for r in sizes.join_blocks(rows, q, F.col("n") > F.col("query_id"), block_bytes=100).collect()) == [(n, i) for n in range(5) for i in (0, 1) if n > i]


def test_online_supersession_over_many_batches(spark, tmp_path):
    import random

    r = random.Random(4)
    t = dt.datetime(2024, 1, 1)
    rows = [("ab"[r.randrange(2)], "p", r.choice("xyz"), i, t + dt.timedelta(seconds=i)) for i in range(60)]
    layout = "subject string, predicate string, object string, write_seq bigint, written_at timestamp"
    for k in range(0, 60, 12):
        spark.createDataFrame(rows[k : k + 12], layout).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online.supersede_online(s).writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want, open_ = {}, {}
    for s_, _, o, i, _ in rows:
        obj, first, last = open_.get(s_, (None, None, None))
        want[i] = (first, last) if obj not in (None, o) else (None, None)
        open_[s_] = (o, first if obj == o else i, i)
    assert {x.write_seq: (x.closed_first, x.closed_last) for x in spark.table("many").collect()} == want


def test_ingest_counts_what_it_took(spark, db, tmp_path):
    a, b = "0b1c2d3e-0000-4000-8000-00000000000a", "0b1c2d3e-0000-4000-8000-00000000000b"
    rows = [(a, "old text", "ann", 1_700_000_000_000), (a, "new text", "ann", 1_700_000_000_500), (b, "other", "bob", 1_600_000_000_000), ("17", "no uuid", "bob", 1), (b, None, "bob", 1), (b, "no time", "bob", None)]
    df = spark.createDataFrame(rows, "key string, body string, who string, ms bigint")
    assert store_module.ingest(db.store, df, "body", F.col("who"), "ms", "key") == {"migrated": 3, "failed": 3}
    assert db.get(a)["content"] == "new text" and db.get(b)["agent_id"] == "bob"
    at = db.store.get("episodic", a).select(store_module.to_millis(F.col("created_at")).alias("ms")).first()
    assert at.ms == 1_700_000_000_500
    store_module.write_report(spark, {"b": 1, "a": [2]}, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value) == {"a": [2], "b": 1}


def test_partial_fit_moves_towards_the_labels(spark):
    from memspark.operators import importance

    m = importance.default_model(spark)
    rows = [(f"critical error {i}: must rollback v{i}.1", "episodic", 0.05, 0, 0.0) for i in range(40)]
    df = spark.createDataFrame(rows, "content string, memory_type string, importance double, access_count bigint, recency_hours double")
    mean = lambda model: importance.scored(df, model).agg(F.avg("score")).first()[0]
    once = importance.partial_fit(m, df)
    assert mean(m) > 0.9 and mean(once) == pytest.approx(0.05, abs=0.05)
    assert mean(importance.partial_fit(m, df.limit(1))) > mean(once)
    assert importance.partial_fit(m, df.repartition(7)).coef == pytest.approx(once.coef)
