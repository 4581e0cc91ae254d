"""The queries of the library, by name, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .. import adapters
from ..functions import score, text, vector
from ..operators import budget, evaluate, facts, importance, maintain, metadata_schema, procedures, recall, search
from ..schemas import Config
from ..streaming import online
from . import views as V

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


DIST = "list_cosine_distance(q.vec, e.embedding)"


@query(f"""WITH {V.EPISODIC}, {V.QUERIES}, h AS (SELECT query_id, id, {DIST} AS dist FROM queries q JOIN episodic e ON e.embedding IS NOT NULL)
SELECT query_id, id, round(dist, 6) AS dist, r AS near_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM h) WHERE r <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.nearest(V.episodic(spark, d).select("id", "embedding"), V.query_batch(spark, d).select("query_id", "vec"), 5).select("query_id", "id", r6(F.col("dist"), "dist"), F.col("near_rank").cast("bigint").alias("near_rank"))


@query(f"""WITH {V.EPISODIC}, {V.QUERIES}, h AS (SELECT query_id, id, {DIST} AS dist FROM queries q JOIN episodic e ON e.embedding IS NOT NULL
  WHERE (agent_id = q.agent OR scope IN ('team','org')) AND importance >= 0.4 AND created_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15')
SELECT query_id, id, round(dist, 6) AS dist, r AS near_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM h) WHERE r <= 5""")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    import datetime as dt

    keep = search.candidate_filter(F.col("agent_id"), None, 0.4, dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15))
    found = V.episodic(spark, d).filter(keep).select("id", "embedding", "agent_id", "scope")
    hits = search.nearest(found, V.query_batch(spark, d).select("query_id", "vec", F.col("agent").alias("_agent")), 5, search.visible(F.col("_agent")))
    return hits.select("query_id", "id", r6(F.col("dist"), "dist"), F.col("near_rank").cast("bigint").alias("near_rank"))


RECALL = f"""WITH {V.EPISODIC}, {V.QUERIES}, h AS (SELECT query_id, e.*, {DIST} AS dist FROM queries q JOIN episodic e ON e.embedding IS NOT NULL WHERE agent_id = q.agent OR scope IN ('team','org')),
near AS (SELECT *, importance * decay_score AS eff FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM h) WHERE r <= 20),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, dist, id) AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM near),
scored AS (SELECT query_id, id, content, pos, 0.8 * eff + 0.2 * (1 - (pos - 1)::DOUBLE / greatest(1, n)) AS score FROM pos)"""


@query(RECALL + " SELECT query_id, id, pos, round(score, 6) AS score FROM scored")
def recall_blended(spark: SparkSession, d: str) -> DataFrame:
    return recall.episodic_candidates(V.episodic(spark, d), V.query_batch(spark, d), 20, 0.2).select("query_id", "id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("score"), "score"))


TOKENS = "greatest(1, length({0}) // 4)"


@query(
    RECALL
    + f""", run AS (SELECT *, {TOKENS.format('content')} AS t FROM scored),
before AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY query_id ORDER BY score DESC, pos, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM run),
packed AS (SELECT query_id, id, pos, score, CASE WHEN b + t > 500 THEN substr(content, 1, CAST((500 - b) * 4 - 3 AS BIGINT)) || '...' ELSE content END AS packed FROM before WHERE b < 500 OR b + t <= 500)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS out_pos, round(score, 6) AS score, {TOKENS.format('packed')} AS tokens, md5(packed) AS packed_md5 FROM packed"""
)
def recall_budgeted(spark: SparkSession, d: str) -> DataFrame:
    out = recall.recall(V.query_batch(spark, d), V.episodic(spark, d))
    return out.select("query_id", "id", F.col("out_pos").cast("bigint").alias("out_pos"), r6(F.col("score"), "score"), "tokens", F.md5("packed").alias("packed_md5"))


@query(f"""WITH {V.EPISODIC}, run AS (SELECT agent_id, id, content, importance, {TOKENS.format('content')} AS t FROM episodic),
before AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY agent_id ORDER BY importance DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM run)
SELECT agent_id, id, CAST(b AS BIGINT) AS before, CASE WHEN b + t > 1200 THEN length(substr(content, 1, CAST((1200 - b) * 4 - 3 AS BIGINT)) || '...') ELSE length(content) END AS n FROM before WHERE b < 1200 OR b + t <= 1200""")
def budget_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = V.episodic(spark, d).select("agent_id", "id", "content", "importance")
    return budget.fill(rows, 1200, [F.desc("importance"), "id"], by="agent_id").select("agent_id", "id", F.col("before").cast("bigint").alias("before"), F.length("packed").cast("bigint").alias("n"))


@query(f"WITH {V.FACTS} SELECT id, subject, predicate, object, valid_from, valid_until FROM facts")
def fact_supersede(spark: SparkSession, d: str) -> DataFrame:
    return facts.supersede(V.writes(spark, d)).select("id", "subject", "predicate", "object", "valid_from", "valid_until")


@query(f"WITH {V.FACTS} SELECT id, subject, predicate, object FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_until IS NULL OR TIMESTAMP '2024-01-15' <= valid_until)")
def facts_as_of(spark: SparkSession, d: str) -> DataFrame:
    return facts.supersede(V.writes(spark, d)).filter(facts.is_valid_at(F.lit("2024-01-15").cast("timestamp"))).select("id", "subject", "predicate", "object")


@query(f"WITH {V.FACTS}, f AS (SELECT *, max(CASE WHEN agent_id = 'agent 1' THEN 1 ELSE 0 END) OVER (PARTITION BY subject) AS has FROM facts WHERE valid_until IS NULL) SELECT id, subject, agent_id FROM f WHERE has = CASE WHEN agent_id = 'agent 1' THEN 1 ELSE 0 END")
def facts_own_or_any(spark: SparkSession, d: str) -> DataFrame:
    return facts.own_or_any(facts.supersede(V.writes(spark, d)), "agent 1").select("id", "subject", "agent_id")


@query(f"WITH {V.FACTS} SELECT id, object FROM facts WHERE valid_until IS NULL AND subject = 'user 7' AND agent_id = 'agent 1'")
def fact_subject_scan(spark: SparkSession, d: str) -> DataFrame:
    return facts.subject_scan(facts.supersede(V.writes(spark, d)), "user 7", True, "agent 1").select("id", "object")


def _bfs(depth: int) -> str:
    hops = "".join(f", h{i} AS (SELECT * FROM h{i-1} UNION ALL SELECT DISTINCT v, {i} FROM h{i-1} JOIN both_ways ON u = entity AND dist = {i-1} WHERE v NOT IN (SELECT entity FROM h{i-1}))" for i in range(1, depth + 1))
    return f"WITH {V.GRAPH}, h0 AS (SELECT 'NATION_7' AS entity, 0 AS dist WHERE 'NATION_7' IN (SELECT u FROM both_ways)){hops} "


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("NATION_7",)], "entity string")


@query(_bfs(1) + "SELECT entity, dist FROM h1")
def graph_reach_d1(spark: SparkSession, d: str) -> DataFrame:
    return facts.reach(V.graph(spark, d), _start(spark), 1).select("entity", "dist")


@query(_bfs(3) + "SELECT entity, dist FROM h3")
def graph_reach_d3(spark: SparkSession, d: str) -> DataFrame:
    return facts.reach(V.graph(spark, d), _start(spark), 3).select("entity", "dist")


@query(_bfs(1) + "SELECT id, subject, object FROM edges WHERE subject IN (SELECT entity FROM h1) OR object IN (SELECT entity FROM h1)")
def graph_traverse_d2(spark: SparkSession, d: str) -> DataFrame:
    return facts.traverse(V.graph(spark, d), _start(spark), 2).select("id", "subject", "object")


@query(f"WITH {V.GRAPH} SELECT u AS entity, count(DISTINCT v) AS n, md5(string_agg(DISTINCT v, ',' ORDER BY v)) AS neighbours_md5 FROM both_ways GROUP BY u")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return facts.neighbours(V.graph(spark, d)).select("entity", F.size("neighbours").cast("bigint").alias("n"), F.md5(F.array_join("neighbours", ",")).alias("neighbours_md5"))


@query(f"WITH {V.GRAPH} SELECT DISTINCT u AS entity FROM both_ways")
def graph_entities(spark: SparkSession, d: str) -> DataFrame:
    return facts.entities(V.graph(spark, d))


@query(f"WITH {V.GRAPH} SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(DISTINCT u) FROM both_ways) AS n_nodes")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return facts.graph_size(V.graph(spark, d))


@query(f"WITH {V.GRAPH} SELECT id, subject || ' ' || predicate || ' ' || object AS content FROM edges WHERE subject ILIKE '%n%_1%' OR predicate ILIKE '%n%_1%' OR object ILIKE '%n%_1%'")
def triple_text_search(spark: SparkSession, d: str) -> DataFrame:
    return facts.search_text(V.graph(spark, d), "N%_1").select("id", text.fact_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("content"))


@query(f"""WITH {V.PROCS} SELECT id, name, success_rate FROM procs WHERE (name ILIKE '%econ%' OR description ILIKE '%econ%' OR CAST(to_json(contexts) AS VARCHAR) ILIKE '%econ%') AND success_rate >= 0.5 AND agent_id = 'agent 1'""")
def procedure_search(spark: SparkSession, d: str) -> DataFrame:
    return procedures.by_context(V.procs(spark, d), "ECON", 0.5, "agent 1").select("id", "name", "success_rate")


@query(f"WITH {V.PROCS} SELECT id, name FROM procs WHERE name ILIKE '%blue %'")
def procedure_by_name(spark: SparkSession, d: str) -> DataFrame:
    return procedures.by_name(V.procs(spark, d), "blue ").select("id", "name")


@query(f"WITH {V.PROCS} SELECT id, created_at FROM procs WHERE agent_id = 'agent 2' ORDER BY created_at DESC, id LIMIT 50")
def procedure_listing(spark: SparkSession, d: str) -> DataFrame:
    return procedures.listing(V.procs(spark, d), "agent 2").select("id", "created_at")


STOP = "[" + ",".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
#: Distinct words in the order they first stand.
#: White space and word characters beyond ASCII too, for a regular expression engine whose own classes are ASCII.
SPACE, WORD_CHARS = "[\\s\\x0b\\x85\\p{{Z}}]+", "\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}"
WORDS = "list_filter(list_transform(regexp_split_to_array({0}, '" + SPACE + "'), lambda w: lower(trim(w, '?.!,;:''\"()'))), lambda w: length(w) >= 4 AND NOT list_contains(" + STOP + ", w))"
FIRST = "list_slice(list_filter({0}, lambda w, i: list_position({0}, w) = i), 1, 8)"
HINTS = ("how to check a blue WIDGET after the promo", "standard ring? what about Brand#1", "gizmo (small), gizmo; LARGE gear", "zz", "bolt")
HINT_ROWS = ", ".join(f"({i}, '{h}')" for i, h in enumerate(HINTS))
ASKED = f"asked(query_id, query) AS (VALUES {HINT_ROWS}), w AS (SELECT query_id, query, {WORDS.format('query')} AS ws FROM asked), kws AS (SELECT query_id, query, {FIRST.format('ws')} AS kws FROM w)"


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HINTS)), "query_id int, query string")


@query(f"""WITH {V.PROCS}, {ASKED}, terms AS (SELECT query_id, i AS kw_pos, t[i] AS kw FROM (SELECT query_id, CASE WHEN len(kws) > 0 THEN kws ELSE [query] END AS t FROM kws), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
hit AS (SELECT query_id, id, count(*) AS matches, min(kw_pos) AS first_hit, any_value(success_rate) AS success_rate, any_value(execution_count) AS execution_count FROM terms JOIN procs
  ON name ILIKE '%' || kw || '%' OR description ILIKE '%' || kw || '%' OR CAST(to_json(contexts) AS VARCHAR) ILIKE '%' || kw || '%' GROUP BY query_id, id)
SELECT query_id, id, matches, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, success_rate DESC, first_hit, execution_count DESC, id) AS pos FROM hit) WHERE pos <= 20""")
def procedure_ranked(spark: SparkSession, d: str) -> DataFrame:
    return procedures.best(V.procs(spark, d), _asked(spark), 20).select("query_id", "id", "matches", F.col("pos").cast("bigint").alias("pos"))


@query(f"WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents) SELECT doc_id, array_to_string({FIRST.format('ws')}, ' ') AS keywords FROM w")
def keyword_extraction(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH {V.PROCS} SELECT id, 'Procedure ''' || name || ''': ' || description || '. Steps: ' || array_to_string(list_transform(contexts, lambda c: 'check ' || c || CASE WHEN length(c) % 2 = 0 THEN ' (' || lower(c) || ')' ELSE '' END), ' → ') AS content FROM procs""")
def procedure_rendering(spark: SparkSession, d: str) -> DataFrame:
    return V.procs(spark, d).select("id", text.procedure_text(F.col("name"), F.col("description"), F.col("steps")).alias("content"))


@query(f"""WITH {V.PROCS}, o AS (SELECT user_id % 100 AS id, row_number() OVER (PARTITION BY user_id % 100 ORDER BY ts DESC, event_id DESC) - 1 AS b, CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS s FROM events),
f AS (SELECT id, sum(0.3::DOUBLE * pow(0.7::DOUBLE, b) * s) AS s, count(*) AS n FROM o GROUP BY id)
SELECT p.id, round(pow(0.7::DOUBLE, coalesce(n, 0)) * success_rate + coalesce(s, 0), 6) AS success_rate, execution_count + coalesce(n, 0) AS execution_count FROM procs p LEFT JOIN f ON f.id = p.id""")
def ema_success(spark: SparkSession, d: str) -> DataFrame:
    o = V.read(spark, d, "events").select((F.col("user_id") % 100).alias("id"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    return procedures.record_executions(V.procs(spark, d), o).select("id", r6(F.col("success_rate"), "success_rate"), "execution_count")


AGE = f"(epoch_us(TIMESTAMP '{V.NOW}') - epoch_us(created_at)) / 3.6e9"
DECAY = f"exp(-ln(2) / 168 * greatest(0, {AGE}))"


@query(f"WITH {V.EPISODIC} SELECT id, round({DECAY}, 9) AS decay_score FROM episodic")
def decay_scores(spark: SparkSession, d: str) -> DataFrame:
    hours = score.hours_between(F.col("accessed_at"), F.lit(V.NOW).cast("timestamp"))
    return V.episodic(spark, d).select("id", F.round(score.decay(hours), 9).alias("decay_score"))


@query(f"WITH {V.EPISODIC} SELECT id FROM episodic WHERE {DECAY} < 0.003")
def decay_evictions(spark: SparkSession, d: str) -> DataFrame:
    return maintain.decay_pass(V.episodic(spark, d), V.NOW, threshold=0.003)[1]


_VERBS = [(v, n) for v, n in text.STATEMENT_VERBS]
_SPO = lambda v: f"(?i)^(.*?)(\\w[\\w\\s]{{1,30}}?)\\s+({v})\\s+(.+)"
_CASE = lambda f: "CASE " + " ".join(f"WHEN regexp_matches(a, '{_SPO(v)}') THEN {f(v, n)}" for v, n in _VERBS) + " END"
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def plain(x: str) -> str:
    """SQL of a text of equal length where each word character beyond ASCII is a j, which stands in none of the patterns, and any other such character a #: what ASCII classes and word bounds match there, Unicode ones match in x."""
    return f"regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F{WORD_CHARS.format()}]', '#', 'g'), '[^\\x00-\\x7F]', 'j', 'g')"


DOCS = f"d AS (SELECT doc_id, doc_id AS id, source AS agent_id, doc_id % 3 AS k, coalesce(text, '') AS text FROM documents)"
STATEMENTS = f"""{DOCS},
s AS (SELECT id, agent_id, {_STRIP('unnest(regexp_split_to_array(text, $$[.!?\n]+$$))')} AS s FROM d),
a AS (SELECT *, {plain('s')} AS a FROM s WHERE length(s) >= 5),
m AS (SELECT *, {_CASE(lambda v, n: f"'{n}'")} AS predicate, {_CASE(lambda v, n: f"regexp_extract(a, '{_SPO(v)}', ['before', 'subject', 'verb', 'rest'])")} AS g FROM a),
o AS (SELECT id, agent_id, predicate, {_STRIP('substr(s, length(g.before) + 1, length(g.subject))')} AS subject, {_STRIP('substr(s, length(s) - length(g.rest) + 1)')} AS o FROM m WHERE predicate IS NOT NULL),
e AS (SELECT * EXCLUDE (o), {_STRIP("substr(o, 1, length(regexp_split_to_array(" + plain('o') + ", '(?i)[,;]|\\band\\b|\\bbut\\b')[1]))")} AS object FROM o),
st AS (SELECT * FROM e WHERE length(subject) BETWEEN 2 AND 50 AND length(object) BETWEEN 2 AND 80)"""


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """All documents, null texts as empty ones."""
    return V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("agent_id"), F.coalesce("text", F.lit("")).alias("content"))


@query(f"WITH {STATEMENTS} SELECT id, subject, predicate, object, count(*) AS n FROM st GROUP BY ALL")
def statement_extraction(spark: SparkSession, d: str) -> DataFrame:
    return maintain.extract_statements(_episodes(spark, d)).groupBy("id", "subject", "predicate", "object").agg(F.count("*").alias("n"))


@query(f"""WITH {STATEMENTS}, c AS (SELECT agent_id, count(*) AS episodes FROM d GROUP BY agent_id),
g AS (SELECT agent_id, lower(subject) AS subject, predicate, lower(object) AS object, count(*) AS n, count(DISTINCT id) AS sources FROM st GROUP BY ALL HAVING count(*) >= 2)
SELECT agent_id, subject, predicate, object, n, sources, round(least(1.0, n / greatest(1.0, episodes * 0.3::DOUBLE)), 6) AS confidence FROM g JOIN c USING (agent_id)""")
def consolidation(spark: SparkSession, d: str) -> DataFrame:
    return maintain.recurring_statements(_episodes(spark, d), None).select("agent_id", "subject", "predicate", "object", "n", F.size("source_episodes").cast("bigint").alias("sources"), r6(F.col("confidence"), "confidence"))


@query(f"""WITH {STATEMENTS}, g AS (SELECT agent_id, lower(subject) AS subject, predicate, lower(object) AS object, count(*) AS n FROM st GROUP BY ALL HAVING count(*) >= 2)
SELECT agent_id, subject, predicate, object, n FROM g WHERE length(subject) % 2 = 1 AND agent_id IS NOT NULL""")
def consolidation_new(spark: SparkSession, d: str) -> DataFrame:
    """Those of the recurring statements that no fact says yet; facts here say those of subjects of even length, in capitals."""
    found = maintain.recurring_statements(_episodes(spark, d), None)
    known = found.filter(F.length("subject") % 2 == 0).select("agent_id", "subject", "predicate", F.upper("object").alias("object"), F.lit(None).cast("timestamp").alias("valid_until"))
    return maintain.new_facts(found, known).select("agent_id", "subject", "predicate", "object", "n")


@query("SELECT source AS agent_id, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 10")
def consolidation_due(spark: SparkSession, d: str) -> DataFrame:
    return maintain.due_for_consolidation(V.read(spark, d, "documents").withColumnRenamed("source", "agent_id"))


WS = f"list_filter(regexp_split_to_array(text, '{SPACE.format()}'), lambda w: w <> '')"
_RX = lambda p: f"len(regexp_extract_all(text, '{p}'))"
PLAIN_DOCS = f"{DOCS}, p AS (SELECT *, {plain('text')} AS a FROM d)"


@query(f"""WITH {PLAIN_DOCS}, w AS (SELECT *, {WS} AS w FROM p)
SELECT doc_id, {TOKENS.format('text')} AS token_count, len(w) AS word_count,
  array_to_string(list_transform(list_slice(list_filter(list_slice(w, 2, len(w)), lambda x: regexp_matches(x, '^\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}') AND length(x) > 1), 1, 10), lambda x: trim(x, '.,!?;:"''')), ' ') AS entities,
  regexp_matches(text, '\\?\\s*$') OR regexp_matches(a, '(?i)\\b({text.QUESTION_WORDS})\\b') AS has_question, regexp_matches(a, '(?i)\\b({text.NEGATIONS.replace("'", "''")})\\b') AS has_negation FROM w""")
def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = _episodes(spark, d)
    m = rows.select(F.col("id").alias("doc_id"), text.text_metadata(F.col("content")).alias("m")).select("doc_id", "m.*")
    return m.withColumn("entities", F.array_join("entities", " "))


TECH = "[" + ",".join(f"'{w}'" for w in score.TECH_TERMS) + "]"
HIGH_N, LOW_N = (f"len(regexp_extract_all(a, '{p}'))" for p in (score.HIGH, score.LOW))
KIND = "CASE k WHEN 0 THEN {0} WHEN 1 THEN {1} ELSE {2} END"


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("episodic", "semantic", "procedural"))), (F.col("id") % 3 + 1).cast("int"))
    return _episodes(spark, d).select(F.col("id").alias("doc_id"), "content", kind.alias("memory_type"), (F.col("id") % 7).alias("access_count"), (F.col("id") % 60).cast("double").alias("recency_hours"))


#: SQL of the features, unrounded, over w: a document's words, their number n, its plain text a.
FEATURE_SQL = {
    "type_norm": KIND.format("0.0", "0.5", "1.0") + "::DOUBLE",
    "length": "n / 100",
    "has_version": "regexp_matches(text, 'v\\d+\\.\\d+')::INT::DOUBLE",
    "has_metric": f"regexp_matches(a, '{score.METRIC}')::INT::DOUBLE",
    "high_kw": f"least(1, {HIGH_N} / 5.0::DOUBLE)",
    "low_kw": f"least(1, {LOW_N} / 5.0::DOUBLE)",
    "entity_density": "least(1, len(list_filter(w, lambda x: regexp_full_match(x, '\\p{Lu}\\p{L}+'))) / n)",
    "specificity": "least(1, len(list_filter(w, lambda x: regexp_matches(x, '\\p{Nd}'))) / n)",
    "tech_density": f"least(1, len(list_filter(w, lambda x: list_contains({TECH}, regexp_replace(lower(x), '[.,;:()]+$', '')))) / 5.0::DOUBLE)",
    "access_log": "ln(1 + doc_id % 7)",
    "recency_decay": "exp(-(doc_id % 60) / 48.0::DOUBLE)",
}
FEATURE_ROWS = f"{PLAIN_DOCS}, w AS (SELECT *, {WS} AS w, greatest(1, len({WS}))::DOUBLE AS n FROM p)"


@query(f"WITH {FEATURE_ROWS} SELECT doc_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in FEATURE_SQL.items()) + " FROM w")
def importance_features(spark: SparkSession, d: str) -> DataFrame:
    f = importance.features(_typed(spark, d), 0.0)
    return f.select("doc_id", *(F.round(F.element_at("features", i + 1), 6).alias(n) for i, n in enumerate(score.FEATURES)))


#: A model with weights of our own, to hold its predictions against SQL.
FIXED_MODEL = importance.ImportanceModel([0.04, 0.03, 0.02, 0.05, 0.11, -0.07, 0.013, 0.021, 0.06, 0.09, 0.017], 0.43, [0.5, 0.9, 0.01, 0.02, 0.03, 0.05, 0.1, 0.04, 0.02, 1.1, 0.5], [0.4, 1.3, 0.1, 0.2, 0.3, 0.4, 0.2, 0.1, 0.3, 0.7, 0.3])
_PREDICTED = " + ".join([repr(FIXED_MODEL.intercept) + "::DOUBLE", *(f"(({e}) - {m!r}::DOUBLE) / {d!r}::DOUBLE * {c!r}::DOUBLE" for e, m, d, c in zip(FEATURE_SQL.values(), FIXED_MODEL.mean, FIXED_MODEL.std, FIXED_MODEL.coef))])


@query(f"WITH {FEATURE_ROWS} SELECT doc_id, round(least(1, greatest(0, {_PREDICTED})), 6) AS score FROM w")
def importance_predicted(spark: SparkSession, d: str) -> DataFrame:
    f = importance.features(_typed(spark, d), 0.0)
    return f.select("doc_id", r6(FIXED_MODEL.predict(F.col("features")), "score"))


HEUR = f"""least(1, greatest(0, {KIND.format('0.4', '0.55', '0.6')}::DOUBLE + least(0.25, {HIGH_N} * 0.05::DOUBLE) - least(0.15, {LOW_N} * 0.03::DOUBLE)
  + CASE WHEN doc_id % 7 <= 0 THEN 0 ELSE least(0.15, 0.05 * ln(1 + doc_id % 7)) END + CASE WHEN doc_id % 60 <= 0 THEN 0.05 WHEN doc_id % 60 >= 48 THEN 0 ELSE 0.05 * (1 - (doc_id % 60) / 48.0::DOUBLE) END))"""


@query(f"WITH {PLAIN_DOCS} SELECT doc_id, round({HEUR}, 6) AS score FROM p")
def importance_heuristic(spark: SparkSession, d: str) -> DataFrame:
    t = _typed(spark, d)
    return t.select("doc_id", r6(score.heuristic_importance(F.col("content"), F.col("memory_type"), F.col("access_count"), F.col("recency_hours")), "score"))


@query()
def importance_model(spark: SparkSession, d: str) -> DataFrame:
    """A ridge model of the quality labels, applied to all texts; the tests hold it against a closed form on the driver."""
    t = _typed(spark, d)
    y = V.read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("importance"))
    model = importance.train(t.join(y, "doc_id"))
    return importance.scored(t, model).select("doc_id", F.round("score", 4).alias("score"))


@query(f"""WITH {V.EPISODIC}, {V.FACTS}, {V.PROCS}, u AS (SELECT 'episodic' AS store FROM episodic UNION ALL SELECT 'semantic' FROM facts WHERE valid_until IS NULL UNION ALL SELECT 'procedural' FROM procs)
SELECT coalesce(store, 'total') AS store, count(*) AS n FROM u GROUP BY ROLLUP (store)""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.stats(V.episodic(spark, d), facts.supersede(V.writes(spark, d)), V.procs(spark, d))


@query(f"WITH {V.EPISODIC}, {V.FACTS}, {V.PROCS}, u AS (SELECT 'episodic' AS store FROM episodic WHERE agent_id = 'src1' UNION ALL SELECT 'semantic' FROM facts WHERE valid_until IS NULL AND agent_id = 'src1' UNION ALL SELECT 'procedural' FROM procs WHERE agent_id = 'src1') SELECT coalesce(store, 'total') AS store, count(*) AS n FROM u GROUP BY ROLLUP (store)")
def episodic_counts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one agent."""
    return maintain.stats(V.episodic(spark, d), facts.supersede(V.writes(spark, d)), V.procs(spark, d), "src1")


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = V.read(spark, d, "events")
    return e.select(F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.lit("episodic").alias("store"), (F.col("user_id") % 300).alias("id"), "event_id", "value")


LOG = "log AS (SELECT *, user_id % 300 AS id, row_number() OVER (PARTITION BY user_id % 300 ORDER BY ts DESC, event_id DESC) AS r FROM events)"


@query(f"WITH {LOG} SELECT id, event_id, round(value, 6) AS value FROM log WHERE r = 1 AND event_type <> 'error'")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    return maintain.latest(_log(spark, d), "episodic").select("id", "event_id", r6(F.col("value"), "value"))


@query(f"WITH {V.EPISODIC} SELECT id FROM episodic WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def tombstones(spark: SparkSession, d: str) -> DataFrame:
    gone = V.read(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    return maintain.without(V.episodic(spark, d), gone).select("id")


@query(f"""WITH {V.EPISODIC} SELECT e.id, coalesce(CAST(l.quality AS DOUBLE), importance) AS importance, CASE WHEN l.quality IS NULL THEN lang ELSE 'q' || l.quality END AS k, agent_id AS source, CAST(l.toxic AS VARCHAR) AS toxic
FROM episodic e LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = e.id""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    """A column, and keys of the metadata: one that is there already, one that is not, one that stays."""
    u = V.read(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("toxic"))
    u = u.select("id", F.col("q").cast("double").alias("importance"), F.to_json(F.struct(F.concat(F.lit("q"), F.col("q")).alias("k"), "toxic")).alias("metadata"))
    base = V.episodic(spark, d).withColumn("metadata", F.to_json(F.struct(F.col("lang").alias("k"), F.col("agent_id").alias("source"))))
    out = maintain.update_columns(base, u, ["importance"])
    return out.select("id", "importance", *(F.get_json_object("metadata", f"$.{k}").alias(k) for k in ("k", "source", "toxic")))


@query(f"WITH {V.EPISODIC} SELECT id, created_at AS accessed_at, round(decay_score, 6) AS decay_score FROM episodic ORDER BY created_at, id LIMIT 50 OFFSET 30")
def scan_page(spark: SparkSession, d: str) -> DataFrame:
    return maintain.page(V.episodic(spark, d), 50, 30).select("id", "accessed_at", r6(F.col("decay_score"), "decay_score"))


_H = {s: f"len(regexp_extract_all(text, '(?i)\\b({h})\\b'))" for s, h in text.INTENT_HINTS.items()}


@query(f"""WITH h AS (SELECT conv_id, turn, {_H['episodic']} AS e, {_H['semantic']} AS s, {_H['procedural']} AS p FROM conversations),
l AS (SELECT *, list_sort([{{'n': -e, 'i': 0, 's': 'episodic'}}, {{'n': -s, 'i': 1, 's': 'semantic'}}, {{'n': -p, 'i': 2, 's': 'procedural'}}]) AS l FROM h)
SELECT conv_id, turn, e AS n_episodic, s AS n_semantic, p AS n_procedural, CASE WHEN e + s + p = 0 THEN 'episodic,semantic' ELSE array_to_string(list_transform(list_filter(l, lambda x: x.n < 0), lambda x: x.s), ',') END AS routed FROM l""")
def intent_route(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "conversations").withColumn("types", F.array(F.lit("episodic"), F.lit("semantic")))
    hits = [text.intent_hits(F.col("text"), s).alias(f"n_{s}") for s in text.INTENT_HINTS]
    return recall.route(c, "text").select("conv_id", "turn", *hits, F.array_join("routed", ",").alias("routed"))


FIELDS = {"page": metadata_schema.Field("str", required=True), "k": metadata_schema.Field("bool"), "missing": metadata_schema.Field("str", required=True), "defaulted": metadata_schema.Field("str", required=True, default="x")}


@query("""SELECT event_id, array_to_string(list_filter([
  CASE WHEN json_type(props, '$.page') IS NULL THEN 'metadata.page: required field missing' WHEN json_type(props, '$.page') <> 'VARCHAR' THEN 'metadata.page: expected str, got ' || t(json_type(props, '$.page')) END,
  CASE WHEN json_type(props, '$.k') IS NOT NULL AND json_type(props, '$.k') <> 'BOOLEAN' THEN 'metadata.k: expected bool, got ' || t(json_type(props, '$.k')) END,
  CASE WHEN json_type(props, '$.missing') IS NULL THEN 'metadata.missing: required field missing' END], lambda x: x IS NOT NULL), '; ') AS errors FROM events""".replace("t(json_type(props, '$.page'))", "CASE json_type(props, '$.page') WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'NoneType' END").replace("t(json_type(props, '$.k'))", "CASE json_type(props, '$.k') WHEN 'VARCHAR' THEN 'str' WHEN 'DOUBLE' THEN 'float' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' ELSE 'NoneType' END"))
def metadata_validation(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "events").select("event_id", F.array_join(metadata_schema.field_errors(F.col("props"), FIELDS), "; ").alias("errors"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.priority'), '0') AS priority, json_extract_string(props, '$.k') AS site, true AS moved FROM events""")
def metadata_backfill(spark: SparkSession, d: str) -> DataFrame:
    m = metadata_schema.Migration("a", 1).add("priority", metadata_schema.Field("int", default=0)).rename("k", "site")
    out = V.read(spark, d, "events").select("event_id", "props", m.backfill(F.col("props")).alias("m"))
    return out.select("event_id", F.get_json_object("m", "$.priority").alias("priority"), F.get_json_object("m", "$.site").alias("site"), F.get_json_object("m", "$.k").isNull().alias("moved"))


@query(f"""WITH {V.GRAPH}, first AS (SELECT entity FROM (SELECT DISTINCT u AS entity FROM both_ways) ORDER BY entity LIMIT 20), q(query_id, agent, b) AS (VALUES (0, 'agent 0', 40), (1, 'agent 1', 15), (2, 'nobody', 100)),
f AS (SELECT q.query_id, q.b, e.*, subject || ' ' || predicate || ' ' || object AS content, (e.agent_id = q.agent)::INT AS own, max((e.agent_id = q.agent)::INT) OVER (PARTITION BY q.query_id, subject) AS any_ FROM edges e, q WHERE subject IN (SELECT entity FROM first)),
l AS (SELECT query_id, any_value(b) AS b, list({{'c': content, 't': {TOKENS.format('content')}}} ORDER BY subject, confidence DESC, id) AS l FROM f WHERE own = any_ GROUP BY query_id),
z AS (SELECT query_id, list_reduce(l, lambda a, x: CASE WHEN a.used + x.t <= b THEN {{'used': a.used + x.t, 'taken': list_append(a.taken, x.c)}} ELSE a END, {{'used': 0::BIGINT, 'taken': []::VARCHAR[]}}) AS z FROM l)
SELECT query_id, z.used AS used, array_to_string(z.taken, '; ') AS taken FROM z""")
def context_facts(spark: SparkSession, d: str) -> DataFrame:
    q = spark.createDataFrame([(0, "agent 0", 40), (1, "agent 1", 15), (2, "nobody", 100)], "query_id int, agent string, l1_budget int")
    return recall.pack_facts(V.graph(spark, d), q).select("query_id", "used", F.array_join("taken", "; ").alias("taken"))


#: Queries that name a nation, and procedures of the sources for some nations: all three stores have answers.
THREE_STORES = f"""{V.EPISODIC}, {V.QUERIES}, {V.GRAPH}, {V.PROCS}, asked AS (SELECT query_id, 'NATION_' || (5 + query_id % 5) AS query, vec, agent FROM queries),
own AS (SELECT id, name, description || ' for NATION_' || (5 + id // 20 % 5) AS description, 'src' || (id % 20) AS agent_id, success_rate, execution_count, contexts FROM procs)"""
PROCEDURE_TEXT = "'Procedure ''' || name || ''': ' || description || '. Steps: ' || array_to_string(list_transform(contexts, lambda c: 'check ' || c || CASE WHEN length(c) % 2 = 0 THEN ' (' || lower(c) || ')' ELSE '' END), ' → ')"


def _recalled(n: str, q: str, k: int, semantic: bool) -> str:
    """Tables, the last called n: what the stores recall for the queries of q, within its budget."""
    holds = lambda *cs: " OR ".join(f"{c} ILIKE '%' || query || '%'" for c in cs)
    order = "PARTITION BY query_id ORDER BY score DESC, so, pos, id"
    facts_ = f"UNION ALL SELECT query_id, 'semantic', 1, row_number() OVER (PARTITION BY query_id ORDER BY e.id), e.id, subject || ' ' || predicate || ' ' || object, confidence FROM {q} q JOIN edges e ON {holds('subject', 'predicate', 'object')}" if semantic else ""
    packed = "CASE WHEN b + t > budget THEN substr(content, 1, CAST((budget - b) * 4 - 3 AS BIGINT)) || '...' ELSE content END"
    return f"""{n}_h AS (SELECT q.query_id, e.*, {DIST} AS dist FROM {q} q JOIN episodic e ON e.embedding IS NOT NULL AND (e.agent_id = q.agent OR e.scope IN ('team','org'))),
{n}_near AS (SELECT *, importance * decay_score AS eff FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM {n}_h) WHERE r <= {k}),
{n}_pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, dist, id) AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM {n}_near),
{n}_p AS (SELECT query_id, o.id, success_rate, row_number() OVER (PARTITION BY query_id ORDER BY success_rate DESC, execution_count DESC, o.id) AS pos, {PROCEDURE_TEXT} AS content FROM {q} q JOIN own o ON o.agent_id = q.agent AND ({holds('name', 'description', 'CAST(to_json(contexts) AS VARCHAR)')})),
{n}_c AS (SELECT query_id, 'episodic' AS store, 0 AS so, pos, CAST(id AS VARCHAR) AS id, content, 0.8 * eff + 0.2 * (1 - (pos - 1)::DOUBLE / greatest(1, n)) AS score FROM {n}_pos {facts_} UNION ALL SELECT query_id, 'procedural', 2, pos, CAST(id AS VARCHAR), content, success_rate FROM {n}_p WHERE pos <= 1),
{n}_t AS (SELECT c.*, q.budget, {TOKENS.format('content')} AS t FROM {n}_c c JOIN {q} q USING (query_id)),
{n}_b AS (SELECT *, coalesce(sum(t) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {n}_t),
{n} AS (SELECT query_id, store, id, row_number() OVER ({order}) AS out_pos, {TOKENS.format(packed)} AS tokens FROM {n}_b WHERE b < budget OR b + t <= budget)"""


def _stores(spark: SparkSession, d: str, types: tuple[str, ...], budget_: int) -> dict:
    q = V.query_batch(spark, d, budget_, types).withColumn("query", F.concat(F.lit("NATION_"), 5 + F.col("query_id") % 5))
    p = V.procs(spark, d).withColumn("agent_id", F.concat(F.lit("src"), F.col("id") % 20)).withColumn("description", F.expr("concat(description, ' for NATION_', 5 + id div 20 % 5)"))
    return {"queries": q, "episodic": V.episodic(spark, d), "triples": V.graph(spark, d), "procs": p}


@query(f"WITH {THREE_STORES}, q AS (SELECT *, 800 AS budget FROM asked), {_recalled('r', 'q', 20, True)} SELECT * FROM r")
def recall_three_stores(spark: SparkSession, d: str) -> DataFrame:
    out = recall.recall(**_stores(spark, d, ("episodic", "semantic", "procedural"), 800))
    return out.select("query_id", "store", F.col("id").cast("string").alias("id"), F.col("out_pos").cast("bigint").alias("out_pos"), "tokens")


IDENTITY = "I am a planner."
_IDENTITY_TOKENS = TOKENS.format(f"'{IDENTITY}'")


@query(f"""WITH {THREE_STORES}, q AS (SELECT *, 1000 - {_IDENTITY_TOKENS} AS left0 FROM asked), first AS (SELECT entity FROM (SELECT DISTINCT u AS entity FROM both_ways) ORDER BY entity LIMIT 20),
f AS (SELECT q.query_id, least(200, left0) AS b, e.*, subject || ' ' || predicate || ' ' || object AS content, (e.agent_id = q.agent)::INT AS own, max((e.agent_id = q.agent)::INT) OVER (PARTITION BY q.query_id, subject) AS any_ FROM edges e, q WHERE subject IN (SELECT entity FROM first)),
l AS (SELECT query_id, any_value(b) AS b, list({{'c': content, 't': {TOKENS.format('content')}}} ORDER BY subject, confidence DESC, id) AS l FROM f WHERE own = any_ GROUP BY query_id),
z AS (SELECT query_id, list_reduce(l, lambda a, x: CASE WHEN a.used + x.t <= b THEN {{'used': a.used + x.t, 'taken': list_append(a.taken, x.t)}} ELSE a END, {{'used': 0::BIGINT, 'taken': []::BIGINT[]}}) AS z FROM l),
t1 AS (SELECT query_id, unnest(range(1, len(z.taken) + 1)) AS pos, unnest(z.taken) AS tokens FROM z),
q1 AS (SELECT q.*, left0 - coalesce(z.used, 0) AS left1 FROM q LEFT JOIN z USING (query_id)), q2 AS (SELECT *, least(500, left1) AS budget FROM q1 WHERE least(500, left1) > 0), {_recalled('t2', 'q2', 20, False)},
q3 AS (SELECT * FROM (SELECT q1.*, left1 - coalesce((SELECT sum(tokens) FROM t2 WHERE t2.query_id = q1.query_id), 0) AS budget FROM q1) WHERE budget > 50), {_recalled('t3', 'q3', 50, True)}
SELECT query_id, 0 AS tier, 1 AS pos, {_IDENTITY_TOKENS} AS tokens FROM q UNION ALL SELECT query_id, 1, pos, tokens FROM t1 UNION ALL SELECT query_id, 2, out_pos, tokens FROM t2
UNION ALL SELECT query_id, 3, out_pos, tokens FROM t3 WHERE NOT EXISTS (SELECT 1 FROM t2 WHERE t2.query_id = t3.query_id AND t2.id = t3.id)""")
def context_tiers(spark: SparkSession, d: str) -> DataFrame:
    s = _stores(spark, d, ("episodic",), 1000)
    return recall.context(s["queries"], s["episodic"], s["triples"], s["procs"], 3, IDENTITY, Config()).select("query_id", "tier", F.col("pos").cast("bigint").alias("pos"), "tokens")


@query()
def vector_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    e = V.episodic(spark, d).select("id", "embedding")
    return search.nearest_approximate(e, V.query_batch(spark, d).select("query_id", "vec"), 10).select("query_id", "id", r6(F.col("dist"), "dist"))


@query("""WITH e AS (SELECT item_id, text, list_slice(regexp_split_to_array(text, '\\s+'), 1, 5) AS expected FROM benchmark)
SELECT e.item_id, d.doc_id, round(len(list_filter(expected, lambda k: contains(lower(d.text), lower(k))))::DOUBLE / len(expected), 6) AS score FROM e, documents d""")
def eval_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item against every document."""
    e = V.read(spark, d, "benchmark").select("item_id", F.slice(F.split("text", r"\s+"), 1, 5).alias("expected"))
    docs = V.read(spark, d, "documents").select("doc_id", "text")
    return evaluate.keyword_scores(docs, e).select("item_id", "doc_id", r6(F.col("score"), "score"))


_W = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '" + SPACE + "'), lambda w: w <> ''))"
PAIR = f"p AS (SELECT a.conv_id, a.turn, a.role, coalesce(a.text, '') AS answer, coalesce(b.text, '') AS expected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
OVERLAP = f"SELECT *, CASE WHEN len({_W.format('expected')}) = 0 THEN 0 ELSE len(list_intersect({_W.format('expected')}, {_W.format('answer')}))::DOUBLE / len({_W.format('expected')}) END AS overlap, (trim(regexp_replace(lower(answer), '[^{WORD_CHARS.format()}\\p{{Pc}}\\s\\p{{Z}}]', '', 'g')) = trim(regexp_replace(lower(expected), '[^{WORD_CHARS.format()}\\p{{Pc}}\\s\\p{{Z}}]', '', 'g')))::INT::DOUBLE AS exact FROM p"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    c = V.read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    return c.withColumnRenamed("text", "answer").join(b, ["conv_id", "turn"]).withColumn("overlap", evaluate.token_overlap(F.col("answer"), F.col("expected"))).withColumn("exact", evaluate.exact_match(F.col("answer"), F.col("expected")))


@query(f"WITH {PAIR} SELECT conv_id, turn, round(overlap, 6) AS overlap, exact FROM ({OVERLAP})")
def eval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("conv_id", "turn", r6(F.col("overlap"), "overlap"), "exact")


@query(f"WITH {PAIR} SELECT coalesce(role, 'overall') AS role, count(*) AS n, round(avg(overlap), 6) AS avg_overlap, round(median(overlap), 6) AS median_overlap FROM ({OVERLAP}) GROUP BY ROLLUP (role)")
def eval_averages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.averages(_turns(spark, d), "role", "overlap").select("role", "n", r6(F.col("avg_overlap"), "avg_overlap"), r6(F.col("median_overlap"), "median_overlap"))


@query(f"""WITH q AS (SELECT item_id AS query_id, {_W.format('text')} AS w FROM benchmark), m AS (SELECT doc_id AS id, unnest({_W.format('text')}) AS word FROM documents),
qq AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q), s AS (SELECT query_id, id, count(*)::DOUBLE / any_value(n) AS overlap FROM qq JOIN m USING (word) GROUP BY ALL HAVING count(*)::DOUBLE / any_value(n) >= 0.1)
SELECT query_id, id, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) AS r FROM s) WHERE r = 1""")
def eval_best_overlap(spark: SparkSession, d: str) -> DataFrame:
    q = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    m = V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return evaluate.best_by_overlap(q, m).select("query_id", "id", r6(F.col("overlap"), "overlap"))


@query("SELECT event_type AS kind, count(*) AS n, count(*) FILTER (value > 100) AS ok, round(count(*) FILTER (value > 100)::DOUBLE / count(*), 6) AS rate FROM events GROUP BY event_type")
def eval_rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rates(V.read(spark, d, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 100).alias("ok"))).withColumn("rate", F.round("rate", 6))


@query("""WITH h AS (SELECT doc_id, sha1(source || '/' || lang || '/docs/' || doc_id) AS h FROM documents) SELECT doc_id,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9' WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS item_id FROM h""")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "documents").select("doc_id", text.item_id(F.col("source"), F.array("lang", F.lit("docs")), F.col("doc_id").cast("string")).alias("item_id"))


@query("""WITH i AS (SELECT doc_id, [source, lang, CAST(doc_id % 3 AS VARCHAR)] AS ns FROM documents), g AS (SELECT list_slice(ns, 1, 2) AS ns, min(doc_id) AS first FROM i WHERE ns[3] = '1' GROUP BY 1)
SELECT array_to_string(ns, '/') AS namespace, first FROM g""")
def namespace_listing(spark: SparkSession, d: str) -> DataFrame:
    i = V.read(spark, d, "documents").select(F.array("source", "lang", (F.col("doc_id") % 3).cast("string")).alias("namespace"), F.col("doc_id").alias("created_at"), F.col("doc_id").alias("id"))
    return adapters.namespaces(i, suffix=("1",), max_depth=2).select(F.array_join("namespace", "/").alias("namespace"), F.col("first.id").alias("first"))


@query(f"""WITH {V.EPISODIC}, {V.QUERIES}, h AS (SELECT query_id, id, {DIST} AS dist FROM queries q JOIN episodic e ON e.embedding IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM h)
SELECT query_id, id, round(1 - dist, 6) AS relevance FROM r WHERE r <= 5 AND (1 - dist >= 0.7 OR r = 1)""")
def relevance_floor(spark: SparkSession, d: str) -> DataFrame:
    hits = search.nearest(V.episodic(spark, d).select("id", "embedding"), V.query_batch(spark, d).select("query_id", "vec"), 5).withColumn("relevance", 1 - F.col("dist"))
    return adapters.relevance_floor(hits, 0.7).select("query_id", "id", r6(F.col("relevance"), "relevance"))


@query(f"WITH {V.EPISODIC}, v AS (SELECT id, list_sum(list_transform(embedding, lambda x: x * x)) AS s FROM episodic) SELECT id, round(sqrt(s), 6) AS norm FROM v")
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return V.episodic(spark, d).select("id", r6(vector.norm(F.col("embedding")), "norm"))


@query(f"WITH {V.EPISODIC} SELECT id, access_count + 1 AS access_count, TIMESTAMP '{V.NOW}' AS accessed_at FROM episodic")
def touched(spark: SparkSession, d: str) -> DataFrame:
    return maintain.touch(V.episodic(spark, d), F.lit(V.NOW).cast("timestamp")).select("id", "access_count", "accessed_at")


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t, text FROM documents) SELECT doc_id, t AS tokens, md5(CASE WHEN t <= 50 THEN text ELSE substr(text, 1, 197) || '...' END) AS cut, t <= 50 AS fits, greatest(0, 50 - t) AS remaining, round(least(1, t / 50.0::DOUBLE), 6) AS used FROM t")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    t = text.count_tokens(F.col("text"))
    return V.read(spark, d, "documents").select("doc_id", t.alias("tokens"), F.md5(text.truncate_to_budget(F.col("text"), F.lit(50))).alias("cut"), text.fits_budget(F.col("text"), F.lit(50)).alias("fits"), score.budget_remaining(F.lit(50), t).alias("remaining"), r6(score.budget_utilisation(F.lit(50), t), "used"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0.6 ELSE 0.5 END::DOUBLE AS importance FROM conversations")
def role_importance(spark: SparkSession, d: str) -> DataFrame:
    return V.read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.lit(adapters.role_importance("user"))).otherwise(F.lit(adapters.role_importance(""))).alias("importance"))


@query(f"SELECT d.doc_id, round(CASE WHEN {TOKENS.format('text')} > 0 THEN l.quality::DOUBLE / {TOKENS.format('text')} ELSE 0 END, 9) AS density FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def eval_density(spark: SparkSession, d: str) -> DataFrame:
    """Quality a token."""
    q = V.read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    return V.read(spark, d, "documents").join(q, "doc_id").select("doc_id", F.round(evaluate.density(F.col("quality"), text.count_tokens(F.col("text"))), 9).alias("density"))


@query(f"""WITH {V.EPISODIC}, {V.QUERIES}, h AS (SELECT query_id, id, {DIST} AS dist FROM queries q JOIN episodic e ON e.embedding IS NOT NULL)
SELECT query_id, id, round(1 / (1 + dist), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS r FROM h) WHERE r <= 3""")
def eval_distance_scores(spark: SparkSession, d: str) -> DataFrame:
    hits = search.nearest(V.episodic(spark, d).select("id", "embedding"), V.query_batch(spark, d).select("query_id", "vec"), 3)
    return hits.select("query_id", "id", r6(evaluate.distance_score(F.col("dist")), "score"))


@query("SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming counts by window, over a table that is all there."""
    return online.windowed_counts(V.read(spark, d, "events"), "ts", "event_type").select(F.col("window.start").alias("began"), "event_type", "n")
