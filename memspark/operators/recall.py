"""Recall and context assembly over the three stores, for batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import sizes
from ..functions import score, text
from ..schemas import Config
from . import budget, facts, procedures, search

#: Ties between stores fall in this order.
STORE_ORDER = {"episodic": 0, "semantic": 1, "procedural": 2}
#: Nearest memories that tier 2 of a context is packed from.
L2_RESULTS = 20
CANDIDATE = ["query_id", "store", "store_order", "pos", "id", "content", "score"]


def route(queries: DataFrame, query_col: str = "query", types_col: str = "types") -> DataFrame:
    """Adds routed: the stores whose hint words occur, most hits first; types as asked where one is asked or none occurs."""
    hits = [F.struct((-text.intent_hits(F.col(query_col), s)).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for s, i in STORE_ORDER.items()]
    some = F.filter(F.array_sort(F.array(*hits)), lambda x: x.n < 0)
    return queries.withColumn("routed", F.when((F.size(types_col) == 1) | (F.size(some) == 0), F.col(types_col)).otherwise(F.transform(some, lambda x: x.s)))


def explain_route(queries: DataFrame, query_col: str = "query", types_col: str = "types") -> DataFrame:
    """(query_id, stores, reasoning): which stores a query goes to, and which words say so."""
    routed = route(queries, query_col, types_col)
    why = {"episodic": "temporal words", "semantic": "words of facts and relations", "procedural": "words of workflows"}
    parts = F.array_compact(F.array(*(F.when(F.array_contains("routed", s) & (text.intent_hits(F.col(query_col), s) > 0), F.lit(f"{s}: {w}")) for s, w in why.items())))
    return routed.select("query_id", F.col("routed").alias("stores"), F.when(F.size(parts) == 0, F.lit("no strong signal: all stores asked for")).otherwise(F.array_join(parts, "; ")).alias("reasoning"))


def episodic_hits(episodic: DataFrame, queries: DataFrame, k: int, min_importance: float = 0.0, start=None, end=None, ann_threshold: int | None = None) -> DataFrame:
    """(query_id, id, importance, decay_score, dist, near_rank, _key, _nth, content) of the nearest k a query may see. From ann_threshold candidates on they are found approximately.

    Texts do not take part in the search: they are fetched for what was found. Rows of one id are told apart by
    their other columns.
    """
    found = episodic
    if min_importance > 0:
        found = found.filter(F.col("importance") >= min_importance)
    if start is not None:
        found = found.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        found = found.filter(F.col("created_at") <= F.lit(end))
    slim = ("id", "agent_id", "scope", "importance", "decay_score", "embedding")
    own = found.select(*slim)
    asked = queries.select("query_id", "vec", F.col("agent").alias("_agent"), F.col("asked_scope") if "asked_scope" in queries.columns else F.lit(None).cast("string").alias("asked_scope"))
    hits = search.find(own.withColumn("_key", F.xxhash64(*slim)), asked, k, search.visible(F.col("_agent"), F.col("asked_scope")), ann_threshold)
    hits = hits.withColumn("_nth", F.row_number().over(W.partitionBy("query_id", "_key").orderBy("near_rank"))).select("query_id", "id", "importance", "decay_score", "dist", "near_rank", "_key", "_nth").persist()
    ids = sizes.few(hits.select(F.col("id").alias("_id")).distinct(), queries, k)
    shown = found.select(*slim, "content").join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    shown = shown.select(F.xxhash64(*slim).alias("_key"), "content").withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy("content")))
    return hits.join(shown, ["_key", "_nth"])


def episodic_candidates(episodic: DataFrame, queries: DataFrame, k: int, alpha: float, min_importance: float = 0.0, start=None, end=None, ann_threshold: int | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Nearest k a query may see, scored by effective importance and rank. Queries: query_id, vec, agent, scope. hits: of episodic_hits, for these queries and others, and k or more."""
    if hits is None:
        hits = episodic_hits(episodic, queries, k, min_importance, start, end, ann_threshold)
    else:
        hits = hits.filter(F.col("near_rank") <= k).join(queries.select("query_id"), "query_id", "left_semi")
    hits = search.ranked_by_importance(hits)
    n = F.count("*").over(W.partitionBy("query_id"))
    blended = score.blended(F.col("eff"), score.rank_relevance(F.col("pos") - 1, n), alpha)
    return hits.withColumn("score", blended).select("query_id", F.lit("episodic").alias("store"), F.lit(0).alias("store_order"), "pos", "id", "content", "score")


def semantic_candidates(triples: DataFrame, queries: DataFrame, most: str | None = None) -> DataFrame:
    """Open facts that hold the whole query text, of any agent, by their confidence. most: a column of queries; a query gets so many of its first by score.

    Equal texts of queries are looked up once.
    """
    e = facts.edges(triples).select("id", "subject", "predicate", "object", "confidence")
    texts = queries.groupBy(F.col("query").alias("_q")).agg((F.max(most) if most else F.lit(None).cast("int")).alias("_most"))
    hit = text.like_everywhere(F.col("_q"), F.col("subject"), F.col("predicate"), F.col("object"))
    found = sizes.join_blocks(e, texts, hit, key="_q").withColumn("pos", F.row_number().over(W.partitionBy("_q").orderBy("id")))
    if most:
        found = found.withColumn("_r", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("confidence"), "pos"))).filter("_r <= _most")
    found = sizes.join_blocks(found, queries.select("query_id", F.col("query").alias("_text")), F.col("_q") == F.col("_text"))
    return found.select("query_id", F.lit("semantic").alias("store"), F.lit(1).alias("store_order"), "pos", "id", text.fact_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("content"), F.col("confidence").alias("score"))


def procedural_candidates(procs: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    best = sizes.few(procedures.best(procs, queries, most, agent_col="agent"), queries, most)
    shown = procs.select("id", text.procedure_text(F.col("name"), F.col("description"), F.col("steps")).alias("content"))
    return shown.join(best, "id").select("query_id", F.lit("procedural").alias("store"), F.lit(2).alias("store_order"), "pos", "id", "content", F.col("success_rate").alias("score"))


def recall(queries: DataFrame, episodic: DataFrame | None = None, triples: DataFrame | None = None, procs: DataFrame | None = None, k: int = 20, config: Config | None = None, min_importance: float = 0.0, start=None, end=None, touch_at=None, ann_threshold: int | None = None, hits: DataFrame | None = None, best: DataFrame | None = None, **counting) -> DataFrame:
    """Candidates of the stores a query asks for, merged by score and packed into its budget.

    Queries: query_id, query, vec, agent, types (array), budget (0 or null: the default). Floor, time range
    and k bind episodic rows only. touch_at adds the access time that returning a row would record. hits and
    best: of episodic_hits and procedural_candidates for these queries, where they are known. counting: count
    and cut, as budget.fill has them.
    """
    c = config or Config()
    queries = queries.withColumn("budget", F.when(F.coalesce("budget", F.lit(0)) == 0, F.lit(c.default_token_budget)).otherwise(F.col("budget")))
    asks = lambda s: queries.filter(F.array_contains("types", s))
    parts = []
    if episodic is not None:
        parts.append(episodic_candidates(episodic, asks("episodic"), k, c.blend_alpha, min_importance, start, end, ann_threshold, hits))
    if triples is not None:
        # a row costs a token at least: no more rows than tokens can be packed
        parts.append(semantic_candidates(triples, asks("semantic"), None if counting else "budget"))
    if procs is not None:
        asked = asks("procedural")
        parts.append(procedural_candidates(procs, asked, c.max_procedures_per_query) if best is None else best.join(asked.select("query_id"), "query_id", "left_semi"))
    if len({dict(p.dtypes)["id"] for p in parts}) > 1:
        # stores may name their rows by different types
        parts = [p.withColumn("id", F.col("id").cast("string")) for p in parts]
    union = parts[0].select(*CANDIDATE)
    for p in parts[1:]:
        union = union.unionByName(p.select(*CANDIDATE))
    order = [F.desc("score"), "store_order", "pos", "id"]
    packed = budget.fill(union.join(queries.select("query_id", "budget"), "query_id"), F.col("budget"), order, **counting)
    out = packed.withColumn("out_pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return out.withColumn("touched_at", F.lit(touch_at)) if touch_at is not None else out


def pack_facts(triples: DataFrame, queries: DataFrame, budget_of: str = "l1_budget", most_entities: int = 20) -> DataFrame:
    """Tier 1: (query_id, taken, used) of queries (query_id, agent, budget_of).

    The first entities by name; the agent's own facts of each, else anybody's; surest first. The entities
    that meet a batch of queries are at most most_entities, a fixed number.
    """
    first = facts.entities(triples).orderBy("entity").limit(most_entities)
    e = facts.edges(triples).join(F.broadcast(first), F.col("subject") == F.col("entity"), "left_semi")
    rows = e.select("id", "subject", "agent_id", "confidence", text.fact_text(F.col("subject"), F.col("predicate"), F.col("object")).alias("content"))
    q = queries.select("query_id", "agent", budget_of)
    pairs = sizes.join_blocks(rows, q, None)
    pairs = pairs.withColumn("_own", (F.col("agent_id") == F.col("agent")).cast("int")).withColumn("_any", F.max("_own").over(W.partitionBy("query_id", "subject"))).filter("_own = _any")
    return budget.fill_skipping(pairs, F.col(budget_of), ["subject", -F.col("confidence"), "id"])


def context(queries: DataFrame, episodic: DataFrame, triples: DataFrame, procs: DataFrame, level: int = 2, identity: str = "", config: Config | None = None) -> DataFrame:
    """Tiered context: (query_id, tier, pos, content, tokens). Queries as for recall; one agent each.

    Tier 0 is the identity text; 1 facts; 2 memories and procedures; 3 everything again, without what
    tier 2 holds. Each tier's budget is what the tiers before have left, per query.
    """
    c = config or Config()
    queries = queries.persist()
    left = F.when(F.coalesce("budget", F.lit(0)) == 0, F.lit(c.default_token_budget)).otherwise(F.col("budget"))
    # what a tier leaves is read by all later tiers: a row per query, kept
    q = queries.withColumn("left", left - (text.count_tokens(F.lit(identity)) if identity else F.lit(0)))
    tiers = [q.select("query_id", F.lit(0).alias("tier"), F.lit(1).alias("pos"), F.lit(identity).alias("content"), text.count_tokens(F.lit(identity)).alias("tokens"), F.lit(None).cast("string").alias("id"))] if identity else []
    if level >= 1:
        t1 = pack_facts(triples, q.withColumn("l1_budget", F.least(F.lit(c.l1_token_budget), "left"))).persist()
        tiers.append(t1.select("query_id", F.lit(1).alias("tier"), F.posexplode("taken").alias("p", "content")).select("query_id", "tier", (F.col("p") + 1).alias("pos"), "content", text.count_tokens(F.col("content")).alias("tokens"), F.lit(None).cast("string").alias("id")))
        q = q.join(t1.select("query_id", "used"), "query_id", "left").withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).drop("used")
    if level >= 2:
        ask = q.withColumn("budget", F.least(F.lit(c.l2_token_budget), "left")).filter("budget > 0").withColumn("types", F.array(F.lit("episodic"), F.lit("procedural")))
        # both tiers look for the same in the same rows
        known = {"hits": episodic_hits(episodic, queries, max(L2_RESULTS, c.l3_results) if level >= 3 else L2_RESULTS).persist(), "best": procedural_candidates(procs, queries, c.max_procedures_per_query).persist()}
        t2 = recall(ask, episodic, None, procs, k=L2_RESULTS, config=c, **known)
        t2 = t2.select("query_id", F.lit(2).alias("tier"), F.col("out_pos").alias("pos"), F.col("packed").alias("content"), "tokens", F.col("id").cast("string").alias("id")).persist()
        tiers.append(t2)
        q = q.join(t2.groupBy("query_id").agg(F.sum("tokens").alias("used")), "query_id", "left").withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).drop("used")
        if level >= 3:
            ask = q.filter(F.col("left") > c.l3_least_left).withColumn("budget", F.col("left")).withColumn("types", F.array(*map(F.lit, STORE_ORDER)))
            t3 = recall(ask, episodic, triples, procs, k=c.l3_results, config=c, **known)
            t3 = t3.select("query_id", F.lit(3).alias("tier"), F.col("out_pos").alias("pos"), F.col("packed").alias("content"), "tokens", F.col("id").cast("string").alias("id"))
            tiers.append(t3.join(t2.select("query_id", "id"), ["query_id", "id"], "left_anti").select(*t2.columns))
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return out
