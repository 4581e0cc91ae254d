"""Registered queries, and their SQL, over all rows of their tables: against brute force on accented fixtures."""

import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from memspark.functions import score, text
from memspark.operators import evaluate
from memspark.plans import registered

DATA = "/root/testdata/sf0.001"
DOCS = [
    (0, "Éva préfère rien. Éva uses café crème, and more. Zoë is naïve", "fr", "a"),
    (1, "éva uses CAFÉ crème but not tea. Noël was fun?", "fr", "a"),
    (2, "The deploy failed with an error in 12 ms. Ann uses tea", "en", "a"),
    (3, "Größe überall: v1.2 Élan Über kafka, noté éerror errorß test", "de", "b"),
    (4, "où est la clé? Señor García has años", "es", "b"),
    (5, None, "fr", "b"),
    (6, "", "en", "b"),
    (7, "plain words why not", "en", None),
]
TURNS = [(1, 0, "user", "déjà vu"), (1, 1, "assistant", "Déjà vu là"), (1, 2, "user", "deja vu la"), (1, 3, "assistant", "deja vu la!"), (2, 0, "user", "à"), (2, 1, "assistant", "è"), (3, 0, "user", "né né."), (3, 1, "assistant", "né né")]


def write(spark, d, name, rows, layout):
    spark.createDataFrame(rows, layout).coalesce(2).write.parquet(f"{d}/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    write(spark, d, "documents", [(*r, len(r[1] or "")) for r in DOCS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, d, "conversations", TURNS, "conv_id bigint, turn bigint, role string, text string")
    write(spark, d, "labels", [(i, i % 2, 0) for i in range(8)], "doc_id bigint, quality int, toxic int")
    return d


def run(spark, name, d):
    return [r.asDict() for r in registered.QUERIES[name](spark, d).collect()]


def statements(t):
    for s in re.split(r"[.!?\n]+", t or ""):
        s = s.strip()
        for verbs, name in text.STATEMENT_VERBS if len(s) >= 5 else ():
            m = re.search(rf"(\w[\w\s]{{1,30}}?)\s+({verbs})\s+(.+)", s, re.I)
            if m:
                a, o = m[1].strip(), re.split(r"[,;]|\band\b|\bbut\b", m[3].strip(), flags=re.I)[0].strip()
                if 2 <= len(a) <= 50 and 2 <= len(o) <= 80:
                    yield a, name, o
                break


def test_statements_of_all_documents(spark, tables):
    want = Counter((i, *s) for i, t, _, _ in DOCS for s in statements(t))
    assert any(not k[1].isascii() for k in want)
    assert {(r["id"], r["subject"], r["predicate"], r["object"]): r["n"] for r in run(spark, "statement_extraction", tables)} == want
    rows = run(spark, "consolidation", tables)
    assert [(r["agent_id"], r["subject"], r["predicate"], r["object"], r["n"], r["sources"]) for r in rows] == [("a", "éva", "uses", "café crème", 2, 2)]
    assert rows[0]["confidence"] == 1.0  # two of three documents: 2 / max(1, 0.9)


def test_metadata_of_all_documents(spark, tables):
    got = {r["doc_id"]: r for r in run(spark, "text_metadata", tables)}
    for i, t, _, _ in DOCS:
        t = t or ""
        assert got[i]["word_count"] == len(t.split()) and got[i]["token_count"] == max(1, len(t) // 4)
        assert got[i]["has_question"] == (t.rstrip().endswith("?") or bool(re.search(rf"\b({text.QUESTION_WORDS})\b", t, re.I)))
        assert got[i]["has_negation"] == bool(re.search(rf"\b({text.NEGATIONS})\b", t, re.I)), t
    assert len(got) == len(DOCS) and got[3]["entities"] == "Élan Über"


def test_importance_of_all_documents(spark, tables):
    got = {r["doc_id"]: r for r in run(spark, "importance_features", tables)}
    heuristic = {r["doc_id"]: r["score"] for r in run(spark, "importance_heuristic", tables)}
    model = {r["doc_id"]: r["score"] for r in run(spark, "importance_model", tables)}
    assert set(got) == set(heuristic) == set(model) == {r[0] for r in DOCS} and None not in model.values()
    for i, t, _, _ in DOCS:
        w = (t or "").split()
        n, g = max(1, len(w)), got[i]
        high, low = (len(re.findall(p, t or "")) for p in (score.HIGH, score.LOW))
        assert (g["high_kw"], g["low_kw"]) == (min(1, high / 5), min(1, low / 5)), t
        assert g["entity_density"] == round(sum(x.isalpha() and x[0].isupper() and len(x) > 1 for x in w) / n, 6)
        base = (0.4, 0.55, 0.6)[i % 3] + min(0.25, high * 0.05) - min(0.15, low * 0.03) + (min(0.15, 0.05 * math.log1p(i % 7)) if i % 7 else 0) + (0.05 * (1 - i / 48) if i else 0.05)
        assert heuristic[i] == pytest.approx(min(1, max(0, base)), abs=1e-6)


def test_all_turns(spark, tables):
    at = {(c, n): (role, x) for c, n, role, x in TURNS}
    clean = lambda s: re.sub(r"[^\w\s]", "", s.lower()).strip()
    want = {}
    for (c, n), (role, a) in at.items():
        if (c, n + 1) in at:
            e = at[c, n + 1][1]
            words = set(e.lower().split())
            want[c, n] = (round(len(words & set(a.lower().split())) / len(words), 6), float(clean(a) == clean(e)))
    assert {(r["conv_id"], r["turn"]): (r["overlap"], r["exact"]) for r in run(spark, "eval_overlap", tables)} == want
    assert want[2, 0] == (0, 0) and want[3, 0][1] == 1
    got = {r["role"]: (r["n"], r["avg_overlap"]) for r in run(spark, "eval_averages", tables)}
    assert got["overall"] == (len(want), pytest.approx(sum(v[0] for v in want.values()) / len(want), abs=1e-6))


def cells(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "NULL" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


ACCENTED = "statement_extraction consolidation text_metadata importance_features importance_heuristic eval_overlap eval_averages keyword_extraction".split()


@pytest.mark.parametrize("name", ACCENTED)
def test_sql_reads_accented_rows_alike(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{tables}/{t}.parquet/*.parquet'")
    got = registered.QUERIES[name](spark, tables).toPandas()
    assert cells(got) == cells(con.execute(registered.ORACLES[name]).df()) and len(got)


def test_keywords_of_all_pairs(spark, tables):
    items = [(i, f"{a} {b} the Error x y") for i, (a, b) in enumerate([("Éva", "CAFÉ"), ("clé", "años"), ("zz", "zz"), ("tea", "12"), ("ÜBER", "v1.2")])]
    write(spark, tables, "benchmark", items, "item_id bigint, text string")
    want = {(i, d): round(sum(k.lower() in (t or "").lower() for k in x.split()[:5]) / 5, 6) for i, x in items for d, t, _, _ in DOCS}
    assert {(r["item_id"], r["doc_id"]): r["score"] for r in run(spark, "eval_keywords", tables)} == want
    e = spark.createDataFrame([(i, x.split()[:5]) for i, x in items], "item_id bigint, expected array<string>")
    docs = spark.createDataFrame([(d, t) for d, t, _, _ in DOCS], "doc_id bigint, text string")
    blocks = evaluate.keyword_scores(docs, e, block_bytes=200).collect()
    assert len(blocks) == len(want) and {(r.item_id, r.doc_id): round(r.score, 6) for r in blocks} == want


def test_keyword_extraction_reads_all_languages(spark, tables):
    trim = lambda w: re.sub(r"^[?.!,;:'\"()]+|[?.!,;:'\"()]+$", "", w).lower()
    want = {i: " ".join(list(dict.fromkeys(w for w in map(trim, t.split()) if len(w) >= 4 and w not in text.STOP_WORDS))[:8]) if t is not None else None for i, t, _, _ in DOCS}
    assert {r["doc_id"]: r["keywords"] for r in run(spark, "keyword_extraction", tables)} == want


def test_best_overlap_and_namespaces_of_all_languages(spark, tmp_path):
    d = str(tmp_path)
    docs = [(1, "red green", "en", "a"), (4, "Red GREEN élan", "de", "a"), (7, "red green élan vert", None, "b"), (10, "other", "fr", "c")]
    write(spark, d, "documents", [(*r, len(r[1])) for r in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, d, "benchmark", [(0, "red green ÉLAN vert"), (1, "red green élan"), (2, "none")], "item_id bigint, text string")
    assert sorted((r["query_id"], r["id"], r["overlap"]) for r in run(spark, "eval_best_overlap", d)) == [(0, 7, 1.0), (1, 4, 1.0)]
    assert sorted((r["namespace"], r["first"]) for r in run(spark, "namespace_listing", d)) == [("a/de", 4), ("a/en", 1), ("b", 7), ("c/fr", 10)]


def test_evictions_of_every_source(spark, tmp_path):
    d = str(tmp_path)
    # created 7919 minutes after the first of January for each id, within 30 days: the score falls below 0.003 before the third day
    docs = [(0, "a"), (11, "z"), (22, None), (1, "a"), (2, "z"), (3, None), (43_200, "z")]
    write(spark, d, "documents", [(i, "t", "en", s, 1) for i, s in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    write(spark, d, "embeddings", [(0, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    old = [i for i, _ in docs if math.exp(-math.log(2) / 168 * (60 * 24 - i * 7919 % 43_200 / 60)) < 0.003]
    assert sorted(r["id"] for r in run(spark, "decay_evictions", d)) == sorted(old) and 0 < len(old) < len(docs) and {s for i, s in docs if i in old} >= {"a", "z", None}
