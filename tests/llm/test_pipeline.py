"""The pipeline against a brute-force one, and its registration."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from memspark.llm.registered import RANKS

from .test_near_dups import brute as classes
from .test_repeats import brute as cut
from .test_scalar_ops import contaminated


def removed_text(texts, length=corpus_pipeline.PASSAGE_BYTES):
    raws = [t.encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for s in range(len(r) - length + 1):
            seen.setdefault(r[s : s + length], []).append((i, s))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\1" * length
    return [bytes(x for x, y in zip(r, g) if not y).decode("utf-8", "ignore") for r, g in zip(raws, gone)]


def test_run(spark, tmp_path):
    r = random.Random(21)
    syl = ["the", "and", "ing", "er", "tion", "ou", "sh"]
    word = lambda: "".join(r.choice(syl) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(20) for _ in range(5)]
    passage = text(80)
    docs = [text(r.choice([20, 90, 150])) for _ in range(40)]
    near = docs[3].split()
    near[40 % len(near)] = "changed"
    docs += [docs[3], " ".join(near), "123 456", None, "", text(30) + " " + items[0] + " " + text(9), passage + " " + text(70), text(50) + " " + passage, passage]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [(i, t) for i, t in enumerate(docs) if t and any(c.isalpha() for c in t)]
    c = classes([t for _, t in want], [i for i, _ in want])
    want = [(i, t) for i, t in want if c[i] == i]
    left = removed_text([t for _, t in want])
    assert [len(t) for t in left] != [len(t) for _, t in want]
    want = [(i, t) for (i, _), t in zip(want, left) if t]
    hit = contaminated([t for _, t in want], list(enumerate(items)))
    assert any(x[-1] for x in hit)
    want = [w for w, x in zip(want, hit) if not x[-1]]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(i, lib.encode_ordinary(t), t) for i, t in want]
    want = {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, x, t in ids}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in out} == want
    assert cut(["a"], 400)


LAYOUT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_passages_of_over_fifty_words_go(spark):
    r = random.Random(23)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.choice([2, 3, 4, 5, 6, 7])))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (51, 52, 53, 55, 58, 60)]
    assert min(len(p) for p in passages) < 320
    rows = [(i, text(40) + " " + passages[i % 6] + " " + text(30), "en", None, 1) for i in range(18)] + [(100 + i, text(90), None, "s", 1) for i in range(30)]
    out = {x.doc_id: x for x in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, LAYOUT), "").collect()}
    assert len(out) == len(rows)
    for i, t, *_ in rows:
        if i < 100:
            # words beside a passage may go with it where two documents happen to share a letter there
            assert passages[i % 6] not in out[i].text and len(t) - len(passages[i % 6]) - 12 <= len(out[i].text) <= len(t) - len(passages[i % 6])
            assert out[i].n_chars == len(out[i].text)
        else:
            assert (out[i].text, out[i].n_chars) == (t, 1)


def test_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(0, "x " * 20)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, id string, key string, root string, score double"
    r = random.Random(24)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(20_000))
    rows = [(1, None, None, None, None), (None, "", None, None, None), (2, long, "en", None, 5), (2, long, "en", None, 5), (None, "the only words of this row", None, "s", None)]
    docs = spark.createDataFrame([(*x, "h", None, "k", "r", 0.5) for x in rows], extra)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
        out = stage(spark, docs, str(tmp_path))
        if name != "token_ids":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        n = len(out.collect())
        assert n == {"near_duplicates": 3, "repeated_passages": 3, "language": 3}.get(name, 5), (name, n)


def test_registered():
    import __spark_entry__

    q = __spark_entry__.queries()
    assert "pipeline" in q and {k.split("_")[0] for k in q if k.startswith("op") and k[2].isdigit()} == {f"op{n}" for n in range(1, 11)}
    assert set(__spark_entry__.oracle_sql()) <= set(q)


def test_oracles(spark):
    import duckdb

    from memspark.llm.registered import ORACLES, QUERIES

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, d).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values)), name
