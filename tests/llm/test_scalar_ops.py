"""Operators that give a row per document, against brute force or the tokenizer's own library."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memspark.llm import decontaminate, fingerprints, language_id, licences, sharding, token_counts, toxicity
from memspark.llm.registered import JSON_BPE, PIECES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "text string, doc_id bigint, lang string, source string, score double, h string, id string"
ODD = [
    None, "", " ", "  ", "a", "\n", "a  b \n c ", "12345 !!", "The MIT License. The MIT   License", "été Été ÉTÉ straße ΑΣ σς",
    "tabs\tand nbsp   wide", "<|endoftext|>x<|endoftext|>", "it's we'll I'd 'S", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "中文字符没有空格" * 40, "😀😃 á é",
    "foo \n bar\n\n  baz \t", "GNU General Public License, apache license; mit-license", "x" * 5000, ("the " * 3000).strip(), "²½Ⅷ", "a\r\nb", "\x1c \x85",
]


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(t, i, "en" if k % 2 else None, None, 1.0, "x", None) for k, (t, i) in enumerate(zip(texts, ids))], SCHEMA)


def some_texts(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "And", "mit", "license", "Éa", "foo", "bar,", "x.", "q-r", "5", "apache"]
    return [" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 9, 10, 11, 40, 200]))) for _ in range(n)]


def test_token_counts(spark):
    texts = ODD + some_texts()
    t = Tokenizer.from_file(JSON_BPE)
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), JSON_BPE).collect()}
    for i, x in enumerate(texts):
        assert got[i].n_tokens == len(t.encode(x or "", add_special_tokens=False).ids), repr(x)
        assert got[i].n_bytes == len((x or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 512)
    assert token_counts.count_tokens(frame(spark, texts).limit(0), JSON_BPE).collect() == []


def test_licences(spark):
    texts = ODD + some_texts() + ["x " + licences.TEMPLATES["gpl"][0] + " y", "Licensed under CC BY-NC 4.0.", "permission is hereby granted to nobody"]
    got = {r.doc_id: r for r in licences.scan_licences(frame(spark, texts)).collect()}
    for i, x in enumerate(texts):
        ws, starts, labels = words(x), [], set()
        for p, label in licences.PHRASES.items():
            p = p.split()
            at = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(starts), ",".join(sorted(labels))), repr(x)
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[len(texts) - 3].labels == "gpl"
    assert got[len(texts) - 2].labels == "cc-by-nc"
    assert got[len(texts) - 1].labels == ""


def longest_of(seq, file, i):
    """The longest run of seq that ends at file's place i."""
    return max((n for n in range(1, min(i + 1, len(seq)) + 1) if any(seq[a : a + n] == file[i + 1 - n : i + 1] for a in range(len(seq) - n + 1))), default=0)


def test_suffix_automaton_matches_brute_force():
    r = random.Random(3)
    for _ in range(200):
        seqs = [[r.randrange(3) for _ in range(r.randrange(1, 9))] for _ in range(3)]
        file = [r.randrange(4) for _ in range(12)]
        least = r.choice([1, 2, 3])
        got = licences.SuffixAutomaton(seqs).matches(file, least)
        for s, seq in enumerate(seqs):
            longest = [longest_of(seq, file, i) for i in range(len(file))]
            want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= least and (i + 1 == len(file) or longest[i + 1] != n + 1)]
            assert sorted((a, n) for a, n, _ in got.get(s, [])) == want
            for at, n, ends in got.get(s, []):
                assert sorted(ends) == [e for e in range(len(seq)) if e + 1 >= n and seq[e + 1 - n : e + 1] == file[at : at + n]]


def chain_by_trying_all(hits, gap):
    best = 0
    hits = sorted(hits)
    for mask in range(1, 1 << len(hits)):
        chain = [h for i, h in enumerate(hits) if mask >> i & 1]
        value, ok = chain[0][2], True
        for (a, p, m), (at, place, n) in zip(chain, chain[1:]):
            cut = max(0, a + m - at, p + m - place)
            ok &= at > a and place > p and cut < n and at - (a + m) <= gap
            value += n - cut - max(0, at + cut - (a + m))
        best = max(best, value if ok else 0)
    return best


def test_chains_match_brute_force():
    r = random.Random(6)
    for _ in range(300):
        hits = [(r.randrange(20), r.randrange(20), r.randrange(2, 7)) for _ in range(r.randrange(1, 8))]
        gap = r.choice([0, 2, 8])
        assert licences.best_chain(hits, gap)[0] == chain_by_trying_all(hits, gap)


LICENCE_NOTICES = [
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd", 1),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa", 1),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "cc-by", 1),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa", 1),
    ("Licensed under CC BY", "", 0),
    ("This library is distributed under the BSD License", "", 0),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse products derived from this software without specific prior written permission.", "bsd", None),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "mit", 1),
    ("You should have received a copy of the GNU Affero General Public License along with this program.", "agpl,gpl", 1),
    ("You may not use this file except in compliance with common sense", "", 0),
]


def test_licence_notices(spark):
    texts = [t for t, _, _ in LICENCE_NOTICES] + [" ".join(["word"] * 5000) + " " + LICENCE_NOTICES[0][0]]
    got = sorted(licences.scan_licences(frame(spark, [*texts, texts[0]])).collect(), key=lambda x: x.doc_id)
    for (t, labels, score), x in zip(LICENCE_NOTICES, got):
        assert x.labels == labels and (score is None or x.score == score), (t, x)
    assert got[-2].labels == got[-1].labels == "cc-by-nd"
    assert 0.8 <= got[6].score < 1
    assert licences.scan_licences(frame(spark, texts).limit(0)).collect() == []


def test_language_id(spark):
    r = random.Random(5)
    syl = {"en": ["the", "and", "ing", "er", "tion"], "fr": ["eau", "que", "les", "ê", "ou"], "de": ["sch", "ung", "der", "ß", "keit"]}
    rows = [(i, lang, " ".join("".join(r.choice(syl[lang]) for _ in range(3)) for _ in range(15))) for i in range(120) for lang in [r.choice(sorted(syl))]]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "en", "123 !?"), (902, None, rows[0][2]), (None, "fr", rows[1][2]), (903, "de", "²½")], "doc_id bigint, lang string, text string")
    got = {r.doc_id: r for r in language_id.identify(df, PIECES).collect()}
    assert len(got) == 125
    for i, lang, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and got[900].score == 0
    assert got[902].lang_pred == rows[0][1] and got[None].held_out is False
    assert language_id.identify(df.limit(0), PIECES).collect() == []


def test_language_id_of_odd_rows(spark):
    own = [("e", "en", "the and ing " * 20), ("f", "fr", "eau que les " * 20)] * 12 + [("l", None, "eauqueles" * 900), ("m", None, "theand" * 4000), ("l", None, "eauqueles" * 900), ("z", None, None)]
    df = spark.createDataFrame([(f"{a}{i % 30}", b, c, 0.5, "x", "y") for i, (a, b, c) in enumerate(own)], "doc_id string, lang string, text string, score double, lang_pred string, held_out string")
    got = language_id.identify(df, PIECES).collect()
    assert len(got) == len(own) and got[0].__fields__ == ["doc_id", "held_out", "lang_pred", "score"]
    by = {r.doc_id[0]: r.lang_pred for r in got}
    assert by == {"e": "en", "f": "fr", "l": "fr", "m": "en", "z": "und"}
    # a language alone is certain; without any none is
    assert {r.lang_pred for r in language_id.identify(df.filter("lang = 'en' OR lang IS NULL"), PIECES).collect()} == {"en", "und"}
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", language_id.F.lit(None).cast("string")), PIECES).collect()} == {"und"}


def test_long_words_are_summed_as_short_ones(monkeypatch):
    import numpy as np

    r, g = random.Random(8), np.random.default_rng(8)
    pieces = sorted({"▁", "a", "b", "ab", "▁a", "bab", "aab", "babaa"})
    table, p = language_id.PieceTable(pieces), g.dirichlet(np.ones(len(pieces) + 1), 2)
    words_ = ["▁" + "".join(r.choice("abc") for _ in range(n)) for n in (1, 3, 5, 12, 20, 23)]
    lat = language_id.Lattice(words_, table)
    for k in (0, 1):
        assert sum(language_id.long_expected(table, w, np.log(p[k])) for w in words_) == pytest.approx(lat.expected(p[k], np.ones(len(words_))))
    for size in (4096, 16, 7, 5, 1):
        monkeypatch.setattr(language_id, "SLICE", size)
        for k in (0, 1):
            assert [language_id.long_total(table, w, np.log(p.T))[k] for w in words_] == pytest.approx(np.log(lat.total(lat.forward(p[k]))).tolist())


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "bab": 5}
    import numpy as np

    p = np.array([0.1, 0.2, 0.15, 0.25, 0.1, 0.15, 0.05])

    def total(w):
        return 1.0 if not w else sum((p[pieces[w[:n]]] if w[:n] in pieces else p[6] if n == 1 else 0) * total(w[n:]) for n in range(1, len(w) + 1))

    words_ = ["▁abab", "▁c", "▁aab", "b"]
    lat = language_id.Lattice(words_, language_id.PieceTable(sorted(pieces, key=pieces.get)))
    assert lat.total(lat.forward(p)) == pytest.approx([total(w) for w in words_])


def test_toxicity(spark):
    r = random.Random(7)
    plain, bad = [f"word{c}" for c in "abcdefghij"], ["moronic", "idiot"]
    docs, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        sents = [[r.choice(plain) for _ in range(6)] for _ in range(5)]
        if toxic:
            sents[2][3] = r.choice(bad)
        docs.append((i, ". ".join(" ".join(s) for s in sents)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (None, "idiot")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    y = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, toxicity.train(d, y)).collect()}
    for i, toxic in labels:
        assert got[i].predicted == toxic and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].worst_sentence is not None and any(b in got[i].worst_sentence for b in bad)) == bool(toxic)
    assert got[900].score == got[901].score < 0.3
    none = toxicity.score(d, toxicity.train(d, y.limit(0))).collect()
    assert {x.predicted for x in none} == {0}


def test_toxicity_is_a_noisy_or():
    r = random.Random(12)
    vocab = ["good", "moronic", "idiots", "idiotic", "word", "other"]
    model = toxicity.Model(-3.0, {"moronic": 2.5, "idiot*": 1.5, "idiots": 0.5, "good": -1.0})
    texts = [None, "", " ... ", "12 34."] + [". ".join(" ".join(r.choice(vocab) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 6))) for _ in range(60)] + ["word. " * 5000]
    for t in texts:
        left = 1.0
        for s in re.split(r"[.!?\n]+", t or ""):
            ws = set(re.findall(r"[^\W\d_]+", s.lower()))
            if ws:
                z = -3.0 + sum(model.weight.get(w, 0) for w in ws) + sum(model.weight.get(x, 0) for x in {w[:5] + "*" for w in ws if len(w) > 5})
                left *= 1 - 1 / (1 + math.exp(-z))
        assert model.score(t) == pytest.approx(1 - left), t


def test_toxicity_of_odd_rows(spark):
    d = spark.createDataFrame([(1, "idiot idiot. fine", 0.1, 3), (1, "idiot idiot. fine", 0.1, 3), (2, "nice. " * 3000 + "idiot", None, None)], "doc_id bigint, text string, score double, predicted int")
    y = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    learn = spark.createDataFrame([(i, "idiot here" if i % 2 else "nice here") for i in range(40)], "doc_id bigint, text string")
    got = toxicity.score(d, toxicity.train(learn, y)).collect()
    assert [x.predicted for x in got] == [1, 1, 1] and got[0].worst_sentence == got[1].worst_sentence == "idiot idiot"
    assert toxicity.score(d.limit(0), toxicity.train(learn.limit(0), y)).collect() == []


def contaminated(texts, items, span=10):
    windows = {}
    for i, t in items:
        ws = words(t)
        for a in range(max(1, len(ws) - span + 1) if ws else 0):
            windows.setdefault(tuple(ws[a : a + span]), set()).add(i)
    out = []
    for t in texts:
        ws, hit, found = words(t), set(), set()
        for a in range(len(ws)):
            for n in range(1, span + 1):
                if a + n <= len(ws) and tuple(ws[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(ws[a : a + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    r = random.Random(11)
    vocab = ["the", "of", "and", "Ün", "Σας", "x", "y"]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, make(r.choice([10, 12, 30]))) for i in range(12)] + [(50, None), (51, "..."), (52, "the " * 12), (None, make(15))]
    items += [(60, make(4)), (61, "x"), (62, make(9)), (63, make(4))] if short else []
    items.append(items[0])
    texts = ODD + [make(r.choice([0, 3, 9, 10, 80])) for _ in range(40)] + [make(20) + " " + t + " " + make(9) for _, t in items[:8]] + ["The, the; THE " * 50]
    texts += [texts[-2].upper()] * 3
    d = frame(spark, texts, [*range(len(texts) - 1), 5])
    b = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id bigint, n_words int")
    got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination(d, b).collect())
    want = sorted((i, *x) for i, x in zip([*range(len(texts) - 1), 5], contaminated(texts, items)))
    assert got == want
    assert any(x[-1] for x in want)
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    assert {x.n_hit for x in decontaminate.contamination(d, b.limit(0)).collect()} == {0}


def test_sharding(spark):
    r = random.Random(13)
    texts = [None] * 500 + ["same text over and over"] * 700 + ["é" * r.randrange(300) for _ in range(900)]
    out = sharding.shard_by_bytes(frame(spark, texts, [*range(len(texts) - 2), 3, None]), 8, rows_per_range=20).collect()
    assert len(out) == len(texts)
    own = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    assert sorted((x["size"], x.text_crc32) for x in out) == own
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x)
        assert x.law == "bytes" and x.grown_shard is None
    sums = [sum(x["size"] for x in v) for v in by.values()]
    assert sorted(by) == list(range(8)) and max(sums) - min(sums) <= 2 * 601
    for v in by.values():
        assert sorted(x.slot for x in v) == list(range(len(v)))
    assert sharding.shard_by_bytes(frame(spark, texts).limit(0)).collect() == []
    assert len(sharding.shard_by_bytes(frame(spark, [None, "a"])).collect()) == 2


def test_fingerprints(spark):
    texts = ODD + some_texts(40)
    ids = [*range(10, 10 + len(texts))]
    random.Random(2).shuffle(ids)
    for per in (1000, 5):
        got = {x.doc_id: x for x in fingerprints.fingerprints(frame(spark, texts, ids), rows_per_range=per).collect()}
        order = sorted(zip(ids, texts), key=lambda x: -x[0])
        for k, (i, t) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            x = got[i]
            assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), (i, t)
            assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
            if t == nxt:
                assert x.near_next == 1
    one = fingerprints.fingerprints(frame(spark, ["some text of a few words here"])).collect()[0]
    assert one.near_next == 1
    assert fingerprints.fingerprints(frame(spark, ["a"]).limit(0)).collect() == []
    # ids without a number, many of them null
    odd = [(None if i % 3 == 0 else f"k{i * 7919 % 1000:04d}", f"text number {i} " * (i % 5)) for i in range(400)]
    for per in (1000, 20):
        got = fingerprints.fingerprints(spark.createDataFrame(odd, "doc_id string, text string"), rows_per_range=per).collect()
        assert len(got) == len(odd)
        named = sorted(((i, t) for i, t in odd if i), reverse=True)
        sha = {x.doc_id: x.edited_sha256 for x in got if x.doc_id}
        for (i, t), (_, nxt) in zip(named, named[1:]):
            half = len(t) // 2
            assert sha[i] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    twice = fingerprints.fingerprints(frame(spark, ["b c", "b c", None, "a"], [1, 1, None, None])).collect()
    assert len(twice) == 4 and len({x.fingerprint for x in twice if x.n_chars == 3}) == 1


def test_fingerprints_keep_the_match_guarantee(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(60):
        a, b, shared = ([f"w{r.randrange(10**6)}" for _ in range(n)] for n in (30, 25, 13))
        pairs.append((" ".join(a[:10] + shared + a[10:]), " ".join(b[:7] + shared + b[7:])))
    df = spark.createDataFrame(pairs, "a string, b string").select(fingerprints.likeness(fingerprints.picks(fingerprints.F.col("a"), 4, 10), fingerprints.picks(fingerprints.F.col("b"), 4, 10)).alias("x"))
    assert all(x.x > 0 for x in df.collect())
