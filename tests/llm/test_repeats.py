"""Removed bytes against brute force."""

import hashlib
import random

import pytest

from memspark.llm import repeats

from .test_scalar_ops import frame


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for i, r in enumerate(raws):
        for s in range(len(r) - length + 1):
            seen.setdefault(r[s : s + length], []).append((i, s))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\1" * length
    out = []
    for r, g in zip(raws, gone):
        kept = bytes(x for x, y in zip(r, g) if not y)
        runs = sum(1 for k in range(len(g)) if g[k] and (k == 0 or not g[k - 1]))
        out.append((len(r), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,hot,batch", [(40, 2000, 20_000), (40, 3, 20_000), (40, 2000, 30), (41, 2, 50)])
def test_remove_repeats(spark, monkeypatch, length, hot, batch):
    monkeypatch.setattr(repeats, "BATCH", batch)
    r = random.Random(length + hot)
    make = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [make(n) for n in (30, 39, 40, 41, 60, 150)]
    texts = [None, "", "a" * 39, "a" * 40, "b" * 41, "ab" * 90, make(500)]
    for _ in range(60):
        texts.append(make(r.choice([5, 60, 200])) + "".join(r.choice(passages) + make(r.choice([0, 1, 30])) for _ in range(r.choice([0, 1, 3]))))
    texts += [texts[10]] * 4 + [texts[12][:-1]] + ["x\0y" * 30, "\0" * 90, "q" + "\0" * 60]
    ids = [*range(len(texts) - 1), None]
    out = repeats.remove_repeats(frame(spark, texts, ids), length=length, hot=hot).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out}
    want = dict(zip(ids, brute(texts, length)))
    assert len(out) == len(texts)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_family_keeps_levels_in_order():
    r = random.Random(1)
    levels = 0
    for _ in range(200):
        length = r.choice([2, 3, 5])
        family, held, weights, places = repeats.Family(length), [], [], []
        for _ in range(r.randrange(1, 12)):
            own = [bytes(r.choice(b"ab\0") for _ in range(r.randrange(length, length + 12))) for _ in range(r.randrange(1, 5))]
            times = [float(r.choice([1, 1, 2])) for _ in own]
            places += family.add(own, times).tolist()
            held, weights = held + own, weights + times
        count = {}
        for x, w in zip(held, weights):
            for i in range(len(x) - length + 1):
                count[x[i : i + length]] = count.get(x[i : i + length], 0) + w
        for x, at in zip(held, places):
            want = [count[x[i : i + length]] >= 2 for i in range(len(x) - length + 1)]
            assert family.repeated[at : at + len(want)].tolist() == want
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and all((s[1:] > s[:-1]).all() for s in map(family.strings, family.levels))
        levels = max(levels, len(sizes))
    assert levels > 2


def test_a_hot_string_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 200)
    monkeypatch.setattr(repeats, "FAMILY", 400)
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line = make(60)
    texts = [make(30) + line + make(30) for _ in range(40)] + [line * 3] * 30 + [make(50_000) + line]
    out = repeats.remove_repeats(frame(spark, texts, [*range(len(texts))]), length=40, hot=5).collect()
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in out}
    assert got == dict(enumerate(brute(texts, 40)))


def test_repeated_rows_and_empty(spark):
    t = "some text that is long enough, " * 3
    out = repeats.remove_repeats(frame(spark, [t, t, "z"], [1, 1, 2]), length=40).collect()
    assert sorted((x.doc_id, x.n_removed) for x in out) == [(1, len(t)), (1, len(t)), (2, 0)]
    assert repeats.remove_repeats(frame(spark, ["a"]).limit(0)).collect() == []
