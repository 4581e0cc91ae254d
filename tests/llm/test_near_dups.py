"""Signatures against weighted Jaccard similarity, classes against brute force."""

import random

import numpy as np
import pytest

from memspark.llm import near_dups

from .test_scalar_ops import frame, words


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    k = 4096
    for low, high in ((1, 1), (0.2, 5.0), (3, 40)):
        e = near_dups.mix(np.arange(300, dtype=np.uint64) + np.uint64(7))
        wa, wb = rng.uniform(low, high, 200), rng.uniform(low, high, 200)
        ia, ib = np.arange(200), np.arange(60, 260)
        sig = near_dups.signatures(np.concatenate((e[ia], e[ib])), np.concatenate((wa, wb)), np.repeat([0, 1], 200), 2, k)
        a, b = np.zeros(300), np.zeros(300)
        a[ia], b[ib] = wa, wb
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.035)
        alone = near_dups.signatures(e[ia], wa, np.zeros(200, np.int64), 1, k)
        assert (alone[0] == sig[0]).all()  # whatever else is in the batch


def brute(texts, ids, size=5, threshold=0.8):
    sets = [frozenset(" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in map(words, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("local", [3000, 0])
def test_classes(spark, local):
    r = random.Random(9)
    base = [[f"w{r.randrange(400)}" for _ in range(120)] for _ in range(6)]
    texts = [None, "", "...", "one two", "One, two!", "x"]
    for b in base:
        chain = list(b)
        for _ in range(12):
            c = list(chain)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                c[r.randrange(120)] = f"v{r.randrange(9999)}"
            texts.append(" ".join(c))
            chain = c if r.random() < 0.5 else chain
    ids = list(range(len(texts)))
    out = near_dups.near_duplicates(frame(spark, texts, ids), local=local, bands=64, rows=4).collect()
    assert {x.doc_id: x.class_id for x in out} == brute(texts, ids)
    assert sum(x.is_kept for x in out) == len({x.class_id for x in out})
    sizes = {}
    for x in out:
        sizes[x.class_id] = sizes.get(x.class_id, 0) + 1
    assert all(x.class_size == sizes[x.class_id] for x in out)


def edited(r, text, n):
    out = list(text)
    for k in r.sample(range(len(out)), n):
        out[k] = f"v{r.randrange(10**6)}"
    return out


@pytest.mark.parametrize("local", [3000, 0])
def test_shipped_settings_lose_no_link(spark, local):
    """Pairs around the threshold, at the settings of the query: 200 words, a word changed costs 5 of 196 shingles."""
    r = random.Random(31)
    texts = []
    for _ in range(150):
        a = [f"w{r.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(a), " ".join(edited(r, a, r.choice([1, 2, 3, 4, 4, 5, 6])))]
    ids = list(range(len(texts)))
    out = near_dups.near_duplicates(frame(spark, texts, ids), local=local).collect()
    want = brute(texts, ids)
    assert sum(c != i for i, c in want.items()) > 100
    assert {x.doc_id: x.class_id for x in out} == want


def test_unlike_sets_of_one_bucket(spark):
    """A template of 70 % that all texts share, with near copies among them: many buckets of many classes."""
    r = random.Random(32)
    template, texts = [f"t{i}" for i in range(140)], []
    for _ in range(40):
        own = template + [f"w{r.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(own)] + [" ".join(edited(r, own, 2)) for _ in range(r.choice([0, 0, 1, 3]))]
    ids = list(range(len(texts)))
    for counts in (False, True):
        out = near_dups.near_duplicates(frame(spark, texts, ids), bands=40, rows=3, local=0, star_rounds=1, star_centres=1, counts=counts).collect()
        assert {x.doc_id: x.class_id for x in out} == brute(texts, ids)


def test_long_and_repeated_texts(spark):
    r = random.Random(33)
    long = [f"w{r.randrange(10**6)}" for _ in range(30_000)]
    texts = [" ".join(long), " ".join(edited(r, long, 500)), *["one and the same text of some words"] * 60, "another"]
    for elements in (4_000_000, 10_000):
        out = near_dups.near_duplicates(frame(spark, texts, [*range(len(texts))]), local_elements=elements).collect()
        assert sorted(x.class_size for x in out) == [1, 2, 2] + [60] * 60


def test_odd_rows(spark):
    out = near_dups.near_duplicates(frame(spark, ["a b c d e f g", "a b c d e f g", "a b c d e f g", "p q r s t u v"], [7, 7, None, 7])).collect()
    assert len(out) == 4 and sorted(x.class_size for x in out) == [1, 3, 3, 3]
    assert near_dups.near_duplicates(frame(spark, ["a"]).limit(0)).collect() == []
