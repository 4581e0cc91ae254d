"""Toxicity by multiple-instance learning: sentences are scored, documents labelled.

A sentence is toxic with probability sigmoid(bias + sum of its features' weights); a document is clean
when all its sentences are, so its score is the noisy-or of theirs: 1 - product(1 - p). The weights are
fitted to document labels by the likelihood of that model; the fitted sentence scores then locate the
offending sentences. Features are the distinct words of a sentence and their five-letter beginnings.

Learned from at most ``max_train`` labelled documents (chosen by the id's hash) outside the held-out
fold. Which features are weighed at all is decided on the same sample: at most ``max_features`` that
toxic documents hold most clearly more often.

Defined cases: null and empty texts have no sentences and score 0. Very long texts are scored whole, sentence
by sentence. Without labels, or with labels of one kind only, every score is near 0. Of repeated labels of a
document the highest counts; null ids are not learned from. Repeated rows are scored each. Of equally bad
sentences the first is the worst. No rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, in_workers, picked

SENTENCE = re.compile(r"[.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")
STEM = 5


def features(sentence: str) -> set[str]:
    words = set(TOKEN.findall(sentence))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class Model:
    bias: float = -30.0
    weight: dict[str, float] = field(default_factory=dict)

    def sentence_scores(self, text: str | None) -> list[tuple[str, float]]:
        """(sentence, probability), in order."""
        out = []
        for s in SENTENCE.split(text or ""):
            if TOKEN.search(s):
                z = self.bias + sum(self.weight.get(f, 0.0) for f in features(s.lower()))
                out.append((s.strip(), float(1 / (1 + np.exp(-z)))))
        return out

    def score(self, text: str | None) -> float:
        """The noisy-or over sentences; those without a weighed feature are only counted."""
        get, b = self.weight.get, self.bias
        text = (text or "").lower()
        known = self._known
        bare = logs = 0
        base = float(np.logaddexp(0, b))
        for s in SENTENCE.split(text):
            words = set(TOKEN.findall(s))
            if not words:
                continue
            hit = [w for w in words if w in known or w[:STEM] in self._stems]
            if not hit:
                bare += 1
                continue
            z = b + sum(get(w, 0.0) for w in hit) + sum(get(x, 0.0) for x in {w[:STEM] + "*" for w in hit if len(w) > STEM})
            logs += float(np.logaddexp(0, z))
        return float(-np.expm1(-(bare * base + logs)))

    def __post_init__(self):
        self._known = {f for f in self.weight if f[-1] != "*"}
        self._stems = {f[:-1] for f in self.weight if f[-1] == "*"}


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held: int, max_train: int) -> DataFrame:
    """(id, text, y) of at most max_train labelled documents outside the held-out fold, by the id's hash."""
    y = picked(labels, id=id_col, y=label_col).filter(F.col("y").isNotNull() & (crc_bucket("id", folds) != held)).groupBy("id").agg(F.max("y").alias("y"))
    some = y.orderBy(F.xxhash64("id"), "id").limit(max_train)
    return picked(docs, id=id_col, text=text_col).filter(F.col("text").isNotNull()).join(F.broadcast(some), "id")


def choose_features(train: DataFrame, max_features: int, least_docs: int) -> list[str]:
    """The features that toxic documents of the sample hold most clearly more often than clean ones do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[int]] = {"": [0, 0]}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = 1 if y == 1 else 0
                own[""][k] += 1
                for f in features(text.lower()):
                    own.setdefault(f, [0, 0])[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([v[0] for v in own.values()], pa.int64()), pa.array([v[1] for v in own.values()], pa.int64())], names=["f", "n0", "n1"])

    c = train.select("text", "y").transform(in_workers, count, "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    c = c.filter((F.col("f") == "") | (F.col("n1") >= least_docs))
    c = c.persist()
    try:
        total = c.filter("f = ''").first()
        if not total or not total["n0"] or not total["n1"]:
            return []
        lift = F.log((F.col("n1") + 0.5) / (total["n1"] + 1.0)) - F.log((F.col("n0") + 0.5) / (total["n0"] + 1.0))
        best = c.filter("f <> ''").select("f", (lift * F.sqrt(F.col("n1").cast("double"))).alias("s"), lift.alias("l")).filter("l > 0.7").orderBy(F.desc("s"), "f").limit(max_features)
        return [r["f"] for r in best.collect()]
    finally:
        c.unpersist()


def bags(train: DataFrame, chosen: list[str]) -> list[tuple[int, int, list[list[int]]]]:
    """(label, sentences without a chosen feature, chosen features of the others) of each document of the sample."""
    index = {f: i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, bare, hits = [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, none = [], 0
                for s in SENTENCE.split(text.lower()):
                    if TOKEN.search(s):
                        at = sorted(index[f] for f in features(s) if f in index)
                        none += not at
                        if at:
                            own.append(at)
                ys.append(1 if y == 1 else 0), bare.append(none), hits.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(bare, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], names=["y", "bare", "hits"])

    return [tuple(r) for r in train.select("text", "y").transform(in_workers, run, "y int, bare bigint, hits array<array<int>>").collect()]


def fit(sample: list[tuple[int, int, list[list[int]]]], chosen: list[str], rounds: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> Model:
    """Maximum likelihood of the noisy-or by Adam."""
    if not sample or not chosen:
        return Model()
    y = np.array([r[0] for r in sample], float)
    bare = np.array([r[1] for r in sample], float)
    doc = np.array([i for i, r in enumerate(sample) for _ in r[2]], np.int64)
    sent = [s for r in sample for s in r[2]]
    row = np.repeat(np.arange(len(sent)), [len(s) for s in sent])
    col = np.array([f for s in sent for f in s], np.int64)
    theta = np.concatenate(([-6.0], np.full(len(chosen), 0.5)))
    m = v = np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, rounds + 1):
        b, w = theta[0], theta[1:]
        z = b + np.bincount(row, w[col], len(sent))
        s = bare * np.logaddexp(0, b) + np.bincount(doc, np.logaddexp(0, z), len(y))
        # d(-log likelihood)/dS: clean 1, toxic -exp(-S)/(1-exp(-S))
        ds = np.where(y == 1, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0)
        dz = ds[doc] * sigmoid(z)
        g = np.concatenate(([dz.sum() + (ds * bare).sum() * sigmoid(b)], np.bincount(col, dz[row], len(w)))) / len(y)
        g[1:] += ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[0]), {f: float(x) for f, x in zip(chosen, theta[1:])})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held: int = 2, max_train: int = 20_000, max_features: int = 3_000, least_docs: int = 3) -> Model:
    sample = labelled(docs, labels, id_col, text_col, label_col, folds, held, max_train).persist()
    try:
        chosen = choose_features(sample, max_features, least_docs)
        return fit(bags(sample, chosen), chosen) if chosen else Model()
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted, n_offending, worst_sentence) of every row. A null id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            s = [m.score(t) for t in texts]
            found = [[x for x in m.sentence_scores(t) if x[1] >= threshold] if p >= threshold else [] for t, p in zip(texts, s)]
            worst = [max(f, key=lambda x: x[1])[0] if f else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(worst, pa.string())], names=[id_col, "score", "n_offending", "worst_sentence"])

    kind = dict(docs.dtypes)[id_col]
    out = picked(docs, **{id_col: id_col, "text_": text_col}).transform(in_workers, run, f"`{id_col}` {kind}, score double, n_offending bigint, worst_sentence string")
    return out.select(id_col, F.coalesce(crc_bucket(id_col, folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "worst_sentence")
