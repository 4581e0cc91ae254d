"""Importance model: ridge regression on standardised features, in closed form from one aggregate."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import score

WIDTH = len(score.FEATURES)


@dataclass
class ImportanceModel:
    coef: list[float]
    intercept: float
    mean: list[float]
    std: list[float]

    def predict(self, features: Column) -> Column:
        """Clamped to 0..1."""
        terms = [(F.element_at(features, i + 1) - self.mean[i]) / self.std[i] * self.coef[i] for i in range(WIDTH)]
        total = F.lit(self.intercept)
        for t in terms:
            total = total + t
        return score.clamp(total)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> ImportanceModel:
        return cls(**json.loads(text))


def features(df: DataFrame, recency_default: float) -> DataFrame:
    """df (content, memory_type[, access_count, recency_hours]) with features."""
    access = F.coalesce("access_count", F.lit(0)) if "access_count" in df.columns else F.lit(0)
    recency = F.coalesce("recency_hours", F.lit(recency_default)) if "recency_hours" in df.columns else F.lit(recency_default)
    return df.withColumn("features", score.importance_features(F.col("content"), F.col("memory_type"), access, recency))


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, sums of products) of the features and the label: one pass, a fixed number of sums."""
    cols = [F.element_at("features", i + 1) for i in range(WIDTH)] + [F.col("importance").cast("double")]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    prods = [F.sum(cols[i] * cols[j]).alias(f"p{i}_{j}") for i in range(len(cols)) for j in range(i + 1)]
    r = rows.agg(F.count("*").alias("n"), *sums, *prods).first()
    p = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i + 1):
            p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
    return r["n"], np.array([r[f"s{i}"] or 0.0 for i in range(len(cols))]), p


def train(samples: DataFrame, alpha: float = 1.0) -> ImportanceModel:
    """samples: content, memory_type, importance[, access_count, recency_hours]."""
    n, s, p = moments(features(samples, 1.0))
    if not n:
        raise ValueError("no samples")
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov)[:WIDTH], 0))
    std[std < 1e-12] = 1.0
    x = cov[:WIDTH, :WIDTH] / np.outer(std, std) * n
    y = cov[:WIDTH, WIDTH] / std * n
    coef = np.linalg.solve(x + alpha * np.eye(WIDTH), y)
    return ImportanceModel(coef.tolist(), float(mean[WIDTH]), mean[:WIDTH].tolist(), std.tolist())


def partial_fit(model: ImportanceModel, samples: DataFrame, rate: float = 0.01, ridge: float = 1e-4, most: int = 10_000) -> ImportanceModel:
    """One pass of constant-rate gradient steps from the model's weights, its scaling kept. Of at most most samples, in an order that their contents decide."""
    rows = features(samples, 1.0).orderBy(F.xxhash64("content", "memory_type", "importance"), "content").select("features", "importance").limit(most).collect()
    w, b = np.array(model.coef), model.intercept
    for r in rows:
        x = (np.array(r["features"]) - model.mean) / model.std
        error = float(w @ x + b - r["importance"])
        w = w * (1 - rate * ridge) - rate * error * x
        b -= rate * error
    return ImportanceModel(w.tolist(), float(b), model.mean, model.std)


def scored(df: DataFrame, model: ImportanceModel | None = None, explicit: str | None = None) -> DataFrame:
    """df with score: the model's, or the heuristic one without a model, blended with an explicit value if there is one."""
    f = features(df, 0.0)
    if model is not None:
        s = model.predict(F.col("features"))
    else:
        access = F.coalesce("access_count", F.lit(0)) if "access_count" in df.columns else F.lit(0)
        recency = F.coalesce("recency_hours", F.lit(0.0)) if "recency_hours" in df.columns else F.lit(0.0)
        s = score.heuristic_importance(F.col("content"), F.col("memory_type"), access, recency)
    return f.withColumn("score", score.final_importance(s, F.col(explicit) if explicit else F.lit(None).cast("double"))).drop("features")


#: Labelled rows of our own for a model without data: (content, memory_type, importance, access_count, recency_hours).
TRAINING_ROWS = [
    ("critical outage of the api: 500 errors for 12 min after the deploy of v3.2", "episodic", 0.93, 0, 0.0),
    ("urgent: the password of the db user must be changed, the token leaked", "episodic", 0.95, 3, 1.0),
    ("rollback of v1.9.4 on kubernetes, error rate was 8 %", "episodic", 0.88, 1, 0.0),
    ("redis ran out of memory at 900 MB, postgres slowed to 400 ms", "episodic", 0.86, 0, 4.0),
    ("the tls certificate will expire before the deadline", "episodic", 0.84, 0, 0.0),
    ("Maria always prefers terraform over manual changes", "episodic", 0.66, 2, 12.0),
    ("moved the cron job from nginx to docker, runs in 40 s", "episodic", 0.62, 0, 2.0),
    ("new grafana panel for the kafka queue", "episodic", 0.58, 0, 30.0),
    ("the team met and talked about the plan", "episodic", 0.36, 0, 8.0),
    ("the team met and talked about the plan", "episodic", 0.47, 25, 8.0),
    ("lunch was late", "episodic", 0.22, 0, 1.0),
    ("maybe we could try another colour", "episodic", 0.24, 0, 0.0),
    ("just a test, a dummy placeholder", "episodic", 0.16, 0, 0.0),
    ("perhaps an example might help, possibly a sample", "episodic", 0.14, 0, 50.0),
    ("fixed the login page for Safari", "episodic", 0.6, 0, 0.0),
    ("fixed the login page for Safari", "episodic", 0.52, 0, 90.0),
    ("orders_service stores data in postgres", "semantic", 0.7, 0, 0.0),
    ("gateway runs version v2.0.1", "semantic", 0.74, 0, 0.0),
    ("Jonas likes tea", "semantic", 0.42, 0, 0.0),
    ("auth requires jwt", "semantic", 0.72, 4, 10.0),
    ("Procedure restore: critical restore of the postgres db. Steps: stop → restore → verify", "procedural", 0.9, 0, 0.0),
    ("Procedure release: deploy with docker. Steps: ci → deploy → rollback if it must fail", "procedural", 0.85, 6, 0.0),
    ("Procedure tidy: sort the desk. Steps: look → sort", "procedural", 0.6, 0, 0.0),
    ("Procedure demo: a sample of the dummy test", "procedural", 0.5, 0, 60.0),
]
_default: dict[int, ImportanceModel] = {}


def default_model(spark: SparkSession) -> ImportanceModel:
    """Fitted to TRAINING_ROWS when it is first asked for."""
    if 0 not in _default:
        _default[0] = train(spark.createDataFrame(TRAINING_ROWS, "content string, memory_type string, importance double, access_count bigint, recency_hours double"))
    return _default[0]


def score_units(df: DataFrame, now: Column, model: ImportanceModel | None = None) -> DataFrame:
    """df (content, memory_type, access_count, created_at) with score: its age since it was created counts as recency."""
    aged = df.withColumn("recency_hours", score.hours_between(F.col("created_at"), now))
    return scored(aged, model).drop("recency_hours")
