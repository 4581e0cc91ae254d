"""Scores: effective importance, blending, decay, heuristic importance and its features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE, white_split

# Words that raise or lower importance (whole words, either case).
HIGH_WORDS = "error fail crash critical urgent important always never prefer must require need expect password secret token key credential deadline due asap priority".split()
LOW_WORDS = "maybe perhaps might could possibly test example sample dummy placeholder".split()
HIGH, LOW = (rf"(?i)\b({'|'.join(w)})\b" for w in (HIGH_WORDS, LOW_WORDS))
# What looks like a version, and like a measure.
VERSION = r"v\d+\.\d+"
METRIC = r"(?i)\d+\s*(ms|%|MB|GB|KB|req|ops|min\b|s\b)"
# Technical vocabulary.
TECH_TERMS = (
    "api db sql jwt oauth nginx postgres postgresql redis docker kubernetes github ci cd deploy rollback migration alembic fastapi flask django react "
    "typescript grafana prometheus elasticsearch kafka rabbitmq celery lambda s3 ec2 rds gke eks terraform ansible cors ssl tls https webhook cron orm wal"
).split()
TYPE_VALUE = {"episodic": 0.0, "semantic": 0.5, "procedural": 1.0}
TYPE_BASE = {"episodic": 0.4, "semantic": 0.55, "procedural": 0.6}
FEATURES = ("type_norm", "length", "has_version", "has_metric", "high_kw", "low_kw", "entity_density", "specificity", "tech_density", "access_log", "recency_decay")
EMA_RATE = 0.3


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def effective_importance(importance: Column, decay: Column) -> Column:
    return importance * decay


def rank_relevance(rank0: Column, n: Column) -> Column:
    return 1 - rank0 / F.greatest(F.lit(1), n)


def blended(eff: Column, relevance: Column, alpha: float) -> Column:
    return (1 - alpha) * eff + alpha * relevance


def decay(hours: Column, half_life: float = 168.0) -> Column:
    return F.exp(F.lit(-math.log(2) / max(1.0, half_life)) * F.greatest(F.lit(0.0), hours))


def hours_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def by_type(memory_type: Column, values: dict[str, float]) -> Column:
    e = F.lit(None).cast("double")
    for k, v in values.items():
        e = F.when(memory_type == k, F.lit(v)).otherwise(e)
    return e


def _share(n: Column, of: Column | float) -> Column:
    return F.least(F.lit(1.0), n / of)


def importance_features(content: Column, memory_type: Column, access_count: Column, recency_hours: Column) -> Column:
    """The eleven features, as an array in the order of FEATURES."""
    words = white_split(content)
    n = F.greatest(F.lit(1), F.size(words)).cast("double")
    count = lambda f: F.size(F.filter(words, f)).cast("double")
    return F.array(
        by_type(memory_type, TYPE_VALUE),
        n / 100.0,
        F.regexp_like(content, F.lit("(?U)" + VERSION)).cast("double"),
        F.regexp_like(content, F.lit(UNICODE + METRIC)).cast("double"),
        _share(F.regexp_count(content, F.lit(UNICODE + HIGH)), 5.0),
        _share(F.regexp_count(content, F.lit(UNICODE + LOW)), 5.0),
        _share(count(lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}\p{L}+$"))), n),
        _share(count(lambda w: F.regexp_like(w, F.lit(r"(?U)\d"))), n),
        _share(count(lambda w: F.regexp_replace(F.lower(w), r"[.,;:()]+$", "").isin(TECH_TERMS)), 5.0),
        F.log1p(access_count.cast("double")),
        F.exp(-F.greatest(F.lit(0.0), recency_hours) / 48.0),
    )


def heuristic_importance(content: Column, memory_type: Column, access_count: Column, recency_hours: Column) -> Column:
    words = F.least(F.lit(0.25), F.regexp_count(content, F.lit(UNICODE + HIGH)) * 0.05) - F.least(F.lit(0.15), F.regexp_count(content, F.lit(UNICODE + LOW)) * 0.03)
    access = F.when(access_count <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.15), 0.05 * F.log1p(access_count.cast("double"))))
    fresh = F.when(recency_hours <= 0, F.lit(0.05)).when(recency_hours >= 48, F.lit(0.0)).otherwise(0.05 * (1 - recency_hours / 48.0))
    return clamp(by_type(memory_type, TYPE_BASE) + words + access + fresh)


def final_importance(score: Column, explicit: Column) -> Column:
    """Six tenths of the explicit value where one is given; rounded half to even at four digits."""
    s = clamp(score)
    return F.bround(F.coalesce(0.6 * explicit + 0.4 * s, s), 4)


def consolidation_confidence(count: Column, episodes: Column) -> Column:
    return F.least(F.lit(1.0), count / F.greatest(F.lit(1.0), episodes * 0.3))


def budget_remaining(budget: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), budget - used)


def budget_utilisation(budget: Column, used: Column) -> Column:
    return F.when(budget == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), used / budget))
