"""Scalar building blocks as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_point(features: Column, width: int) -> Column:
    """A point has the right width and finite values only."""
    return F.coalesce((F.size(features) == width) & F.forall(features, finite), F.lit(False))


def pad(features: Column, width: int) -> Column:
    """Zero-padding of a point to a fixed width."""
    return F.concat(features, F.array_repeat(F.lit(0.0), F.greatest(F.lit(width) - F.size(features), F.lit(0))))


def scaled(features: Column, scales: list[float]) -> Column:
    if any(not 0 < s < float("inf") for s in scales):
        raise ValueError("feature scales are finite and positive")
    return F.zip_with(features, F.array(*map(F.lit, scales)), lambda a, b: a * b)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < EPS, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std < EPS, F.lit(0.0)).otherwise((x - mean) / std)


SEVERITIES = ("Normal", "Low", "Medium", "High", "Critical")


@dataclass(frozen=True)
class SeverityBands:
    """Half-open bands: a score from ``low`` on is Low, and so on."""

    low: float = 2.0
    medium: float = 3.0
    high: float = 4.0
    critical: float = 5.0

    def __post_init__(self):
        edges = (self.low, self.medium, self.high, self.critical)
        if not (0 <= edges[0] < edges[1] < edges[2] < edges[3] < float("inf")):
            raise ValueError("bands ascend strictly from zero or more")

    def rank(self, score: Column) -> Column:
        r = sum((score >= e).cast("int") for e in (self.low, self.medium, self.high, self.critical))
        return F.when(finite(score), r).otherwise(F.lit(0))

    def label(self, score: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, SEVERITIES)), self.rank(score) + 1)


def drift_level(psi: Column) -> Column:
    return F.when(F.isnan(psi) | psi.isNull() | (psi < 0.10), "Stable").when(psi < 0.25, "Watch").otherwise("Alert")


def chi2_survival_even(x: Column, pairs: Column) -> Column:
    """Survival of chi-squared with 2 * pairs degrees of freedom, by its closed form."""
    half = x / 2
    fold = F.aggregate(F.sequence(F.lit(1), F.greatest(pairs, F.lit(1))), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, k: F.struct((s["term"] * half / k).alias("term"), (s["sum"] + s["term"]).alias("sum")), lambda s: s["sum"])
    return F.when(pairs <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-half) * fold)))


def fisher(p_values: Column) -> Column:
    """Combined p-value of an array; values that are not finite are skipped, none give 1."""
    ok = F.filter(p_values, finite)
    stat = F.aggregate(ok, F.lit(0.0), lambda s, p: s - 2 * F.ln(F.greatest(F.lit(EPS), F.least(F.lit(1.0), p))))
    return chi2_survival_even(stat, F.size(ok))


def per_dim(attribution: Column) -> Column:
    return F.zip_with(attribution["high"], attribution["low"], lambda a, b: a + b)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def first_argmax(values: Column) -> Column:
    """0-based place of the first maximum; null of an empty array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def group_score(attribution: Column, indices: list[int]) -> Column:
    """Sum of both directions over a named group's dimensions."""
    return sum((attribution["high"][i] + attribution["low"][i] for i in indices), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where either has no length."""
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def platt(score: Column, a: float, b: float) -> Column:
    return F.when(finite(score), 1 / (1 + F.exp(a * score + b))).otherwise(F.lit(0.5))


def confidence_interval(mean: Column, stderr: Column, z: float = 1.96) -> Column:
    return F.struct(F.greatest(F.lit(0.0), mean - z * stderr).alias("low"), (mean + z * stderr).alias("high"))


def attribution_confidence(mean: Column, std: Column) -> Column:
    """1 / (1 + coefficient of variation); 0 where the mean vanishes but not the spread."""
    cv = F.when(F.abs(mean) < EPS, F.when(std < EPS, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(std / F.abs(mean))
    return 1 / (1 + cv)


def pareto_p_value(excess: Column, mean: Column, var: Column, peaks: Column, seen: Column, q: float) -> Column:
    """Tail probability of a generalised Pareto fit by moments to the excesses over the q-quantile."""
    gamma = F.when(var > 0, F.greatest(F.lit(-5.0), F.least(F.lit(0.4999), 0.5 * (1 - mean * mean / var)))).otherwise(F.lit(0.0))
    sigma = mean * (1 + gamma)
    base = 1 + gamma * excess / sigma
    tail = F.when(F.abs(gamma) < 1e-9, F.exp(-excess / sigma)).when(base <= 0, F.lit(0.0)).otherwise(F.pow(F.greatest(base, F.lit(1e-300)), -1 / gamma))
    few = F.greatest(1.0 / seen, F.lit(1 - q))
    return F.when(excess <= 0, F.lit(1.0)).when((peaks < 16) | (sigma <= 0), few).otherwise(F.greatest((1 - q) * tail, 1.0 / (1000.0 * seen)))


def lsh_buckets(high: Column, low: Column, buckets: int = 16, cap: float = 8.0) -> Column:
    """One bucket per dimension of the signed attribution, clamped to the cap: the cluster's key."""
    if not 2 <= buckets <= 256 or not 0 < cap < float("inf"):
        raise ValueError("2 to 256 buckets and a finite cap")
    place = lambda v: F.least(F.lit(buckets - 1), F.floor((F.greatest(F.lit(-cap), F.least(F.lit(cap), v)) + cap) / (2 * cap) * buckets).cast("int"))
    return F.zip_with(high, low, lambda h, w: place(h - w))


def mixed_hash(value: Column, seed: int = 0) -> Column:
    """Keyed 64-bit hash for admission gates."""
    return F.xxhash64(F.lit(seed), value)
