"""Alerts: records, calibration, feedback, Shapley explanations, audit chains."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import EPS, SeverityBands
from .steps import chain_tag

ALERT_VERSION = 1
MAX_PLAN_BYTES = 64 << 20
ALERT_SCHEMA = "version int, tenant string, timestamp_ms long, point array<double>, score double, grade struct<score: double, threshold: double, grade: double, is_anomaly: boolean, ready: boolean>, severity string, attribution struct<high: array<double>, low: array<double>>, baseline struct<observed: array<double>, expected: array<double>, stddev: array<double>, delta: array<double>, zscore: array<double>, live_points: bigint>"
ALERT_FIELDS = {"version", "tenant", "timestamp_ms", "point", "score", "grade", "severity", "attribution", "baseline"}


def baseline(samples: DataFrame, features: Column, dimension: int, scales: tuple[float, ...] | None = None) -> Column:
    """Struct of a point's place among the distinct sampled points, dimension by dimension; the sample's moments are one row."""
    x = [F.col("features")[i] / (scales[i] if scales else 1.0) for i in range(dimension)]
    points = samples.groupBy("point_id").agg(F.min(F.struct(*[c.alias(f"d{i}") for i, c in enumerate(x)])).alias("x"))
    row = points.agg(F.count("*").alias("n"), *[f(F.col(f"x.d{i}")).alias(f"{n}{i}") for i in range(dimension) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    mean = F.array(*[F.lit(row[f"m{i}"]).cast("double") for i in range(dimension)])
    std = F.array(*[F.lit(row[f"s{i}"] or 0.0).cast("double") for i in range(dimension)])
    delta = F.zip_with(features, mean, lambda a, b: a - b)
    z = F.zip_with(delta, std, lambda a, b: F.when(b < EPS, 0.0).otherwise(a / b))
    return F.struct(features.cast("array<double>").alias("observed"), mean.alias("expected"), std.alias("stddev"), delta.alias("delta"), z.alias("zscore"), F.lit(row["n"]).alias("live_points"))


def alert_records(attributed: DataFrame, tenant: str | None, timestamp_ms: str, bands: SeverityBands | None = None, model=None) -> DataFrame:
    """Versioned alert structs from rows with features, score, high and low.

    Columns threshold, grade, is_anomaly and ready, where there are all, make the grade; with a ``model`` the
    record has its baseline.  A record has every field of the schema, null where nothing is known."""
    bands = bands or SeverityBands()
    graded = {"threshold", "grade", "is_anomaly", "ready"} <= set(attributed.columns)
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(ALERT_SCHEMA).fields}
    grade = F.struct("score", "threshold", "grade", "is_anomaly", "ready") if graded else F.lit(None)
    base = baseline(model.samples, F.col("features"), model.params.dimension, model.params.feature_scales) if model else F.lit(None)
    made = {
        "version": F.lit(ALERT_VERSION),
        "tenant": F.col(tenant) if tenant else F.lit(None),
        "timestamp_ms": F.col(timestamp_ms),
        "point": F.col("features"),
        "score": F.col("score"),
        "grade": grade,
        "severity": bands.label(F.col("score")),
        "attribution": F.struct("high", "low"),
        "baseline": base,
    }
    return attributed.withColumn("alert", F.struct(*[made[n].cast(k).alias(n) for n, k in kinds.items()]))


def parse_alerts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strict reading of alert JSON: unknown fields, missing ones or another version are rejected with a reason."""
    keys = F.json_object_keys(column)
    parsed = F.from_json(column, ALERT_SCHEMA)
    unknown = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in sorted(ALERT_FIELDS)]))) > 0
    out = lines.withColumn("alert", parsed)
    reason = F.when(keys.isNull(), "not an object").when(unknown, "unknown field").when(F.col("alert.version").isNull() | (F.col("alert.version") != ALERT_VERSION), "version").when(F.col("alert.score").isNull() | F.col("alert.timestamp_ms").isNull(), "missing field")
    return out.withColumn("rejected", reason)


@dataclass(frozen=True)
class Platt:
    a: float
    b: float
    iterations: int
    converged: bool


def fit_platt(df: DataFrame, score: str, label: str, max_iterations: int = 100, tolerance: float = 1e-5, min_step: float = 1e-10, sigma: float = 1e-12) -> Platt:
    """Newton iterations with backtracking; each step is one aggregate, so rows never leave the executors."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).persist()
    pos, neg = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    t = F.when(F.col("y") == 1, high).otherwise(low)
    if not pos or not neg or max(pos, neg) > 100 * min(pos, neg):
        out = _skewed(rows)
        rows.unpersist()
        return out

    def loss(z):
        return F.when(z >= 0, t * z + F.log1p(F.exp(-z))).otherwise((t - 1) * z + F.log1p(F.exp(z)))

    def value(a: float, b: float) -> float:
        return rows.agg(F.sum(loss(a * F.col("s") + b))).first()[0]

    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    now = value(a, b)
    for n in range(1, max_iterations + 1):
        p = 1 / (1 + F.exp(a * F.col("s") + b))
        w, d = p * (1 - p), t - p
        h11, h22, h21, g1, g2 = rows.agg(F.sum(F.col("s") * F.col("s") * w), F.sum(w), F.sum(F.col("s") * w), F.sum(F.col("s") * d), F.sum(d)).first()
        h11, h22 = h11 + sigma, h22 + sigma
        if abs(g1) < tolerance and abs(g2) < tolerance:
            rows.unpersist()
            return Platt(a, b, n, True)
        det = h11 * h22 - h21 * h21
        da, db = -(h22 * g1 - h21 * g2) / det, -(-h21 * g1 + h11 * g2) / det
        slope, step = g1 * da + g2 * db, 1.0
        while step >= min_step:
            new = value(a + step * da, b + step * db)
            if new < now + 1e-4 * step * slope:
                a, b, now = a + step * da, b + step * db, new
                break
            step /= 2
        else:
            break
    rows.unpersist()
    return Platt(a, b, n, False)


def _skewed(rows: DataFrame, epochs: int = 16, rate: float = 0.01) -> Platt:
    """For one class or a skew over 100 to 1: full-batch gradient epochs, each one aggregate."""
    a, b = -1.0, 0.0
    for _ in range(epochs):
        p = 1 / (1 + F.exp(a * F.col("s") + b))
        ga, gb = rows.agg(F.avg((F.col("y") - p) * F.col("s")), F.avg(F.col("y") - p)).first()
        if ga is None:
            break
        a, b = a - rate * ga, b - rate * gb
    return Platt(a, b, epochs, True)


def adjust_by_feedback(probes: DataFrame, labels: DataFrame, score: str, features: str, capacity: int = 512, sigma: float = 1.0, strength: float = 1.0) -> DataFrame:
    """Moves each score by a Gaussian-kernel mean of the last labels: ``max(0, s + strength * sum(sign*k)/sum(k))``.

    Labels are the newest ``capacity`` (65,536 at most) rows of (seq, features, label), held as one
    array that is broadcast; the probes are not multiplied.
    """
    if not 1 <= capacity <= 65_536:
        raise ValueError("capacity 1 to 65,536")
    last = labels.orderBy(F.desc("seq")).limit(capacity).select(F.col("seq"), F.col(features).alias("f"), F.when(F.col("label") == "Confirmed", 1.0).otherwise(-1.0).alias("sign")).orderBy("seq").collect()
    if not last:
        return probes.withColumn("adjusted", F.col(score))
    points = np.array([r.f for r in last], float)
    signs = np.array([r.sign for r in last])

    @F.pandas_udf("double")
    def adjusted(s: pd.Series, f: pd.Series) -> pd.Series:
        x = np.stack(f.to_list()).astype(float) if len(f) else np.zeros((0, points.shape[1]))
        k = np.exp(-((x[:, None, :] - points[None]) ** 2).sum(axis=2) / (2 * sigma * sigma))
        weight = k.sum(axis=1)
        move = np.where(weight > 1e-12, strength * (k @ signs) / np.where(weight > 1e-12, weight, 1), 0)
        return pd.Series(np.where(weight > 1e-12, np.maximum(0, s + move), s))

    return probes.withColumn("adjusted", adjusted(score, features))


MAX_COLUMNS = 64


def shapley(df: DataFrame, score_points, dims: int, baseline: list[float], permutations: int = 64, seed: int = 2026, ids: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Permutation Shapley values of ``score_points(df) -> df with score`` against a baseline vector.

    Each row is scored once in every coalition that some permutation passes through (the same one in many), and the
    scores of a row meet as one row, not as permutations x (dims + 1); a contribution is the mean gain of a dimension over the
    permutations where both scores are known.  Rows need ``ids`` of their own; if they are dealt by some of these, nothing is shuffled.
    """
    if not 1 <= permutations <= 65_536:
        raise ValueError("1 to 65,536 permutations")
    if permutations * (dims + 1) * (dims + 4) * 8 > MAX_PLAN_BYTES:
        raise ValueError(f"permutations x dimensions make a plan of over {MAX_PLAN_BYTES >> 20} MB")
    spark, number, gains = df.sparkSession, {}, [Counter() for _ in range(dims)]
    for k in range(permutations):
        before = number.setdefault(frozenset(), len(number))
        order = np.random.default_rng([seed, k]).permutation(dims).tolist()
        for step, dim in enumerate(order, 1):
            after = number.setdefault(frozenset(order[:step]), len(number))
            gains[dim][before, after] += 1
            before = after
    plan = spark.createDataFrame([(c, [i in s for i in range(dims)]) for s, c in number.items()], "_c int, _in array<boolean>")
    mixed = F.array(*[F.when(F.col("_in")[i], F.get("features", F.lit(i))).otherwise(F.lit(float(baseline[i]))) for i in range(dims)])
    # every row with every coalition is what is asked for; the coalitions' size is checked above
    scored = score_points(df.select(*ids, "features").join(F.broadcast(plan)).select(*ids, "_c", mixed.alias("features")))
    if len(number) <= MAX_COLUMNS:
        met = scored.groupBy(*ids).agg(*[F.max(F.when(F.col("_c") == c, F.col("score"))).alias(f"_s{c}") for c in number.values()])
        mean = []
        for dim, pairs in enumerate(gains):
            each = [(F.col(f"_s{b}") - F.col(f"_s{a}"), n) for (a, b), n in pairs.items()]
            whole, known = sum((F.coalesce(g * n, F.lit(0.0)) for g, n in each), F.lit(0.0)), sum((F.when(g.isNotNull(), n).otherwise(0) for g, n in each), F.lit(0))
            mean.append(F.struct(F.lit(dim).alias("dim"), F.when(known > 0, whole / known).alias("contribution")))
        return met.select(*ids, F.inline(F.array(*mean)))
    met = scored.groupBy(*ids).agg(F.transform(F.sort_array(F.collect_list(F.struct("_c", "score"))), lambda x: x["score"]).alias("_s"))
    pairs = spark.createDataFrame([(dim, [(a, b, n) for (a, b), n in g.items()]) for dim, g in enumerate(gains)], "dim int, _g array<struct<a: int, b: int, n: int>>")

    def take(acc: Column, g: Column) -> Column:
        gain = F.get("_s", g["b"]) - F.get("_s", g["a"])
        return F.when(gain.isNull(), acc).otherwise(F.struct((acc["whole"] + gain * g["n"]).alias("whole"), (acc["known"] + g["n"]).alias("known")))

    mean = F.aggregate("_g", F.struct(F.lit(0.0).alias("whole"), F.lit(0).alias("known")), take, lambda acc: F.when(acc["known"] > 0, acc["whole"] / acc["known"]))
    return met.join(F.broadcast(pairs)).select(*ids, "dim", mean.alias("contribution"))


def sage(model, df: DataFrame, baseline: list[float], permutations: int = 64, seed: int = 2026) -> DataFrame:
    """Shapley values of a forest's score; per row they sum to its score less the baseline's."""
    return shapley(df, model.score, model.params.dimension, baseline, permutations, seed)


def verify_chain(entries: DataFrame, key: bytes, chain: list[str], first_prev: bytes = bytes(32), expected_last: int | None = None) -> DataFrame:
    """First broken seq per chain and why; no rows where all is well.  Each row is checked on its own
    beside its predecessor's tag, so verification is parallel."""
    import hmac

    @F.pandas_udf("boolean")
    def tag_ok(seq: pd.Series, prev: pd.Series, record: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series([hmac.compare_digest(chain_tag(key, int(s), bytes(p), r), bytes(t)) for s, p, r, t in zip(seq, prev, record, tag, strict=True)])

    w = Window.partitionBy(*chain).orderBy("seq")
    before_seq, before_tag = F.lag("seq").over(w), F.lag("tag").over(w)
    checked = entries.withColumns({"_bs": before_seq, "_bt": before_tag}).withColumn("_ok", tag_ok("seq", "prev_tag", "record", "tag"))
    why = F.when(F.col("_bs").isNotNull() & (F.col("seq") != F.col("_bs") + 1), "gap").when(F.coalesce(F.col("_bt"), F.when(F.col("seq") == 0, F.lit(bytearray(first_prev)))) != F.col("prev_tag"), "link").when(~F.col("_ok"), "tag")
    broken = checked.withColumn("why", why).where("why is not null").groupBy(*chain).agg(F.min(F.struct("seq", "why")).alias("b")).select(*chain, "b.seq", "b.why")
    if expected_last is None:
        return broken
    short = entries.groupBy(*chain).agg(F.max("seq").alias("seq")).where(F.col("seq") != expected_last).withColumn("why", F.lit("truncated"))
    return broken.unionByName(short)


def alert_json(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"))
