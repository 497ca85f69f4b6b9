"""Detectors made of a forest and something else: a threshold, a lag window, or a shadow that replaces it after drift.

All are values: a call that learns returns the next version, so batches, streams (``foreachBatch``) and
retries see whole versions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import state
from ..plans.fold import fold, states
from . import forest as rcf
from . import sequences
from .aggregates import forensic
from .steps import Adwin, Threshold

THRESHOLD_FIELDS = "n long, mean double, variance double, threshold double, span double, ready boolean"


def standing(of: DataFrame, keys: list[str], make: Callable[[], Threshold]) -> DataFrame:
    """Per key what its threshold stands at: observations, mean, variance, threshold, span, ready."""
    kinds = ", ".join(f"{k} {of.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdfs):
        for pdf in pdfs:
            rows = [(*key, *state.load(raw, make()).standing()) for *key, raw in pdf[[*keys, "state"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*keys, "n", "mean", "variance", "threshold", "span", "ready"])

    return of.mapInPandas(run, f"{kinds}, {THRESHOLD_FIELDS}")


@dataclass
class ThresholdedForest:
    """A forest whose scores are graded per key against what the key's earlier scores were.

    ``states`` (keys, state) has what the keys' thresholds have seen; None begins anew.
    """

    model: rcf.ForestModel
    make: Callable[[], Threshold] = Threshold
    states: DataFrame | None = None

    def process(self, points: DataFrame, keys: list[str], order: list[str], carry: list[str] | None = None, learn: bool = True) -> tuple[DataFrame, ThresholdedForest]:
        """Scores under the present model, each graded before it is recorded; and the detector that has learned the points.

        Points have keys, order, features, and for ``learn`` also point_id and seq (and ts, if any); ids and
        timestamps named in ``carry`` stay beside the grades.
        """
        more = {f.split()[0] for f in rcf.SCORES.split(", ")} - {"score", *points.columns}
        scored = self.model.score(points) if more & {*keys, *order, *(carry or [])} else self.model.mean(points)
        graded = fold(scored, keys, order, [*(carry or []), *order, "score"], self.make, self.states, value="score")
        after = states(scored, keys, order, self.make, self.states, value="score")
        if self.states is not None:  # keys without new rows keep what they have
            after = after.unionByName(self.states.join(after.select(*keys), keys, "left_anti"))
        return graded, replace(self, model=self.model.update(points) if learn else self.model, states=after)

    def score_only(self, points: DataFrame, keys: list[str]) -> DataFrame:
        """Grades against the present thresholds; nothing is learned or recorded."""
        now, floor = self.stats(keys), self.make().min_threshold
        out = self.model.score(points).join(now.select(*keys, F.col("threshold").alias("_t"), "span", F.col("ready").alias("_r")), keys, "left")
        ready = F.coalesce("_r", F.lit(False))
        over = ready & (F.col("score") > F.col("_t"))
        grade = F.when(over, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - F.col("_t")) / F.col("span")))).otherwise(0.0)
        return out.select(*points.columns, "score", F.coalesce("_t", F.lit(floor)).alias("threshold"), grade.alias("grade"), over.alias("is_anomaly"), ready.alias("ready"))

    def stats(self, keys: list[str]) -> DataFrame:
        """Observations, mean, variance and present threshold of every key."""
        if self.states is None:
            raise ValueError("nothing processed yet")
        return standing(self.states, keys, self.make)

    def reset_stats(self) -> ThresholdedForest:
        return replace(self, states=None)

    def attribution(self, points: DataFrame) -> DataFrame:
        return self.model.attribute(points)

    def forensic_baseline(self, probe: dict[str, float]) -> DataFrame:
        """A probe's place among the sampled points, dimension by dimension, in the points' own units."""
        scales = self.model.params.feature_scales or (1.0,) * self.model.params.dimension
        rows = self.model.samples.select("point_id", *[(F.col("features")[i] / s).alias(d) for i, (d, s) in enumerate(zip(probe, scales, strict=True))])
        return forensic(rows, probe)

    def delete(self, ids: DataFrame) -> ThresholdedForest:
        return replace(self, model=self.model.delete(ids))

    def delete_before(self, cutoff: int) -> ThresholdedForest:
        return replace(self, model=self.model.delete_before(cutoff))

    def save(self, path: str) -> None:
        self.model.save(f"{path}/forest")
        if self.states is not None:
            self.states.write.mode("overwrite").parquet(f"{path}/states")

    @classmethod
    def load(cls, spark, path: str, make: Callable[[], Threshold] = Threshold) -> ThresholdedForest:
        """States are checked when they are read: version, kind and ranges."""
        from pyspark.errors import AnalysisException

        try:
            kept = spark.read.parquet(f"{path}/states")
        except AnalysisException:
            kept = None
        return cls(rcf.load(spark, f"{path}/forest"), make, kept)


@dataclass
class ShingledForest:
    """A forest over windows of the last ``params.dimension`` values of each key.

    The forest has learned every full window but a key's newest (a window is learned when the next
    value arrives), and a value is scored in the window that it completes, once as many values precede it.
    """

    params: rcf.ForestParams
    model: rcf.ForestModel

    @classmethod
    def fit(cls, series: DataFrame, keys: list[str], order: list[str], value: str, params: rcf.ForestParams) -> ShingledForest:
        rows = sequences.shingle(series, keys, order, value, params.dimension)
        newest = F.lead(value).over(sequences.Window.partitionBy(*keys).orderBy(*order))
        learned = rows.withColumn("_next", newest).where("_next is not null")
        points = learned.select(F.xxhash64(*keys, *order).alias("point_id"), F.row_number().over(sequences.Window.partitionBy(*keys).orderBy(*order)).alias("seq"), F.col("shingle").cast("array<double>").alias("features"))
        return cls(params, rcf.fit(points, params))

    def _windows(self, series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
        """Windows that end in a value with a full window before it."""
        n = F.row_number().over(sequences.Window.partitionBy(*keys).orderBy(*order))
        rows = sequences.shingle(series.withColumn("_n", n), keys, order, value, self.params.dimension)
        return rows.where(F.col("_n") > self.params.dimension).drop("_n").withColumn("features", F.col("shingle").cast("array<double>")).drop("shingle")

    def score(self, series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
        """Adds the scores (and ``codisp``, without insertion) of the values; values of the warm-up have no row."""
        return self.model.score(self._windows(series, keys, order, value)).drop("features")

    def attribution(self, series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
        """High and low per lag, the oldest first."""
        return self.model.attribute(self._windows(series, keys, order, value)).drop("features")

    def current_shingle(self, series: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
        """Each key's last window and whether it is full."""
        last = F.row_number().over(sequences.Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
        tail = series.withColumn("_k", last).where(F.col("_k") <= self.params.dimension)
        kept = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_k")).alias("k"), F.col(value).alias("v")))), lambda x: x["v"])
        return tail.groupBy(*keys).agg(kept.alias("shingle")).withColumn("full", F.size("shingle") == self.params.dimension)


@dataclass(frozen=True)
class DriftRecovery:
    """A shadow replaces the primary after ``warmup`` rows; a primary younger than ``min_age`` spawns none."""

    warmup: int = 1024
    min_age: int = 512


@dataclass(frozen=True)
class DriftAwareForest:
    """A primary that scores, and after drift a shadow that learns fresh rows only until it takes over."""

    params: rcf.ForestParams
    config: DriftRecovery = DriftRecovery()
    primary: rcf.ForestModel | None = None
    primary_age: int = 0
    shadow: rcf.ForestModel | None = None
    recovering: bool = False
    swaps: int = 0

    @property
    def shadow_progress(self) -> int:
        return self.shadow.updates_seen if self.shadow else 0

    def update(self, points: DataFrame) -> DriftAwareForest:
        """Primary and shadow learn the points; the shadow takes over once it has seen enough."""
        before = self.primary.updates_seen if self.primary else 0
        primary = self.primary.update(points) if self.primary else rcf.fit(points, self.params)
        out = replace(self, primary=primary, primary_age=self.primary_age + primary.updates_seen - before)
        if not self.recovering:
            return out
        shadow = self.shadow.update(points) if self.shadow else rcf.fit(points, self.params)
        if shadow.updates_seen < self.config.warmup:
            return replace(out, shadow=shadow)
        return replace(out, primary=shadow, primary_age=shadow.updates_seen, shadow=None, recovering=False, swaps=self.swaps + 1)

    def on_drift(self) -> tuple[DriftAwareForest, bool]:
        """Begins a shadow, unless there is one or the primary is too young; whether it did."""
        if self.recovering or self.primary_age < self.config.min_age:
            return self, False
        return replace(self, recovering=True, shadow=None), True

    def abort_shadow(self) -> DriftAwareForest:
        return replace(self, recovering=False, shadow=None)

    def watch(self, scored: DataFrame, keys: list[str], order: list[str], value: str = "score", make: Callable[[], Adwin] = Adwin) -> tuple[DriftAwareForest, bool]:
        """:meth:`on_drift` if ADWIN fires on any key of the scores."""
        fired = fold(scored, keys, order, [], make, value=value).where("drift").limit(1).count() > 0
        return self.on_drift() if fired else (self, False)

    def score(self, points: DataFrame, **how) -> DataFrame:
        if self.primary is None:
            raise ValueError("empty forest")
        return self.primary.score(points, **how)

    def attribution(self, points: DataFrame) -> DataFrame:
        if self.primary is None:
            raise ValueError("empty forest")
        return self.primary.attribute(points)
