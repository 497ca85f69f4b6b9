"""Detectors callable from SQL.

``register(spark)`` adds table functions that fold a table in order, one state a key:

    SELECT * FROM rcf_ema(TABLE(events) PARTITION BY user_id ORDER BY ts)

Each returns the table's own columns and its output fields; the input column is called ``value`` (or as the step
names it).  ``register_model(spark, model)`` adds ``rcf_score(features)`` and ``rcf_attribution(features)``
for a fitted forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import steps
from ..plans.fold import Step

#: table functions: name and step
STEPS: dict[str, Callable[[], Step]] = {
    "rcf_ema": steps.Ema,
    "rcf_ewma": steps.Ewma,
    "rcf_ewma_point": steps.EwmaPoint,
    "rcf_meta_drift": steps.MetaDrift,
    "rcf_threshold": steps.Threshold,
    "rcf_adwin": steps.Adwin,
    "rcf_spot": steps.Spot,
    "rcf_rate_cap": steps.RateCap,
    "rcf_space_saving": steps.SpaceSaving,
    "rcf_alert_clusters": steps.AlertClusters,
}


def table_function(make: Callable[[], Step]):
    """A table function of one table argument around a step."""
    inputs, added = make().inputs, T._parse_datatype_string(", ".join(f"{n} {k}" for n, k in make().fields)).fields

    class Fold:
        def __init__(self):
            self.step = make()

        @staticmethod
        def analyze(row):
            from pyspark.sql.udtf import AnalyzeResult

            missing = [c for c in inputs if c not in row.dataType.names]
            if missing:
                raise ValueError(f"no column {', '.join(missing)}")
            return AnalyzeResult(T.StructType([*row.dataType.fields, *added]))

        def eval(self, row):
            got = self.step.update(*[row[c] for c in inputs])
            if got is not None:
                yield (*row, *got)

    return F.udtf(Fold)


def register(spark: SparkSession) -> list[str]:
    for name, make in STEPS.items():
        spark.udtf.register(name, table_function(make))
    return sorted(STEPS)


def register_model(spark: SparkSession, model, prefix: str = "rcf") -> None:
    """``<prefix>_score`` and ``<prefix>_attribution`` of a forest; null for points that are not finite or of other width."""
    held = spark.sparkContext.broadcast(model.arrays())
    p = model.params

    def points(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        good = np.array([v is not None and len(v) == p.dimension and bool(np.isfinite(np.asarray(v, float)).all()) for v in column], bool)
        x = np.stack(column[good].to_list()).astype(float) if good.any() else np.zeros((0, p.dimension))
        return good, x * np.array(p.feature_scales) if p.feature_scales else x

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            good, x = points(column)
            out = np.full(len(column), np.nan)
            if len(x):
                out[good] = held.value.walk(x)[0].mean(axis=1)
            yield pd.Series(out).astype(object).where(pd.Series(good), None)

    @F.pandas_udf("struct<high: array<double>, low: array<double>>")
    def attribution(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in parts:
            good, x = points(column)
            both = np.zeros((len(x), 2 * p.dimension))
            if len(x):
                held.value.walk(x, lambda _, c: np.add(both, c, out=both))
                both /= len(held.value.roots)
            high, low = [None] * len(column), [None] * len(column)
            for place, row in zip(np.flatnonzero(good).tolist(), both, strict=True):
                high[place], low[place] = row[: p.dimension], row[p.dimension :]
            yield pd.DataFrame({"high": high, "low": low})

    spark.udf.register(f"{prefix}_score", score)
    spark.udf.register(f"{prefix}_attribution", attribution)
