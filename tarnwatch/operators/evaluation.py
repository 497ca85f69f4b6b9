"""Evaluation protocols over labelled series (key, order, features, label)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fold import fold
from . import forest, sequences
from .aggregates import fit_normaliser
from .steps import Ema


def _split(df: DataFrame, key: str, order: str, share: float | None, train: int | None) -> DataFrame:
    """Adds ``_n`` (place from 1) and ``_train``: the first share of each series, or its first rows."""
    w = Window.partitionBy(key)
    out = df.withColumn("_n", F.row_number().over(w.orderBy(order)))
    return out.withColumn("_train", F.col("_n") <= (F.lit(train) if train is not None else F.floor(F.count("*").over(w) * share)))


def frozen(df: DataFrame, key: str, order: str, params: forest.ForestParams, train: int | None = None, share: float = 0.5, smoothing: float | None = 0.02) -> DataFrame:
    """Scores of the rows after each series' training part, under a forest of all training parts, z-scored on them.

    With ``smoothing`` the scores' exponential mean per series stands in ``smoothed``.
    """
    rows = _split(df, key, order, share, train)
    dims = [f"_d{i}" for i in range(params.dimension)]
    flat = rows.withColumns({d: F.col("features")[i].cast("double") for i, d in enumerate(dims)})
    fitted = fit_normaliser(flat.where("_train"), dims)
    scaled = F.array(*[F.when(F.lit(fitted[d]["std"] > 1e-12), (F.col(d) - fitted[d]["mean"]) / (fitted[d]["std"] or 1.0)).otherwise(0.0) for d in dims])
    points = flat.withColumn("features", scaled).drop(*dims)
    learned = points.where("_train").select(F.xxhash64(key, order).alias("point_id"), F.col("_n").alias("seq"), "features")
    model = forest.fit(learned, replace(params, feature_scales=None))
    scored = model.score(points.where(~F.col("_train"))).select(key, order, "label", "score", "codisp")
    if smoothing is None:
        return scored
    return fold(scored, [key], [order], [order, "label", "score"], lambda: Ema(smoothing), value="score").select(key, order, "label", "score", F.col("mean").alias("smoothed"))


def warm_share(df: DataFrame, key: str, order: str, value: str, lag: int, params: forest.ForestParams, share: float = 0.15) -> DataFrame:
    """Scalar series: windows of ``lag`` values, a forest of the first ``share`` of each series, scores of the rest."""
    windows = sequences.shingle(df, [key], [order], value, lag).withColumn("features", F.col("shingle").cast("array<double>")).drop("shingle")
    return frozen(windows, key, order, replace(params, dimension=lag), share=share, smoothing=None)


def report(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Area under ROC and separation of means per key; keys of one class have none."""
    rows = scored.withColumn("label", F.col("label").cast("boolean"))
    return sequences.roc_auc(rows, keys, score, "label").join(sequences.score_separation(rows, keys, score, "label"), keys)
