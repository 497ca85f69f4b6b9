"""Order-free operators: statistics, normaliser, histograms, drift by histograms, sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn


def stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample variance and deviation (0 below two values) of finite values."""
    v = F.when(fn.finite(F.col(value)), F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"))


def fit_normaliser(df: DataFrame, dims: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population deviation, minimum and maximum per dimension; identity for no rows."""
    row = df.agg(*[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
    identity = {"mean": 0.0, "std": 1.0, "min": 0.0, "max": 1.0}
    return {d: {n: identity[n] if row[f"{d}_{n}"] is None else row[f"{d}_{n}"] for n in identity} for d in dims}


def normalise(df: DataFrame, params: dict, strategy: str) -> DataFrame:
    """Replaces each fitted dimension: ``minmax``, ``zscore`` or ``none``."""
    if strategy == "none":
        return df
    if strategy not in ("minmax", "zscore"):
        raise ValueError(strategy)
    lit = lambda d, n: F.lit(float(params[d][n]))
    return df.withColumns({d: fn.min_max(F.col(d), lit(d, "min"), lit(d, "max")) if strategy == "minmax" else fn.z_score(F.col(d), lit(d, "mean"), lit(d, "std")) for d in params})


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """-1 under, ``bins`` over the range, -2 not finite; the top edge belongs to the last bin."""
    if not (math.isfinite(low) and math.isfinite(high) and low < high and bins >= 1):
        raise ValueError("a finite range and one bin at least")
    inside = F.least(F.floor((value - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return F.when(~fn.finite(value), -2).when(value < low, -1).when(value > high, bins).otherwise(inside)


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int = 32) -> DataFrame:
    """Counts by key and bin; two histograms of one range merge by summing."""
    return df.groupBy(*keys, histogram_bin(F.col(value), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, keys: list[str], p: float, low: float, high: float, bins: int = 32) -> DataFrame:
    """The p-quantile (p in 0..1) by linear interpolation inside its bin, of in-range counts."""
    w = Window.partitionBy(*keys).orderBy("bin")
    width = (high - low) / bins
    inside = hist.where(F.col("bin").between(0, bins - 1)).withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*keys))})
    hit = inside.withColumn("rank", F.lit(float(p)) * F.col("all")).where((F.col("upto") >= F.col("rank")) & (F.col("n") > 0)).withColumn("k", F.row_number().over(w)).where("k = 1")
    return hit.select(*keys, (F.lit(low) + width * (F.col("bin") + (F.col("rank") - (F.col("upto") - F.col("n"))) / F.col("n"))).alias("percentile"))


def drift(baseline: DataFrame, production: DataFrame, dims: list[str], keys: list[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """PSI and KL per key and dimension against frozen equal-width bins of the baseline's range.

    One pass gives the baseline's range, one its histogram, one the production's; what is
    joined are histograms (dims x bins rows a key), never rows of data.
    """
    edge = baseline.agg(*[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("min", F.min), ("max", F.max))]).first()

    def binned(df: DataFrame, by: list[str]) -> DataFrame:
        out = []
        for d in dims:
            low, high = edge[f"{d}_min"], edge[f"{d}_max"]
            if low is None:
                continue
            if low == high:
                low, high = low - 0.5, high + 0.5
            v = F.col(d)
            place = F.when(v <= low, 0).when(v >= high, bins - 1).otherwise(F.least(F.floor((v - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1)))
            out.append(F.struct(F.lit(d).alias("dim"), F.when(fn.finite(v.cast("double")), place).alias("bin")))
        if not out:
            raise ValueError("the baseline has no rows")
        return df.select(*by, F.explode(F.array(*out)).alias("x")).select(*by, "x.dim", "x.bin").where("bin is not null").groupBy(*by, "dim", "bin").agg(F.count("*").alias("n"))

    base = binned(baseline, []).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("dim"))).select("dim", "bin", "p")
    prod = binned(production, keys).withColumn("q", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "dim"))).select(*keys, "dim", "bin", "q")
    grid = prod.select(*keys, "dim").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = grid.join(prod, [*keys, "dim", "bin"], "left").join(base, ["dim", "bin"], "left")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(floor)) for c in "pq")
    out = both.groupBy(*keys, "dim").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"), F.sum(q * F.ln(q / p)).alias("kl"))
    return out.withColumn("level", fn.drift_level(F.col("psi")))


def top_drift(scored: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """The dimension of the largest PSI per key; the first of equals, none if all are zero."""
    order = F.array_position(F.array(*map(F.lit, dims)), F.col("dim"))
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("psi"), order))
    return scored.where("psi > 0").withColumn("_k", k).where("_k = 1").drop("_k")


def count_min(df: DataFrame, key: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """Counters (row, col, n): each task sends at most width x depth partial counts."""
    if not (1 <= width <= 1 << 18 and 1 <= depth <= 16):
        raise ValueError("width up to 2^18 and depth up to 16")
    return df.select(F.posexplode(F.array(*[count_min_column(F.col(key), r, width) for r in range(depth)])).alias("row", "col")).groupBy("row", "col").agg(F.count("*").alias("n"))


def count_min_column(key: Column, row: int, width: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{row}")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


def count_min_estimate(sketch: DataFrame, keys: DataFrame, key: str, width: int = 2048, depth: int = 4) -> DataFrame:
    """Smallest of a key's counters; never below its count.  The sketch is at most width x depth rows."""
    probes = keys.select(key, F.posexplode(F.array(*[count_min_column(F.col(key), r, width) for r in range(depth)])).alias("row", "col"))
    return probes.join(sketch, ["row", "col"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def hyperloglog(df: DataFrame, keys: list[str], value: str, precision: int = 12) -> DataFrame:
    """Registers (key, register, rho); two sketches merge by the maximum."""
    if not 4 <= precision <= 16:
        raise ValueError("precision 4 to 16")
    h = F.conv(F.substring(F.md5(F.col(value).cast("string").cast("binary")), 1, 13), 16, 10).cast("long")  # 52 bits
    rest = h.bitwiseAND(F.lit((1 << (52 - precision)) - 1))
    rho = (F.lit(52 - precision + 1) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest)))).cast("int")
    return df.where(F.col(value).isNotNull()).select(*keys, F.shiftright(h, 52 - precision).alias("register"), rho.alias("rho")).groupBy(*keys, "register").agg(F.max("rho").alias("rho"))


def hyperloglog_estimate(registers: DataFrame, keys: list[str], precision: int = 12) -> DataFrame:
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    out = registers.groupBy(*keys).agg(F.count("*").alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"))
    raw = F.lit(alpha * m * m) / (F.col("s") + (F.lit(m) - F.col("used")))
    zeros = F.lit(m) - F.col("used")
    return out.select(*keys, F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(float(m)) * F.ln(F.lit(float(m)) / zeros)).otherwise(raw).alias("estimate"))


def bloom_shape(capacity: int, rate: float = 0.01) -> tuple[int, int]:
    """Bits and hashes for a capacity and false-positive rate."""
    if capacity < 1 or not 0 < rate < 1:
        raise ValueError("capacity from 1 and rate between 0 and 1")
    bits = math.ceil(-capacity * math.log(rate) / math.log(2) ** 2)
    if bits > 1 << 30:
        raise ValueError("over 2^30 bits")
    return bits, min(64, max(1, round(bits / capacity * math.log(2))))


def bloom_places(value: Column, bits: int, hashes: int) -> Column:
    digest = F.md5(value.cast("string").cast("binary"))
    one, two = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.array_distinct(F.array(*[F.pmod(one + i * two, F.lit(bits)) for i in range(hashes)]))


def bloom(df: DataFrame, value: str, bits: int, hashes: int) -> DataFrame:
    """Set bits by 64-bit word: rows (word, mask); the union of two filters is the OR of masks."""
    at = df.where(F.col(value).isNotNull()).select(F.explode(bloom_places(F.col(value), bits, hashes)).alias("bit"))
    return at.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def bloom_contains(filter_: DataFrame, probes: DataFrame, value: str, bits: int, hashes: int) -> DataFrame:
    """Distinct probe values and whether all their bits are set.  Filter and probes meet by word."""
    p = probes.select(value).distinct().select(value, F.explode(bloom_places(F.col(value), bits, hashes)).alias("bit")).withColumn("word", F.shiftright("bit", 6))
    hit = F.coalesce(F.expr("getbit(mask, cast(bit & 63 as int))"), F.lit(0).cast("tinyint"))
    return p.join(filter_, "word", "left").groupBy(value).agg((F.min(hit) == 1).alias("contained"))


def bloom_fill_rate(filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """False-positive rate at the present fill."""
    return filter_.agg(F.pow(F.coalesce(F.sum(F.bit_count("mask")), F.lit(0)) / bits, F.lit(float(hashes))).alias("effective_fpr"))


def heavy_hitters(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys, exactly, with ranks from 0; ties by key."""
    counted = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), key)) - 1)


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact interpolated quantiles: a group's distinct values meet in one task.  For large groups use :func:`sketched_quantiles`."""
    return df.where(fn.finite(F.col(value))).groupBy(*keys).agg(*[F.percentile(value, q).alias(f"q{round(q * 1000)}") for q in qs])


def sketched_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], k: int = 400) -> DataFrame:
    """Mergeable KLL quantiles with the exact minimum, maximum and weight."""
    out = df.where(fn.finite(F.col(value))).groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("_s"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("weight"))
    return out.select(*keys, "min", "max", "weight", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(f"q{round(q * 1000)}") for q in qs])


def union_of(one: DataFrame, two: DataFrame, kind: str) -> DataFrame:
    """Union of two sketches of one shape: ``histogram`` and ``count_min`` add, ``hyperloglog`` takes the larger, ``bloom`` either bit."""
    column, merge = {"histogram": ("n", F.sum), "count_min": ("n", F.sum), "hyperloglog": ("rho", F.max), "bloom": ("mask", F.bit_or)}[kind]
    if set(one.columns) != set(two.columns):
        raise ValueError("sketches of different shape")
    keys = [c for c in one.columns if c != column]
    return one.unionByName(two).groupBy(*keys).agg(merge(column).alias(column))


def forensic(samples: DataFrame, probe: dict[str, float], distinct: bool = True) -> DataFrame:
    """Per dimension: observed, mean, sample deviation, delta and z of a probe against sampled points.

    A point_id counts once, as it may be in the samples of many trees, or (``distinct`` false) every row, without a shuffle of them."""
    points = samples.groupBy("point_id").agg(F.min(F.struct(*probe)).alias("x")).select("x.*") if distinct else samples.select(*probe)
    one = points.agg(F.count("*").alias("live_points"), *[f(d).alias(f"{d}_{n}") for d in probe for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    parts = []
    for d, x in probe.items():
        mean, std = F.col(f"{d}_m"), F.coalesce(F.col(f"{d}_s"), F.lit(0.0))
        parts.append(F.struct(F.lit(d).alias("dim"), F.lit(float(x)).alias("observed"), mean.alias("expected"), std.alias("stddev"), (F.lit(float(x)) - mean).alias("delta"), F.when(std < fn.EPS, 0.0).otherwise((F.lit(float(x)) - mean) / std).alias("zscore")))
    return one.select("live_points", F.explode(F.array(*parts)).alias("x")).select("live_points", "x.*")
