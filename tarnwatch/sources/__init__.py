"""Labelled CSV series, label windows, and a metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TRUE, _FALSE = ("1", "1.0", "true", "True", "TRUE"), ("0", "0.0", "false", "False", "FALSE")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Features as doubles and a boolean label: the last header equal to ``label`` in any case.

    A row of the wrong width, a cell that is no number or another label fails the read; blank lines are skipped.
    """
    header = spark.read.text(path).where("trim(value) <> ''").first()
    if header is None:
        raise ValueError("no header")
    names = [c.strip() for c in header[0].split(",")]
    places = [k for k, c in enumerate(names) if c.lower() == "label"]
    if not places:
        raise ValueError("no label column")
    at = places[-1]
    schema = T.StructType([T.StructField(f"c{k}", T.StringType() if k == at else T.DoubleType()) for k in range(len(names))])
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    label = F.when(F.col(f"c{at}").isin(*_TRUE), True).when(F.col(f"c{at}").isin(*_FALSE), False).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(F.col(f"c{at}"), F.lit("null")))).cast("boolean"))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names) if k != at], label.alias("label"))


def name_parts(path_column) -> list:
    """Number, data set, training length and first anomaly from names ``NNN_DATASET_id_.._tr_N_1st_N.csv``."""
    part = lambda r, k: F.regexp_extract(path_column, r, k)
    return [part(r"(\d+)_([A-Za-z0-9]+)_id_", 1).cast("int").alias("number"), part(r"(\d+)_([A-Za-z0-9]+)_id_", 2).alias("dataset"), part(r"_tr_(\d+)_", 1).cast("int").alias("train"), part(r"_1st_(\d+)\.csv", 1).cast("int").alias("first_anomaly")]


def label_by_windows(rows: DataFrame, windows: DataFrame, series: str, ts: str) -> DataFrame:
    """A row is anomalous if its time lies in a window (series, start, end; both ends included)."""
    w = windows.select(F.col("series").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    marked = rows.join(w, (F.col(series) == F.col("_s")) & F.col(ts).between(F.col("_a"), F.col("_b")), "left_semi").withColumn("label", F.lit(True))
    rest = rows.join(w, (F.col(series) == F.col("_s")) & F.col(ts).between(F.col("_a"), F.col("_b")), "left_anti").withColumn("label", F.lit(False))
    return marked.unionByName(rest)


def windows_json(spark: SparkSession, path: str) -> DataFrame:
    """(series, start, end) of a JSON object {file: [[start, end], ...]}."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("series", "w"))
    return pairs.select("series", F.explode("w").alias("p")).select("series", F.substring(F.col("p")[0], 1, 19).alias("start"), F.substring(F.col("p")[1], 1, 19).alias("end"))


def metrics_rows(df: DataFrame, name: str) -> tuple[DataFrame, object]:
    """The same rows, and an Observation that counts them without a second pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def metrics_table(spark: SparkSession, values: dict[str, float], kind: str = "counter") -> DataFrame:
    """Long table (name, kind, value)."""
    return spark.createDataFrame([(n, kind, float(v)) for n, v in values.items()], "name string, kind string, value double")
