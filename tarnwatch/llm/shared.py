"""Folders that every executor sees, and the cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        else:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that they share")
            folder = tempfile.mkdtemp(prefix="tarnwatch-")
            spark.sparkContext.setCheckpointDir(folder)
    return str(folder).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the reliable checkpoint from now on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that :func:`new_folder` named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


FILTER_WORDS = 1 << 17


def likely(df: DataFrame, ids: DataFrame, name: str, kept: bool = True) -> DataFrame:
    """Rows whose ``name`` may be in the one column of ``ids``, or with ``kept=False`` all others, which are surely not.

    Only ``FILTER_WORDS`` rows of 64 bits are broadcast, however many ids there are; an exact join of the likely rows is to follow."""

    def bit(column):
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(64 * FILTER_WORDS))

    at = bit(F.col(ids.columns[0]))
    words = settled(ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_bits")))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.floor(bit(F.col(f"`{name}`")) / 64).alias("_word"), (bit(F.col(f"`{name}`")) % 64).cast("int").alias("_at"))
    hit = F.coalesce(F.expr("shiftright(_bits, _at) & 1L"), F.lit(0)) == 1
    found = rows.join(F.broadcast(words), "_word", "left").where(hit if kept else ~hit)
    return found.select("row.*")


BATCH_BYTES = 2 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches to Python workers of this session end at ``BATCH_BYTES``, unless it says otherwise.

    By number of rows alone a batch of long texts takes tens of MB, several times over, beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) in (None, "-1", str((1 << 31) - 1), str(256 << 20), "256MB", "64MB", str(64 << 20)):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df
