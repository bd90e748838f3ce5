"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import InvalidArgument


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(table_path(sf_dir, name))


def parallelism(spark: SparkSession) -> int:
    """Tasks that the cluster can run at once (at least two)."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Equal input splits for a Python stage.

    A file with few row groups gives few splits, whatever its size; a
    round-robin exchange makes them equal.  When the scan already yields as
    many partitions as there are cores the rows stay where they are, so at
    scale nothing is shuffled here.
    """
    if df.isStreaming:
        return df
    cores = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * per_core)


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local master, as in
    tests, may have none and takes ``fallback`` or a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidArgument("spark.checkpoint.dir must name a folder that all executors share")
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="millrace-")
    return fallback


def ensure_checkpoint(spark: SparkSession) -> None:
    """Makes ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so they need no install of it."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(path))  # the driver serves the file; executors fetch it
    sc._millrace_shipped = True
