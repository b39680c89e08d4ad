"""Session settings, table access and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark").config("spark.driver.memory", memory)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the scan has fewer tasks than that, as for one small file; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def told(df: DataFrame, keep: list[str], array: str, place: str, element: str) -> DataFrame:
    """A row for each element of a computed array, with its place from 0; elements are not null.

    As an outer explode without its empty rows: for a plain one Spark infers that the array isn't empty, and moves that
    down to the scan, where the whole expression is computed once more, written out inside its own lambdas.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(place, element)).filter(F.col(element).isNotNull())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or a temporary one where it is unset on one machine (tests)."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them from there: cuts the lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless they find it by PYTHONPATH or the working folder."""
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == ROOT for p in found) or Path("tidemark").exists():
        return
    if getattr(spark.sparkContext, "_tidemark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in (ROOT / "tidemark").rglob("*.py"):
            out.write(source, source.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._tidemark_shipped = True
