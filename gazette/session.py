"""Session factory and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "gazette", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine assumes; any of them may be overridden."""
    n = cores or os.cpu_count() or 8
    builder = SparkSession.builder.appName(app).master(master or f"local[{n}]")
    base = {
        "spark.sql.shuffle.partitions": str(max(8, n)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    A cluster names it in spark.checkpoint.dir.  Only on one machine (master local[...]), as in tests, a temporary folder
    is set for the session where that is unset; on a cluster it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not at:
        if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="gazette-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _place(spark: SparkSession, path: str):
    """(file system, path) of a path, as the JVM has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _place(spark, path)
    return fs.exists(p)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage by a table in the shared folder: survives the loss of executors, is read only once written.

    The table is removed when the driver ends, or before by `remove`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    fs, p = _place(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.parquet(path)
    out._cut_at = path
    return out


def remove(df: DataFrame) -> None:
    """Remove the table of a `cut` that nothing needs any more; anything else is left alone."""
    path = getattr(df, "_cut_at", None)
    if path:
        fs, p = _place(df.sparkSession, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: work on a table of few and small files would else run in few tasks.  Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def distinct_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*[F.col(c) for c in cols]).agg(F.lit(1).alias("__n")).drop("__n")
