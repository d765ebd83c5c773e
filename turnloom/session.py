"""Session helper and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "turnloom", cpus: int | None = None) -> SparkSession:
    """Local session for tests and the benchmark; clusters pass their own."""
    n = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", os.environ.get("TURNLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since executors could not share the files.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    named = tempfile.mkdtemp(prefix="turnloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder, so that an iterative plan stays short.

    A written table costs one re-read when an executor is lost, carries true
    sizes into the next plan, and unlike a checkpointed plan no constraints
    that would grow from round to round.  The folder is scratch space.

    The shuffle files behind it go as soon as it is written: nothing reads them again,
    and the driver's collector would leave them for as long as it has memory.
    ``group_rows``: rows of a row group at most, where rows are so large that
    writers and readers must not hold many.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` that nothing will read again, such as that of the round before."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
