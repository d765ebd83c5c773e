"""Running a stream over what has arrived, with results in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.session import cut, shared_dir


BATCH_ROWS = 1 << 20
LEAST_BATCHES = 4


def replay(df: DataFrame, order: str | None = None, batch_rows: int = BATCH_ROWS, batches: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back as a stream.

    With ``order`` it arrives in micro-batches that follow each other in that
    column, of about ``batch_rows`` rows and at least ``LEAST_BATCHES`` in all, or as many as asked for.
    Every batch is written by all tasks, to the same number of files, each with
    some of its rows, and a trigger takes just these.
    """
    spark, files = df.sparkSession, 0
    path = f"{shared_dir(spark)}/stream-in-{uuid.uuid4().hex}"
    if order is None:
        df.write.parquet(path)
    else:
        src = cut(df)
        batches = batches or max(LEAST_BATCHES, -(-src.count() // batch_rows))
        dealt = cut(src.repartitionByRange(batches, order).withColumn("_part", F.spark_partition_id()))
        sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # one row per batch
        files = min([spark.sparkContext.defaultParallelism, *sizes.values()])  # round robin: no file stays empty
        for i in sorted(sizes):  # a file source takes the oldest files first
            dealt.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(path)
        if not sizes:
            src.write.parquet(path)
    r = spark.readStream.schema(df.schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).parquet(path)


def drain(stream: DataFrame, mode: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Run until all input is used and return the written results.

    In update mode a result may be written again by a later batch; with
    ``keys`` only its latest version is kept.
    """
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-out-{uuid.uuid4().hex}"
    out = f"{base}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the folder of this batch makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if keys is None:
        return got.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, *[F.col("v")[c].alias(c) for c in rest])
