"""Test tables reshaped into speech, shots, frames, texts and order networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.plans.ordered import neighbours, row_index, running, time_block

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
TASK_ROWS = 1 << 19  # lines of orders in a task, however large the table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than cores; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _ms():
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("long")


def _grid(col: str, size: int):
    return F.floor(F.col(col) / F.lit(size))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as speech segments of hour-long units inside day-long episodes."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seg_idx"),
        _ms().alias("start_ms"),
        "value",
        F.when(F.col("event_type") == "error", "")
        .when(F.col("event_type") == "signup", "S")
        .otherwise(F.concat(F.lit("spk"), F.lpad((F.col("user_id") % 12).cast("string"), 2, "0")))
        .alias("speaker"),
    )
    e = e.withColumn("episode", _grid("start_ms", DAY_MS).cast("int")).withColumn("unit", _grid("start_ms", HOUR_MS).cast("int"))
    e = neighbours(e, ["episode"], ["start_ms", "seg_idx"], time_block("start_ms"), nxt={"nxt_start": F.col("start_ms")})
    end = F.least(
        F.col("start_ms") + F.round(F.lit(1000) * F.col("value")).cast("long"),
        F.coalesce("nxt_start", (F.col("episode") + 1) * F.lit(DAY_MS).cast("long")),
    )
    return e.select(
        F.floor(F.col("episode") / F.lit(7)).cast("int").alias("season"),
        "episode", "unit", "seg_idx", "speaker", "start_ms", end.alias("end_ms"),
    )


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).where("speaker not in ('', 'S')")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as speech: 60 ms per character, one unit per conversation."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("unit"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker"),
        (F.length("text") * F.lit(60)).cast("long").alias("dur"),
    )
    c = running(c, ["unit"], ["seg_idx"], F.floor(F.col("seg_idx") / F.lit(1024)), {"end_ms": ("sum", F.col("dur"))})
    return c.select("unit", "seg_idx", "speaker", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, supplier nation): the speakers of an order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    sp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # dealt by order once, for the counts, the join and what groups by order after that
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // TASK_ROWS))
    per = (
        li.join(sp, li.l_suppkey == sp.s_suppkey)
        .join(na, sp.s_nationkey == na.n_nationkey)
        .select(F.col("l_orderkey").alias("unit"), F.col("n_name").alias("speaker"))
        .repartition(parts, "unit")
        .groupBy("unit", "speaker")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 23941).cast("int")
    return per.join(od.hint("merge"), per.unit == od.o_orderkey).select("unit", month.alias("month_idx"), "speaker", "n")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("string").alias("label"),
        F.expr("vec_id div 20").cast("int").alias("unit"),
        (F.col("vec_id") % 20).cast("int").alias("pos"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of one video per 100 vectors; 64 values are 4 blocks of a 16-bin histogram."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 100").cast("int").alias("video"),
        (F.col("vec_id") % 100).cast("int").alias("frame_idx"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: F.abs(v)).alias("hist"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as segments."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("doc_id").alias("unit"), "source", F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "text"))
    return d


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as shots: camera labels, source and hour-long scenes."""
    e = (
        table(spark, sf_dir, "events").where("event_type = 'view'")
        .select(F.col("event_id").alias("shot_id"), _ms().alias("start_ms"), "user_id")
        .withColumn("episode", _grid("start_ms", DAY_MS).cast("int"))
    )
    order, blk = ["start_ms", "shot_id"], time_block("start_ms", HOUR_MS)
    e = neighbours(e, ["episode"], order, blk, nxt={"nxt": F.col("start_ms")})
    e = row_index(e, ["episode"], order, blk, "shot_idx")
    cam = (F.col("user_id") % 8).cast("int")
    return e.select(
        "episode", _grid("start_ms", HOUR_MS).cast("int").alias("scene_idx"), "shot_idx", "shot_id", "start_ms",
        F.coalesce("nxt", (F.col("episode") + 1) * F.lit(DAY_MS).cast("long")).alias("end_ms"),
        cam.alias("cam_manual"),
        F.when(F.col("shot_id") % 5 == 0, ((F.col("user_id") + 1) % 8).cast("int")).otherwise(cam).alias("cam_auto"),
        F.when(F.col("shot_id") % 3 == 0, "Both").when(F.col("shot_id") % 3 == 1, "Manual").otherwise("Automatic").alias("source"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click events as face boxes; about four faces share a frame time."""
    e = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", _ms().alias("ms"), "value")
    return e.select(
        _grid("ms", DAY_MS).cast("int").alias("episode"),
        F.floor(F.col("ms") / 240000).cast("long").alias("frame_no"),
        (F.floor(F.col("ms") / 240000) * 240000).cast("long").alias("frame_ms"),
        F.col("event_id").alias("face_idx"),
        F.floor(F.col("value")).cast("int").alias("x"), F.floor(F.col("value") * 2).cast("int").alias("y"),
        (F.lit(10) + F.floor(F.col("value")) % 50).cast("int").alias("w"),
        (F.lit(20) + F.floor(F.col("value") * 10) % 200).cast("int").alias("h"),
    ).drop("frame_no")


def music(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", _ms().alias("pos_ms"), "value")
    return e.select(_grid("pos_ms", DAY_MS).cast("int").alias("episode"), "pos_ms", F.col("event_id").alias("music_id"), (F.col("value") / 491).alias("rate"))
