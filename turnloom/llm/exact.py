"""Exact duplicates through an extendible-hash index of whole texts, in DataFrame operations only.

Key of a text is a 64-bit hash; the highest ``MAX_DEPTH`` bits are its slot.  The
directory begins with one bucket and doubles: a bucket with more than ``CAPACITY``
different keys is split on the next bit of its keys, until it fits or has used up
all bits.  All doublings are computed at once from the number of keys per slot,
so a slot belongs to the bucket of the first depth that fits, and a bucket is a
range of keys.  The directory has ``2 ** MAX_DEPTH`` rows whatever the corpus.

Entries of the index are the different texts: rows are grouped by key and text,
with partial counts, so their bytes are compared and a group of copies is one row
per task before anything is shuffled.  Different texts of one key are a chain and
get link numbers.  The index is a table in the shared folder, laid out by bucket:
the task that owns a bucket writes its chains in order.

Every row finds its entry by bucket, key and digest.  Entries count how many rows
have their bytes and how many have their digest; should two texts share both key
and digest, these differ and the job stops rather than mix them up.

Cases: a null text counts as empty, and empty texts are equal.  Null ids count as
smallest.  Of repeated rows with the largest id one stays.  An empty table gives
no rows.  Texts of any length are whole keys of the aggregation, which spills.
Other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.spread import join_groups
from turnloom.session import cut

CAPACITY = 512
MAX_DEPTH = 14


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def slot_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def directory(spark: SparkSession, keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """slot, depth and bucket (its first slot) of every slot, for a table of different keys."""
    loads = keys.groupBy(slot_of(F.col("key")).alias("slot")).agg(F.count("*").alias("load"))
    slots = spark.range(0, 1 << MAX_DEPTH, 1, 1).select(F.col("id").alias("slot")).join(loads, "slot", "left")
    depth = F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    levels = slots.select("slot", F.coalesce("load", F.lit(0)).alias("load"), depth)
    first = F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    levels = levels.withColumn("bucket", first)
    full = levels.groupBy("depth", "bucket").agg(F.sum("load").alias("held"))
    fits = levels.join(full, ["depth", "bucket"]).where((F.col("held") <= capacity) | (F.col("depth") == MAX_DEPTH))
    return fits.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b")).select("slot", "b.depth", "b.bucket")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("key", key_of(F.col("text")))


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, key, link, sha, size, group_size, keep_id, keep_tag) and the rows (doc_id, key, bucket, sha, tag), both written."""
    spark, src = docs.sparkSession, _texts(docs)
    rows = cut(src.select("doc_id", "key", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("tag")))
    entries = src.groupBy("key", "text").agg(F.count("*").alias("copies"))
    entries = entries.select("key", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"), "copies")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tag"))
    posted = rows.groupBy("key", "sha").agg(F.count("*").alias("group_size"), last.alias("last"))
    slots = cut(directory(spark, posted.select("key").distinct(), capacity).coalesce(1))
    same = F.when(F.col("copies") == F.col("group_size"), F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share a key and a digest")).cast("long"))
    linked = entries.join(posted, ["key", "sha"]).select(
        "key", "sha", "size", same.alias("group_size"), F.col("last.doc_id").alias("keep_id"), F.col("last.tag").alias("keep_tag"),
        slot_of(F.col("key")).alias("slot"))
    owned = linked.join(F.broadcast(slots), "slot").drop("slot", "depth").repartition("bucket")  # 2 ** MAX_DEPTH rows
    chains = owned.withColumn("link", F.expr("row_number() over (partition by bucket, key order by sha)"))
    index = cut(chains.sortWithinPartitions("bucket", "key", "link"))
    placed = rows.withColumn("slot", slot_of(F.col("key"))).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")
    return index, placed


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id (the largest id among equal texts), group_size, kept, text_sha256, one row per row of ``docs``."""
    index, rows = build_index(docs, capacity)
    found = join_groups(rows, index.drop("size", "link"), ["bucket", "key", "sha"], "group_size", rows.count())
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"), F.col("sha").alias("text_sha256"))


def one_of_each(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stands for each group of equal texts: the one with the largest doc_id."""
    index, _ = build_index(docs, capacity)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    src = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha"))
    wanted = index.select(F.col("keep_id").alias("k"), F.col("sha").alias("x"))
    left = src.join(wanted, F.col("id").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("x")), "left_semi")
    return left.groupBy("sha").agg(F.min_by("row", F.hash("row")).alias("row")).select("row.*")
