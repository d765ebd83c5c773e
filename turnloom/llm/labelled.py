"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` distinct ids, the first ones by hash: the same rows whatever the layout."""
    return ids.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, *columns of ids) for a bounded table of ids: one whole text per row of ``ids``.

    Of several rows with one id the text with the smallest hash counts.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    got = src.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")  # bounded by the sample size
    one = got.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text")
    return one.join(F.broadcast(ids), "doc_id")
