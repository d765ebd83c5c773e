"""Projections and filters on segment and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = ""  # fixed value: speaker label of noise
UNKNOWN = "S"  # fixed value: speaker label of unattributed speech


def denoise(speech: DataFrame) -> DataFrame:
    return speech.where(F.col("speaker") != NOISE)


def known_speakers(speech: DataFrame) -> DataFrame:
    return speech.where(F.col("speaker") != UNKNOWN)


def units_with(segments: DataFrame, speaker: str, unit: str = "unit") -> DataFrame:
    """All segments of the units in which ``speaker`` talks."""
    hits = segments.where(F.col("speaker") == speaker).select(unit).distinct()
    return segments.join(hits, unit, "left_semi")


def until_season(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("season") <= n)


def select_vertices(vertices: DataFrame, edges: DataFrame, w: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of at least weight ``w``, and the edges with both ends kept."""
    kept = vertices.where(F.col("strength") >= w)
    ends = kept.select("scene", "speaker")
    e = edges.join(ends.withColumnRenamed("speaker", "src"), ["scene", "src"], "left_semi")
    return kept, e.join(ends.withColumnRenamed("speaker", "dst"), ["scene", "dst"], "left_semi").select(*edges.columns)


def select_edges(edges: DataFrame, w: float) -> tuple[DataFrame, DataFrame]:
    """Edges of at least weight ``w`` and the vertices they touch."""
    kept = edges.where(F.col("weight") >= w)
    return kept, kept.select("scene", F.explode(F.array("src", "dst")).alias("speaker")).distinct()


def positive_edges(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(F.col("weight") > 0)


def filter_speakers(snapshots: DataFrame, first: int, last: int, minimum: float = 0.5) -> DataFrame:
    """Speakers whose mean strength per scene of the range reaches ``minimum``, by name."""
    ends = snapshots.where(F.col("scene").between(first, last)).select(F.explode(F.array("src", "dst")).alias("speaker"), "weight")
    mean = ends.groupBy("speaker").agg((F.sum("weight") / F.lit(last - first + 1)).alias("strength"))
    return mean.where(F.col("strength") >= minimum).orderBy("speaker")


def select_episodes(df: DataFrame, episodes: DataFrame | None, keys: tuple[str, ...] = ("season", "episode")) -> DataFrame:
    """Rows of the listed episodes; no list means all."""
    return df if episodes is None else df.join(episodes.select(*keys).distinct(), list(keys), "left_semi")


def remove_auto_shots(shots: DataFrame) -> DataFrame:
    """Drop detected shots; what both sources found becomes manual."""
    return shots.where(F.col("source") != "Automatic").withColumn("source", F.lit("Manual"))
