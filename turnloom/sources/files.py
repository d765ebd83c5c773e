"""Imports and exports of single tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.columns import scene_code
from turnloom.functions.text import preprocess, tokens
from turnloom.operators.joins import locate
from turnloom.plans.ordered import row_index

START_SHIFT_S = -0.38  # fixed value
END_SHIFT_S = -0.5  # fixed value
TURNS_PATTERN = r"[_-].+<br />[_-].+"  # fixed value: several speakers in one subtitle
NOISE_PATTERN = r"^\s*\(.*\)\s*$"  # fixed value


def _clock(seconds: Column, shift: float) -> Column:
    ms = ((seconds + F.lit(shift)) * 1000).cast("long")
    return ms


def import_subtitles(subs: DataFrame, keys: Sequence[str] = ("sub_id",)) -> DataFrame:
    """Subtitles (start and end in seconds, text) as speech.

    Starts and ends are shifted and rounded to 10 ms.  A subtitle holding
    several turns is split, its time shared by word counts.  Text in
    parentheses is noise, everything else unattributed speech.
    """
    start = F.round(F.greatest(_clock(F.col("start"), START_SHIFT_S), F.lit(0)) / 10.0).cast("long") * 10
    end = F.round(_clock(F.col("end"), END_SHIFT_S) / 10.0).cast("long") * 10
    several = F.col("text").rlike(TURNS_PATTERN)
    clean = F.transform(F.split("text", "<br />", -1), lambda t: F.regexp_replace(F.regexp_replace(t, r"\s*-\s*", ""), r"\s*_\s*", ""))
    s = subs.select(*keys, start.alias("t0"), end.alias("t1"), F.when(several, clean).otherwise(F.array("text")).alias("parts"))
    words = F.transform("parts", lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    s = s.withColumn("words", words)
    total = F.aggregate("words", F.lit(0), lambda a, w: a + w)
    spans = F.transform("words", lambda w: ((F.col("t1") - F.col("t0")) * (w / total)).cast("long"))
    s = s.withColumn("spans", spans).select(*keys, "t0", "t1", "spans", F.posexplode("parts").alias("part", "text"))
    upto = lambda n: F.aggregate(F.slice("spans", F.lit(1), n), F.lit(0).cast("long"), lambda a, v: a + v)
    a = F.col("t0") + upto(F.col("part"))
    b = F.when(F.size("spans") == 1, F.col("t1")).otherwise(F.col("t0") + upto(F.col("part") + 1))
    speaker = F.when(F.col("text").rlike(NOISE_PATTERN), "").otherwise("S")
    return s.select(*keys, "part", a.alias("start_ms"), b.alias("end_ms"), "text", speaker.alias("speaker"))


def import_faces(spark: SparkSession, path: str, shots: DataFrame) -> DataFrame:
    """Tab-separated ``episode pos x y w h``, each face with the shot that holds it."""
    f = spark.read.schema("episode int, frame_ms bigint, x int, y int, w int, h int").csv(path, sep="\t")
    return locate(f, shots, "frame_ms")


def import_music(values: DataFrame, shots: DataFrame, rate: float, window: int, hop: int) -> DataFrame:
    """The i-th value (``i`` from 0, per episode) at ``window / 2 + i * hop``, with the shot that holds it.

    ``window`` and ``hop`` count samples at ``rate`` per second; both are cut to whole milliseconds.
    """
    step, size = int(hop / rate * 1000), int(window / rate * 1000)
    m = values.withColumn("pos_ms", F.lit(size // 2) + F.col("i") * F.lit(step))
    return locate(m, shots, "pos_ms")


def clean_rank(speech: DataFrame, order: Sequence[str] = ("season", "episode", "start_ms", "seg_idx")) -> DataFrame:
    """0-based rank of each clean segment in the corpus."""
    clean = speech.where("speaker not in ('', 'S')")
    return row_index(clean, [], list(order), None, "_n").withColumn("row_id", F.col("_n") - 1).drop("_n")


def attach_vectors(speech: DataFrame, vectors: DataFrame) -> DataFrame:
    """Feature row i belongs to the i-th clean segment of the corpus.

    An episode gets all of its rows or none: where rows are missing for some of
    its segments, the episode is left out (``vector_counts`` tells whether any is).
    """
    ep = ["season", "episode"]
    ranked = clean_rank(speech).join(vectors.withColumn("_found", F.lit(1)), "row_id", "left")
    whole = ranked.groupBy(*ep).agg(F.count(F.lit(1)).alias("_n"), F.count("_found").alias("_m")).where("_n = _m")
    return ranked.join(whole.select(*ep), ep, "left_semi").drop("_found")


def vector_counts(speech: DataFrame, vectors: DataFrame) -> DataFrame:
    """Clean segments, feature rows and whether they agree, as one row."""
    a = speech.where("speaker not in ('', 'S')").agg(F.count(F.lit(1)).alias("segments"))
    b = vectors.agg(F.count(F.lit(1)).alias("rows"))
    return a.crossJoin(b).withColumn("agree", F.col("segments") == F.col("rows"))


def sample_shot_positions(shots: DataFrame, n: int = 4, fps: float = 25.0) -> DataFrame:
    """Up to n + 1 frame-aligned, strictly increasing positions per shot."""
    frame = int(1000.0 / fps)
    first, last = F.col("start_ms"), F.col("end_ms") - frame
    at = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda j: (F.floor((first + j * ((last - first) / F.lit(float(n)))) / frame + 0.5) * frame).cast("long"),
    )
    later = F.filter(at, lambda p: p > first)
    keep = [c for c in shots.columns if c not in ("start_ms", "end_ms")]
    return shots.select(*keep, F.explode(F.array_distinct(F.concat(F.array(first), later))).alias("pos_ms"))


def vertex_ids(edges: DataFrame, first: int = 0) -> DataFrame:
    """Dense ids of all vertex labels in alphabetical order."""
    v = edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct()
    n = row_index(v, [], ["label"], None, "_n")
    return n.select("label", (F.col("_n") - 1 + first).alias("id"))


def _xml(c: str) -> Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(snapshots: DataFrame) -> DataFrame:
    """Lines of one GraphML document per scene: scene_ref, part (order of sections), ord, value.

    Ids are global; a document lists the vertices of its edges, so its size
    follows its scene.  Edges of weight 0 are left out.
    """
    ids = vertex_ids(snapshots)
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
        '\t<key id="label" for="node" attr.name="label" attr.type="string"/>\n\t<key id="weight" for="edge" attr.name="weight" attr.type="double"/>\n'
        '\t<graph id="G" edgedefault="undirected">'
    )
    refs = snapshots.select("scene_ref").distinct()
    fixed = lambda part, text: refs.select("scene_ref", F.lit(part).alias("part"), F.lit(0).cast("long").alias("ord"), F.lit(text).alias("value"))
    node = F.format_string('\t\t<node id="n%d">\n\t\t\t<data key="label">%s</data>\n\t\t</node>', F.col("id"), _xml("label"))
    seen = snapshots.where("weight > 0").select("scene_ref", F.explode(F.array("src", "dst")).alias("label")).distinct()
    nodes = seen.join(ids, "label").select("scene_ref", F.lit(1).alias("part"), F.col("id").alias("ord"), node.alias("value"))
    a, b = ids.withColumnsRenamed({"label": "src", "id": "a"}), ids.withColumnsRenamed({"label": "dst", "id": "b"})
    edge = F.format_string('\t\t<edge source="n%d" target="n%d">\n\t\t\t<data key="weight">%s</data>\n\t\t</edge>', F.col("a"), F.col("b"), F.col("weight").cast("string"))
    edges = snapshots.where("weight > 0").join(a, "src").join(b, "dst").select("scene_ref", F.lit(2).alias("part"), (F.col("a") * 1_000_000_000 + F.col("b")).alias("ord"), edge.alias("value"))
    return fixed(0, head).unionByName(nodes).unionByName(edges).unionByName(fixed(3, "\t</graph>\n</graphml>"))


def export_graphml(snapshots: DataFrame, path: str) -> None:
    """One folder per scene, named by its code; part files follow the document's order.

    Rows are laid out by range, so a very large scene becomes several part
    files instead of one task.
    """
    lines = graphml_lines(snapshots).repartitionByRange("scene_ref", "part", "ord").sortWithinPartitions("scene_ref", "part", "ord")
    lines.select("scene_ref", "value").write.mode("overwrite").partitionBy("scene_ref").text(path)


def scene_ref(season: str = "season", episode: str = "episode", scene: str = "scene") -> Column:
    return scene_code(season, episode, scene)


def pajek_lines(edges: DataFrame) -> DataFrame:
    """Pajek text of one network: 1-based ids, weights with 4 decimals; columns part, ord, value.

    The edge section is headed by the number of distinct first ends.
    """
    ids = vertex_ids(edges, 1)
    nv = ids.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.format_string("*Vertices %d", "n").alias("value"))
    v = ids.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.format_string('%d "%s"', "id", "label").alias("value"))
    ne = edges.agg(F.countDistinct("src").alias("n")).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("ord"), F.format_string("*Edges %d", "n").alias("value"))
    a, b = ids.withColumnsRenamed({"label": "src", "id": "a"}), ids.withColumnsRenamed({"label": "dst", "id": "b"})
    e = edges.join(a, "src").join(b, "dst")
    e = e.select(F.lit(3).alias("part"), (F.col("a") * 1_000_000_000 + F.col("b")).alias("ord"), F.format_string("%d %d %.4f", "a", "b", "weight").alias("value"))
    return nv.unionByName(v).unionByName(ne).unionByName(e)


def export_pajek(edges: DataFrame, path: str) -> None:
    pajek_lines(edges).orderBy("part", "ord").select("value").write.mode("overwrite").text(path)


def summary_rows(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """``fname, start_s, duration_s[, step]`` of summary segments."""
    j = segments.join(episodes.select("episode", "fname"), "episode")
    step = ["step"] if "step" in segments.columns else []
    return j.select("fname", (F.col("start_ms") / 1000.0).alias("start_s"), ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_s"), *step)


def export_summary(segments: DataFrame, episodes: DataFrame, path: str) -> None:
    rows = summary_rows(segments, episodes)
    rows.orderBy(*[c for c in ("step",) if c in rows.columns], "fname", "start_s").write.mode("overwrite").csv(path, sep="\t")


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct normalised words of a stop list, one phrase per line."""
    return spark.read.text(path).select(F.explode(tokens(preprocess("value"))).alias("term")).distinct()


def series_matrix(series: DataFrame, entity: str, value: str, entities: Sequence[str], at: Sequence[str] = ("series", "scene")) -> DataFrame:
    """One row per time, one column per listed entity, 0 where absent."""
    return series.groupBy(*at).pivot(entity, list(entities)).agg(F.sum(value)).na.fill(0.0, list(entities))


def export_series(series: DataFrame, entity: str, value: str, entities: Sequence[str], path: str, at: Sequence[str] = ("series", "scene")) -> None:
    series_matrix(series, entity, value, entities, at).orderBy(*at).write.mode("overwrite").csv(path, sep="\t", header=True)
