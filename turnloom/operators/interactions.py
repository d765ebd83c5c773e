"""Who talks to whom: interlocutors of each segment, and networks built from them.

Segments carry ``unit, seg_idx, speaker, start_ms, end_ms``; inferred
interlocutors are a new array column ``inter``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import overlap_sizes, pair_high, pair_low
from turnloom.plans.ordered import islands, running, time_block, with_halo
from turnloom.session import cut

ORDER = ["start_ms", "seg_idx"]
NO_ONE = "NULL"  # fixed value: stands for an empty reference


def _split_discards(units: DataFrame, n: int) -> DataFrame:
    """Flag the last ``n`` segments of each unit."""
    if n <= 0:
        return units.withColumn("_dropped", F.lit(False))
    back = running(units, ["unit"], ORDER, time_block("start_ms"), {"_left": ("sum", F.lit(1))}, reverse=True)
    return back.withColumn("_dropped", F.col("_left") <= n).drop("_left")


def with_turns(units: DataFrame) -> DataFrame:
    """Number consecutive segments of one speaker as a turn (1, 2, .. per unit)."""
    return islands(
        units, ["unit"], ORDER, time_block("start_ms"), {"_prev_spk": F.col("speaker")},
        F.col("_prev_spk") != F.col("speaker"), "turn",
    )


def speaker_turns(units: DataFrame) -> DataFrame:
    """One row per turn with its bounds and number of segments."""
    at = F.struct(*ORDER)
    return with_turns(units).groupBy("unit", "turn").agg(
        F.first("speaker").alias("speaker"),
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", at).alias("end_ms"),
        F.count(F.lit(1)).alias("segments"),
    )


def cooccurrence(units: DataFrame, n_discard: int = 0) -> DataFrame:
    """Interlocutors = all other speakers of the unit, its last ``n_discard`` segments not counted."""
    seg = _split_discards(units, n_discard)
    cast = (
        seg.where(~F.col("_dropped")).select("unit", "speaker").distinct()
        .groupBy("unit").agg(F.array_sort(F.collect_list("speaker")).alias("_cast"))
    )
    none = F.array().cast("array<string>")
    inter = F.when(F.array_contains("_cast", F.col("speaker")), F.array_remove("_cast", F.col("speaker"))).otherwise(none)
    return seg.join(cast, "unit", "left").select(*units.columns, F.coalesce(inter, none).alias("inter"))


def sequential(units: DataFrame, n_discard: int = 0, threshold_ms: int = 10_000, rules: Sequence[bool] = (True,) * 4) -> DataFrame:
    """Interlocutors from the order of turns, by four rules (all on by default)."""
    return _sequential(units, n_discard, threshold_ms, [F.lit(bool(r)) for r in rules], [], None)


def _sequential(units, n_discard, threshold_ms, rules: list[Column], extra: list[str], spread) -> DataFrame:
    seg = _split_discards(units, n_discard)
    used = with_turns(seg.where(~F.col("_dropped")).drop("_dropped"))
    at = F.struct(*ORDER)
    turns = used.groupBy("unit", "turn").agg(
        F.first("speaker").alias("spk"), F.min("start_ms").alias("t0"), F.max_by("end_ms", at).alias("t1")
    )
    w = Window.partitionBy("unit", "_hb").orderBy("turn")
    t = with_halo(turns, "turn", back=2, ahead=2)
    t = t.select(
        "unit", "turn", "_own", "spk",
        F.lag("spk").over(w).alias("p1"), F.lag("spk", 2).over(w).alias("p2"),
        F.lead("spk").over(w).alias("n1"), F.lead("spk", 2).over(w).alias("n2"),
        (F.col("t0") - F.lag("t1").over(w)).alias("gap_p"), (F.lead("t0").over(w) - F.col("t1")).alias("gap_n"),
        F.expr("(lead(t0) over (partition by unit, _hb order by turn) + lag(t1) over (partition by unit, _hb order by turn)) div 2").alias("lim"),
    ).where("_own")
    if spread is not None:
        t = t.withColumn(extra[0], spread)
    near_p, near_n = F.col("gap_p") <= threshold_ms, F.col("gap_n") <= threshold_ms
    first, last = F.col("p1").isNull(), F.col("n1").isNull()
    prev_back = F.coalesce(F.col("p2") == F.col("spk"), F.lit(False))
    next_back = F.coalesce(F.col("n2") == F.col("spk"), F.lit(False))
    # One of: a name for the whole turn, or "decide per segment".
    case = (
        F.when(first & last, None)
        .when(first, F.when(near_n & rules[1], F.struct(F.lit(0).alias("split"), F.col("n1").alias("to"))))
        .when(last, F.when(near_p & rules[1], F.struct(F.lit(0).alias("split"), F.col("p1").alias("to"))))
        .when(F.col("p1") == F.col("n1"), F.when((near_p | near_n) & rules[0], F.struct(F.lit(0).alias("split"), F.col("p1").alias("to"))))
        .when(prev_back & ~next_back & near_p, F.when(rules[2], F.struct(F.lit(0).alias("split"), F.col("p1").alias("to"))))
        .when(~prev_back & next_back & near_n, F.when(rules[2], F.struct(F.lit(0).alias("split"), F.col("n1").alias("to"))))
        .when(rules[3], F.struct(F.lit(1).alias("split"), F.lit(None).cast("string").alias("to")))
    )
    decided = t.select(
        "unit", "turn", *extra, case.alias("c"), "lim",
        F.when(near_p, F.col("p1")).alias("to_p"), F.when(near_n, F.col("n1")).alias("to_n"),
    )
    centre = F.expr("(start_ms + end_ms) div 2")
    to = F.when(F.col("c.split") == 1, F.when(centre <= F.col("lim"), F.col("to_p")).otherwise(F.col("to_n"))).otherwise(F.col("c.to"))
    inter = F.when(to.isNotNull(), F.array(to)).otherwise(F.array().cast("array<string>"))
    # overlapping units hold far more segments than their files tell a plan: not to be broadcast
    out = used.hint("merge").join(decided, ["unit", "turn"]).select(*units.columns, *extra, inter.alias("inter"))
    if n_discard > 0:
        left = seg.where("_dropped").select(*units.columns)
        if spread is not None:
            left = left.withColumn(extra[0], spread)
        out = out.unionByName(left.withColumn("inter", F.array().cast("array<string>")))
    return out


def rule_ablation(units: DataFrame, n_discard: int = 0, threshold_ms: int = 10_000) -> DataFrame:
    """Interlocutors under the cumulative rule sets 1..k, k = 1..4, with ``rule_set`` as a key."""
    k = F.col("rule_set")
    rules = [k >= i for i in (1, 2, 3, 4)]
    sets = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))
    return _sequential(units, n_discard, threshold_ms, rules, ["rule_set"], sets)


def speaker_network(segments: DataFrame, inter: str = "inter", by: Sequence[str] = ()) -> DataFrame:
    """+1 per (unit, speaker, interlocutor)."""
    e = segments.select(*by, "unit", F.col("speaker").alias("src"), F.explode(inter).alias("dst")).distinct()
    return e.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def utterance_network(segments: DataFrame, inter: str = "inter", by: Sequence[str] = (), counts: bool = False) -> DataFrame:
    """Duration in seconds (or 1) of each segment, shared among its interlocutors."""
    w = F.lit(1.0) if counts else (F.col("end_ms") - F.col("start_ms")) / 1000.0
    e = segments.select(*by, F.col("speaker").alias("src"), (w / F.size(inter)).alias("w"), F.explode(inter).alias("dst"))
    return e.groupBy(*by, "src", "dst").agg(F.sum("w").alias("weight"))


def undirected(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*by, pair_low("src", "dst").alias("src"), pair_high("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))


def cooccurrence_graph(units: DataFrame, directed: bool = False) -> DataFrame:
    """Speakers sharing a unit; an undirected pair counts from both ends (2 per unit).

    Units with the same cast are counted together first, so pairs are formed
    once per distinct cast and not once per unit.
    """
    cast = units.groupBy("unit").agg(F.array_sort(F.collect_set("speaker")).alias("cast"))
    casts = cast.groupBy("cast").agg(F.count(F.lit(1)).alias("n"))
    one = casts.select("cast", "n", F.explode("cast").alias("src"))
    e = one.select("src", "n", F.explode("cast").alias("dst")).where("src <> dst")
    e = e.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight"))
    return e if directed else undirected(e)


def interaction_graph(segments: DataFrame, by: Sequence[str] = (), directed: bool = False, counts: bool = False) -> DataFrame:
    e = utterance_network(segments, by=by, counts=counts)
    return e if directed else undirected(e, by)


def networks_by(segments: DataFrame, level: Sequence[str]) -> DataFrame:
    """One utterance network per value of ``level``; levels without interaction yield no rows."""
    return utterance_network(segments, by=level)


def network_similarity(n1: DataFrame, n2: DataFrame, directed: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Cosine, L2 between unit vectors and share of pairs present in both networks."""
    by = list(by)
    a, b = (n1, n2) if directed else (undirected(n1, by), undirected(n2, by))
    j = a.withColumnRenamed("weight", "a").join(b.withColumnRenamed("weight", "b"), [*by, "src", "dst"], "full_outer").na.fill(0.0, ["a", "b"])
    s = j.groupBy(*by).agg(
        F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"),
        F.avg((F.col("a") * F.col("b") != 0).cast("double")).alias("jaccard"),
    )
    cos = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb")))
    return s.select(*by, cos.alias("cosine"), F.sqrt(F.greatest(2 - 2 * cos, F.lit(0.0))).alias("l2"), "jaccard")


def _scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Macro precision, recall, accuracy over rows with a hypothesis; F from the macro means."""
    r = rows.where(F.size("hyp") > 0).withColumn("ref", F.when(F.size("ref") == 0, F.array(F.lit(NO_ONE))).otherwise(F.col("ref")))
    both, either = overlap_sizes(F.col("hyp"), F.col("ref"))
    m = r.groupBy(*by).agg(
        F.avg(both / F.size("hyp")).alias("precision"), F.avg(both / F.size("ref")).alias("recall"),
        F.avg(both / either).alias("accuracy"), F.count(F.lit(1)).alias("evaluated"),
    )
    p, c = F.col("precision"), F.col("recall")
    return m.withColumn("f_score", F.when(p + c > 0, 2 * p * c / (p + c)))


def evaluate_interactions(segments: DataFrame, by: Sequence[str] = (), hyp: str = "inter", ref: str = "inter_ref", directed: bool = True) -> DataFrame:
    """Speaker- and utterance-oriented scores of hypothesised against reference interlocutors."""
    by = list(by)
    # Eight aggregates read the segments: inferring the interlocutors once and writing them is cheaper.
    segments = cut(segments.select(*by, "unit", "speaker", "start_ms", "end_ms", hyp, ref))
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    per_speaker = segments.groupBy(*by, "unit", "speaker").agg(flat(hyp).alias("hyp"), flat(ref).alias("ref"))
    n = segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seg"))
    n_spk = per_speaker.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spk"))

    def side(kind: str, rows: DataFrame, net) -> DataFrame:
        sim = network_similarity(net(segments, hyp, by), net(segments, ref, by), directed, by)
        sc = _scores(rows, by)
        j = (lambda a, b: a.join(b, by)) if by else (lambda a, b: a.crossJoin(b))  # one row each without keys
        out = j(j(j(sc, n), n_spk), sim)
        cov = (F.col("n_spk") if kind == "speaker" else F.col("evaluated")) / F.col("n_seg")
        return out.select(F.lit(kind).alias("kind"), *by, "precision", "recall", "accuracy", "f_score", cov.alias("coverage"), "cosine", "l2", "jaccard")

    per_segment = segments.select(*by, F.col(hyp).alias("hyp"), F.col(ref).alias("ref"))
    return side("speaker", per_speaker, lambda s, c, b: speaker_network(s, c, b)).unionByName(
        side("utterance", per_segment, lambda s, c, b: utterance_network(s, c, b))
    )


def interaction_errors(segments: DataFrame, ref_network: DataFrame, hyp: str = "inter", ref: str = "inter_ref") -> DataFrame:
    """Segments whose hypothesis and reference share nobody; ``misleading`` if the first pair is also absent from the network."""
    both, _ = overlap_sizes(F.col(hyp), F.col(ref))
    bad = segments.where((F.size(hyp) > 0) & (both == 0)).withColumn("dst", F.element_at(hyp, 1))
    net = ref_network.select(F.col("src").alias("speaker"), "dst", F.col("weight").alias("_w"))
    return bad.join(net, ["speaker", "dst"], "left").withColumn("misleading", F.coalesce(F.col("_w"), F.lit(0.0)) == 0).drop("_w")
