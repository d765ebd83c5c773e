"""Weighted speaker networks followed through time.

Edge tables are long: ``series, scene, src, dst, weight`` with ``src < dst``
for undirected networks.  Scenes of a series are numbered in story order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.columns import pair_high, pair_low, sigmoid
from turnloom.plans.ordered import neighbours, row_index, running
from turnloom.plans.products import cosines
from turnloom.session import cut

SCENE_BLOCK = 1024
SALT = 16  # parts of the pairs of one speaker


def _ends(edges: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per end of an edge: speaker, other, weight; loops excluded."""
    both = F.explode(F.array(F.struct(F.col("src").alias("speaker"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("speaker"), F.col("src").alias("other"))))
    return edges.where("src <> dst").select(*keep, both.alias("_e"), "weight").select(*keep, "_e.speaker", "_e.other", "weight")


def _pair_timeline(edges: DataFrame) -> DataFrame:
    """For each pair, the scenes in which one of its ends is active, with running sums.

    ``o`` is the first speaker's activity, else the second's; ``s`` its running
    sum; ``b`` the running sum of both; ``own`` the pair's own weight;
    ``p_*`` the last own scene so far, ``q_*`` the next one after this scene.
    The work is spread by pair and block of scenes, so one long series is many tasks.
    Speakers meet their pairs as one packed row per block in which they are
    active, and pairs of one speaker are dealt to ``SALT`` parts; scenes are
    unpacked only where pair and block already lie together.
    """
    edges = cut(edges.where("src <> dst").groupBy("series", "src", "dst", "scene").agg(F.sum("weight").alias("weight")))
    act = _ends(edges, ["series", "scene"]).groupBy("series", "scene", "speaker").agg(F.sum("weight").alias("w"))
    pairs = edges.select("series", "src", "dst").distinct()
    block = F.floor(F.col("scene") / SCENE_BLOCK).alias("_b")
    packed = act.groupBy("series", "speaker", block).agg(F.collect_list(F.struct("scene", "w")).alias("at"))  # one block
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    side = lambda end, other, kind: pairs.withColumn("_salt", F.pmod(F.hash(other), F.lit(SALT))).join(
        packed.withColumnRenamed("speaker", end), ["series", end, "_salt"]).select("series", "src", "dst", "_b", F.lit(kind).alias("kind"), "at")
    itself = edges.select("series", "src", "dst", block, F.lit("own").alias("kind"), F.array(F.struct("scene", F.col("weight").alias("w"))).alias("at"))
    ev = side("src", "dst", "oa").unionByName(side("dst", "src", "ob")).unionByName(itself).repartition("series", "src", "dst", "_b")
    ev = ev.select("series", "src", "dst", "_b", "kind", F.inline("at")).groupBy("series", "src", "dst", "_b", "scene").agg(
        *[F.sum(F.when(F.col("kind") == x, F.col("w"))).alias(x) for x in ("oa", "ob", "own")])
    ev = ev.select("*", F.coalesce("oa", "ob").alias("o"), (F.coalesce("oa", F.lit(0.0)) + F.coalesce("ob", F.lit(0.0))).alias("both")).drop("oa", "ob")
    k = ["series", "src", "dst"]
    ev = running(ev, k, ["scene"], "_b", {"s": ("sum", F.col("o")), "b": ("sum", F.col("both"))})
    at = F.when(F.col("own").isNotNull(), F.struct("scene", "own", "s", (F.col("s") - F.col("o")).alias("s0"), "b", (F.col("b") - F.col("both")).alias("b0")))
    ev = running(ev, k, ["scene"], "_b", {"p": ("last", at)})
    ev = running(ev, k, ["scene"], "_b", {"q": ("last", at)}, inclusive=False, reverse=True)
    ev = neighbours(ev, k, ["scene"], "_b", nxt={"next_scene": F.col("scene"), "next_own": F.col("own")})
    return ev.drop("_b")


def _spread(runs: DataFrame) -> DataFrame:
    """Runs of scenes with one weight become one row per scene, last of all."""
    return runs.where("first <= last and weight > 0").select("series", F.explode(F.sequence("first", "last")).alias("scene"), "src", "dst", "weight")


def narrative_runs(edges: DataFrame, lam: float = 0.01) -> DataFrame:
    """Runs ``first..last`` of scenes in which a pair keeps one narrative weight.

    A pair keeps its last (next) own weight, lowered by what its ends do
    elsewhere in between.  Scenes outside any activity carry no row (weight 0).
    """
    t = _pair_timeline(edges)
    s, o, b = F.col("s"), F.col("o"), F.col("b")
    p, q = F.col("p"), F.col("q")
    s_before = s - o
    from_prev = p["own"] - (s - p["s"])

    def to_next(upto: Column) -> Column:
        first = q["own"] - q["b0"] + upto  # no own scene yet: both ends' earlier activity is deducted
        return F.when(p.isNull(), first).otherwise(q["own"] - (q["s0"] - upto))

    best = lambda upto: F.greatest(from_prev, to_next(upto))  # noqa: E731  (greatest skips NULL)
    here = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(best(s_before))
    # After the last activity before the next own scene the sum stays as it was at that activity.
    stays = F.col("next_own").isNotNull() & F.col("own").isNull()
    after = F.when(stays, best(s_before)).otherwise(best(s))
    k = ["series", "src", "dst"]
    run = lambda first, last, raw: F.struct(first.alias("first"), last.alias("last"), raw.alias("raw"))
    runs = F.array(run(F.col("scene"), F.col("scene"), here), run(F.col("scene") + 1, F.col("next_scene") - 1, after))
    r = t.select(*k, F.explode(runs).alias("r")).select(*k, "r.*").where("first <= last")
    return r.select(*k, "first", "last", sigmoid(F.col("raw"), lam).alias("weight"))


def narrative_snapshots(edges: DataFrame, lam: float = 0.01) -> DataFrame:
    return _spread(narrative_runs(edges, lam))


def past_future_snapshots(edges: DataFrame, lam: float = 0.01) -> DataFrame:
    """Weight of each stored relation seen from the past and from the future, merged.

    Every interaction lowers the stored relations sharing an end with it.  The
    view after scene i joins the past up to i with the future from i + 1, so a
    series' last scene stays empty; relations none of whose ends is active on
    the other side weigh 0 and carry no row.
    """
    t = _pair_timeline(edges).where("next_scene is not null")
    past = F.col("p")["own"] - (F.col("b") - F.col("p")["b"])
    future = F.col("q")["own"] - (F.col("q")["b0"] - F.col("b"))
    w = sigmoid(F.greatest(past, future), lam)
    return _spread(t.select("series", "src", "dst", F.col("scene").alias("first"), (F.col("next_scene") - 1).alias("last"), w.alias("weight")))


def past_snapshots(edges: DataFrame) -> DataFrame:
    """The half that only looks back: raw weights at the scenes where an end of the pair is active."""
    t = _pair_timeline(edges).where("p is not null")
    return t.select("series", "scene", "src", "dst", (F.col("p")["own"] - (F.col("b") - F.col("p")["b"])).alias("weight"))


def cumulative_networks(edges: DataFrame, n_scenes: DataFrame, size: int) -> DataFrame:
    """Sum per block of ``size`` scenes (numbered from 0), repeated on each scene; an incomplete last block is dropped.

    ``n_scenes``: series, n.
    """
    blk = F.floor(F.col("scene") / F.lit(size)).alias("blk")
    c = edges.groupBy("series", blk, "src", "dst").agg(F.sum("weight").alias("weight"))
    c = c.join(n_scenes, "series").where((F.col("blk") + 1) * size <= F.col("n"))
    scenes = F.explode(F.sequence(F.col("blk") * size, (F.col("blk") + 1) * size - 1)).alias("scene")
    return c.select("series", scenes, "src", "dst", "weight")


def relation_series(snapshots: DataFrame, scenes: DataFrame, a: str, b: str) -> DataFrame:
    """Weight of one pair in every scene, 0 where it is absent."""
    w = snapshots.where((pair_low("src", "dst") == min(a, b)) & (pair_high("src", "dst") == max(a, b)))
    w = w.groupBy("series", "scene").agg(F.sum("weight").alias("weight"))
    return scenes.select("series", "scene").join(w, ["series", "scene"], "left").na.fill(0.0, ["weight"])


def strength_series(snapshots: DataFrame, scenes: DataFrame, speaker: str) -> DataFrame:
    """Incident weight of one speaker in every scene."""
    w = snapshots.where((F.col("src") == speaker) | (F.col("dst") == speaker)).groupBy("series", "scene").agg(F.sum("weight").alias("strength"))
    return scenes.select("series", "scene").join(w, ["series", "scene"], "left").na.fill(0.0, ["strength"])


def interacting_speakers(edges: DataFrame) -> DataFrame:
    """Distinct ends per scene."""
    return edges.select("series", "scene", F.explode(F.array("src", "dst")).alias("speaker")).distinct()


def neighbour_lists(snapshots: DataFrame, interactions: DataFrame, k: int, step: int = 1) -> DataFrame:
    """The ``k`` heaviest neighbours of each speaker and its total strength, in scenes where it interacts.

    Only every ``step``-th scene is reported.  Equal weights: the later name
    first.  The rank filter lets Spark keep only k rows per speaker and task
    before the shuffle.
    """
    e = _ends(snapshots.where(F.col("scene") % step == 0), ["series", "scene"])
    e = e.join(interacting_speakers(interactions), ["series", "scene", "speaker"], "left_semi")
    total = e.groupBy("series", "scene", "speaker").agg(F.sum("weight").alias("strength"))
    w = Window.partitionBy("series", "scene", "speaker").orderBy(F.desc("weight"), F.desc("other"))
    top = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(total, ["series", "scene", "speaker"])


def node_strengths(snapshots: DataFrame, keys: Sequence[str] = ("series", "scene")) -> DataFrame:
    """Incident weight per vertex, loops excluded."""
    return _ends(snapshots, list(keys)).groupBy(*keys, "speaker").agg(F.sum("weight").alias("strength"))


def normalise_views(snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge weights over their global maximum, with the flattened colour weight."""
    root = 1.0 / 60.0  # fixed value: exponent of the colour weight

    def scaled(df: DataFrame, c: str) -> DataFrame:
        top = df.agg(F.max(c).alias("_top"))  # one row
        ratio = F.col(c) / F.col("_top")
        return df.crossJoin(top).withColumns({c: ratio, "colour": F.pow(ratio, F.lit(root))}).drop("_top")

    return scaled(node_strengths(snapshots), "strength"), scaled(snapshots, "weight")


def ego_vectors(snapshots: DataFrame) -> DataFrame:
    """Incident edge weights of every speaker and scene in long form."""
    return _ends(snapshots, ["series", "scene"])


def social_state_distance(snapshots: DataFrame, interactions: DataFrame) -> DataFrame:
    """L2 between unit ego vectors of any two scenes of a series where the speaker interacts."""
    seen = interacting_speakers(interactions)
    keys = ["series", "speaker"]
    pos = row_index(seen, keys, ["scene"], F.floor(F.col("scene") / SCENE_BLOCK), "pos")
    pos = cut(pos)
    v = cut(ego_vectors(snapshots).join(pos, [*keys, "scene"]).select(*keys, "pos", "other", "weight"))
    c = cosines(v, keys, "other", "pos", "weight", pos)
    d = c.withColumn("distance", F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))))
    at = lambda i, name: pos.select(*keys, F.col("pos").alias(i), F.col("scene").alias(name))
    return d.join(at("i", "scene1"), [*keys, "i"]).join(at("j", "scene2"), [*keys, "j"]).select(*keys, "scene1", "scene2", "distance")


def neighbourhood_similarity(snapshots: DataFrame) -> DataFrame:
    """Cosine of a speaker's ego vector with that of each neighbour.

    Two ego vectors over edges share one component only, their common edge.
    """
    norm = ego_vectors(snapshots).groupBy("series", "scene", "speaker").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    e = ego_vectors(snapshots).join(norm, ["series", "scene", "speaker"])
    o = norm.withColumnsRenamed({"speaker": "other", "norm": "other_norm"})
    ok = (F.col("norm") > 0) & (F.col("other_norm") > 0)
    cos = F.when(ok, F.col("weight") ** 2 / (F.col("norm") * F.col("other_norm"))).otherwise(0.0)
    return e.join(o, ["series", "scene", "other"]).select("series", "scene", "speaker", "other", cos.alias("cosine"))


def edge_ends(snapshots: DataFrame) -> DataFrame:
    """Pairs of the first view of each series."""
    first = snapshots.groupBy("series").agg(F.min("scene").alias("scene"))
    return snapshots.join(first, ["series", "scene"], "left_semi").select("series", "src", "dst").distinct()


def adjacency(snapshots: DataFrame, speakers: Sequence[str]) -> DataFrame:
    """Symmetric matrix restricted to the given speakers, one column each."""
    e = ego_vectors(snapshots).where(F.col("speaker").isin(list(speakers)) & F.col("other").isin(list(speakers)))
    return e.groupBy("series", "scene", "speaker").pivot("other", list(speakers)).agg(F.sum("weight")).na.fill(0.0, list(speakers))


def build_graph(edges: DataFrame, directed: bool = False, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices, and edges collapsed to one row per pair (weight 1 when unweighted)."""
    k = ["series", "scene"]
    src, dst = (F.col("src"), F.col("dst")) if directed else (pair_low("src", "dst"), pair_high("src", "dst"))
    w = F.sum("weight") if weighted else F.lit(1.0)
    e = edges.groupBy(*k, src.alias("src"), dst.alias("dst")).agg(w.alias("weight"))
    return interacting_speakers(e), e


def storyline_order(snapshots: DataFrame, scenes: DataFrame, speakers: DataFrame, sweeps: Sequence[int] = (1, -1), own_weight: float = 1.0) -> DataFrame:
    """Position of each speaker in each scene, by barycentres over a neighbouring scene.

    A sweep of +1 looks at the scene before, -1 at the scene after.  All scenes
    move at once from the positions of the previous sweep; ``speakers`` lists
    (series, speaker), ``scenes`` (series, scene) without gaps.
    """
    rank0 = row_index(speakers.select("series", "speaker").distinct(), ["series"], ["speaker"], None, "pos")
    pos = cut(scenes.select("series", "scene").join(rank0, "series"))
    e = _ends(snapshots, ["series", "scene"])
    for sweep in sweeps:
        near = pos.select("series", (F.col("scene") + sweep).alias("scene"), F.col("speaker").alias("other"), F.col("pos").alias("opos"))
        pull = e.join(near, ["series", "scene", "other"]).groupBy("series", "scene", "speaker").agg(
            F.sum(F.col("weight") * F.col("opos")).alias("wp"), F.sum("weight").alias("w")
        )
        own = near.withColumnsRenamed({"other": "speaker", "opos": "own"})
        moved = pos.join(own, ["series", "scene", "speaker"], "left").join(pull, ["series", "scene", "speaker"], "left")
        bary = (own_weight * F.col("own") + F.coalesce("wp", F.lit(0.0))) / (own_weight + F.coalesce("w", F.lit(0.0)))
        moved = moved.withColumn("bary", F.round(F.coalesce(bary, F.col("pos").cast("double")), 9))
        w = Window.partitionBy("series", "scene").orderBy("bary", "speaker")
        pos = cut(moved.select("series", "scene", "speaker", F.row_number().over(w).cast("long").alias("pos")))
    return pos
