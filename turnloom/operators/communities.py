"""Communities of speaker networks, scene by scene and through time.

Members are rows ``series, scene, speaker, com``; a community is named after
one of its members.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.networks import _ends, node_strengths
from turnloom.plans.ordered import row_index
from turnloom.plans.rounds import best_matching, find_roots
from turnloom.session import cut

VIEW = ["series", "scene"]


def communities(snapshots: DataFrame, drop_single: bool = False) -> DataFrame:
    """Weighted label propagation over all views at once, until no label changes.

    In each round a vertex takes the label its edges vote for with the most
    weight; its own label has the vote of its heaviest edge.  Ties go to the
    smallest label.  Where two rounds only alternate, a vertex takes the smaller
    of its two labels.  Votes are partial sums, so a vertex of any degree is safe.
    """
    e = cut(_ends(snapshots.where("weight > 0"), VIEW))
    own = e.groupBy(*VIEW, "speaker").agg(F.max("weight").alias("weight"))
    labels = own.select(*VIEW, "speaker", F.col("speaker").alias("com"))
    before = None
    while True:
        far = labels.withColumnRenamed("speaker", "other")
        votes = e.join(far, [*VIEW, "other"]).select(*VIEW, "speaker", "com", "weight")
        self_vote = own.join(labels, [*VIEW, "speaker"]).select(*VIEW, "speaker", "com", "weight")
        tally = votes.unionByName(self_vote).groupBy(*VIEW, "speaker", "com").agg(F.round(F.sum("weight"), 9).alias("v"))
        voted = tally.groupBy(*VIEW, "speaker").agg(F.min_by("com", F.struct(-F.col("v"), "com")).alias("com"))
        voted = cut(voted.join(labels.withColumnRenamed("com", "last"), [*VIEW, "speaker"]))
        again = voted.where("com <> last") if before is None else voted.join(before, [*VIEW, "speaker"]).where("com <> before")
        settled = again.limit(1).count() == 0
        before = labels.withColumnRenamed("com", "before")
        labels = voted.select(*VIEW, "speaker", F.least("com", "last").alias("com") if settled else F.col("com"))
        if settled:
            break
    if drop_single:
        big = labels.groupBy(*VIEW, "com").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        labels = labels.join(big.select(*VIEW, "com"), [*VIEW, "com"], "left_semi").select(*VIEW, "speaker", "com")
    return labels


EXACT = 8  # vertices of a view up to which all partitions are compared


@lru_cache(maxsize=EXACT + 1)
def _partitions(n: int) -> np.ndarray:
    """All partitions of n vertices: each vertex takes a label seen before it or the next new one."""
    rows = np.zeros((1, 1), np.int8)
    for _ in range(1, n):
        top = rows.max(axis=1)
        rows = np.concatenate([np.column_stack((rows[top >= c - 1], np.full((top >= c - 1).sum(), c, np.int8))) for c in range(n)])
    return rows


def _modularity(weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Modularity of each row of ``labels`` on a symmetric table of weights."""
    deg = weights.sum(axis=1)
    gain = weights / deg.sum() - np.outer(deg, deg) / deg.sum() ** 2
    return np.einsum("pij,ij->p", labels[:, :, None] == labels[:, None, :], gain)


def _moved(links: list[dict[int, float]], own: list[float], order: list[int]) -> list[int]:
    """Label of each vertex after moving single ones to the neighbouring community that gains most, until none gains.

    ``own``: weight of a vertex' loops, both directions counted.
    """
    deg = [sum(x.values()) + o for x, o in zip(links, own, strict=True)]
    all_, com, total = sum(deg), list(range(len(links))), list(deg)
    going = True
    while going:
        going = False
        for v in order:
            to: dict[int, float] = {com[v]: 0.0}
            for u, w in links[v].items():
                to[com[u]] = to.get(com[u], 0.0) + w
            total[com[v]] -= deg[v]
            gain = {c: w - total[c] * deg[v] / all_ for c, w in to.items()}
            best = max(gain.values())
            if best > gain[com[v]] + 1e-12 * all_:
                com[v], going = min(c for c, g in gain.items() if g == best), True
            total[com[v]] += deg[v]
    return com


def _multilevel(links: list[dict[int, float]], order: list[int]) -> np.ndarray:
    """Local moves, then every community becomes a vertex, until nothing moves."""
    label, own = np.arange(len(links)), [0.0] * len(links)
    while True:
        names, com = np.unique(_moved(links, own, order), return_inverse=True)
        label = com[label]
        if len(names) == len(links):
            return label
        up: list[dict[int, float]] = [{} for _ in names]
        up_own = [0.0] * len(names)
        for v, near in enumerate(links):
            up_own[com[v]] += own[v]
            for u, w in near.items():
                if com[u] == com[v]:
                    up_own[com[v]] += w
                else:
                    up[com[v]][com[u]] = up[com[v]].get(com[u], 0.0) + w
        links, own, order = up, up_own, list(range(len(names)))


def _modules(pdf: pd.DataFrame) -> pd.DataFrame:
    """Communities of one view, from edges in both directions."""
    names = np.unique(pdf["speaker"].to_numpy(object))
    a, b = np.searchsorted(names, pdf["speaker"]), np.searchsorted(names, pdf["other"])
    if len(names) <= EXACT:
        weights = np.zeros((len(names), len(names)))
        np.add.at(weights, (a, b), pdf["weight"].to_numpy())
        tried = _partitions(len(names))
        q = np.round(_modularity(weights, tried), 12)
        label = tried[int(q.argmax())]
    else:
        links: list[dict[int, float]] = [{} for _ in names]
        for v, u, w in sorted(zip(a.tolist(), b.tolist(), pdf["weight"].tolist(), strict=True)):
            links[v][u] = links[v].get(u, 0.0) + w
        heavy = np.argsort([-sum(x.values()) for x in links], kind="stable").tolist()
        tried = np.array([_multilevel(links, o) for o in (heavy, heavy[::-1], list(range(len(names))))])
        deg = np.array([sum(x.values()) for x in links])
        inside = [sum(w for v, near in enumerate(links) for u, w in near.items() if t[u] == t[v]) for t in tried]
        q = [i / deg.sum() - (np.bincount(t, weights=deg) ** 2).sum() / deg.sum() ** 2 for i, t in zip(inside, tried, strict=True)]
        label = tried[int(np.argmax(np.round(q, 12)))]
    first = {c: names[np.flatnonzero(label == c)[0]] for c in set(label.tolist())}
    return pd.DataFrame({"series": pdf["series"].iloc[0], "scene": pdf["scene"].iloc[0], "speaker": names, "com": [first[c] for c in label.tolist()]})


def modular_communities(snapshots: DataFrame) -> DataFrame:
    """Partition of every view by modularity, a community named after its first member.

    Views of up to ``EXACT`` vertices get the best partition of all; larger ones
    the best of three multilevel runs (heavy vertices first, last, and by name).
    All views are solved side by side, one at a time in a task: memory follows
    the edges of a view.
    """
    e = _ends(snapshots.where("weight > 0"), VIEW).groupBy(*VIEW, "speaker", "other").agg(F.sum("weight").alias("weight"))
    kind = dict(snapshots.dtypes)
    return e.groupBy(*VIEW).applyInPandas(_modules, f"series {kind['series']}, scene {kind['scene']}, speaker string, com string")


def modularity(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """series, scene, modularity: share of the weight inside communities less its expectation."""
    e = _ends(snapshots.where("weight > 0"), VIEW).join(members, [*VIEW, "speaker"])
    e = e.join(members.withColumnsRenamed({"speaker": "other", "com": "other_com"}), [*VIEW, "other"])
    com = e.groupBy(*VIEW, "com").agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("com") == F.col("other_com"), F.col("weight")).otherwise(0.0)).alias("i"))
    t = com.groupBy(*VIEW).agg(F.sum("w").alias("all"), F.sum("i").alias("i"), F.sum(F.col("w") * F.col("w")).alias("sq"))
    return t.select(*VIEW, (F.col("i") / F.col("all") - F.col("sq") / (F.col("all") * F.col("all"))).alias("modularity"))


def static_community(members: DataFrame, series: int, scene: int, com: str) -> DataFrame:
    return members.where((F.col("series") == series) & (F.col("scene") == scene) & (F.col("com") == com))


def community_scores(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Inside weight, modularity inside / (inside + crossing) and balance inside - crossing."""
    m1 = members.withColumnsRenamed({"speaker": "src", "com": "com1"})
    m2 = members.withColumnsRenamed({"speaker": "dst", "com": "com2"})
    e = snapshots.join(m1, [*VIEW, "src"], "left").join(m2, [*VIEW, "dst"], "left")
    same = F.col("com1") == F.col("com2")
    touched = F.when(same, F.array("com1")).otherwise(F.array("com1", "com2"))
    t = e.select(*VIEW, F.explode(touched).alias("com"), F.coalesce(same, F.lit(False)).alias("inside"), "weight").where("com is not null")
    s = t.groupBy(*VIEW, "com").agg(
        F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(0.0)).alias("weight"),
        F.sum(F.when(~F.col("inside"), F.col("weight")).otherwise(0.0)).alias("_out"),
    )
    all_w = F.col("weight") + F.col("_out")
    return s.select(*VIEW, "com", "weight", F.when(all_w > 0, F.col("weight") / all_w).alias("modularity"), (F.col("weight") - F.col("_out")).alias("balance"))


def member_strength(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Share of a member's weight that stays inside its community."""
    e = _ends(snapshots, VIEW).join(members, [*VIEW, "speaker"])
    o = members.withColumnsRenamed({"speaker": "other", "com": "other_com"})
    e = e.join(o, [*VIEW, "other"], "left")
    inside = F.when(F.col("com") == F.col("other_com"), F.col("weight")).otherwise(0.0)
    return e.groupBy(*VIEW, "speaker", "com").agg((F.sum(inside) / F.sum("weight")).alias("strength"))


def community_vectors(snapshots: DataFrame, members: DataFrame, kind: str = "strength") -> DataFrame:
    """Communities as sparse vectors: member strengths, or weights of their inner edges."""
    if kind == "strength":
        return members.join(node_strengths(snapshots), [*VIEW, "speaker"]).select(*VIEW, "com", F.col("speaker").alias("key"), F.col("strength").alias("w"))
    m1 = members.withColumnRenamed("speaker", "src")
    m2 = members.withColumnRenamed("speaker", "dst")
    e = snapshots.join(m1, [*VIEW, "src"]).join(m2, [*VIEW, "dst", "com"])
    return e.select(*VIEW, "com", F.concat_ws("|", "src", "dst").alias("key"), F.col("weight").alias("w"))


def community_similarity(vectors: DataFrame, step: int = 1) -> DataFrame:
    """Cosine of every pair of communities of scene t and t + ``step`` sharing a component."""
    norm = vectors.groupBy(*VIEW, "com").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    v = vectors.join(norm, [*VIEW, "com"]).where("norm > 0").select(*VIEW, "com", "key", (F.col("w") / F.col("norm")).alias("u"))
    nxt = v.select("series", (F.col("scene") - step).alias("scene"), F.col("com").alias("com2"), "key", F.col("u").alias("u2"))
    return v.join(nxt, [*VIEW, "key"]).groupBy(*VIEW, F.col("com").alias("com1"), "com2").agg(F.sum(F.col("u") * F.col("u2")).alias("cosine"))


def match_partitions(similarity: DataFrame) -> DataFrame:
    """One-to-one matching of the communities of consecutive scenes with the largest sum of cosines."""
    s = similarity.withColumn("cosine", F.round("cosine", 9))
    return best_matching(s, VIEW, "com1", "com2", "cosine")


def dynamic_communities(matching: DataFrame) -> DataFrame:
    """Chains of matched communities, numbered from the longest per series; ties: the later start first.

    Rows: series, scene, com, chain, length.
    """
    node = lambda scene, com: F.concat_ws("|", F.lpad(scene.cast("string"), 12, "0"), com)
    a = matching.select("series", "scene", F.col("com1").alias("com"), node(F.col("scene"), F.col("com1")).alias("node"), F.lit(None).cast("string").alias("up"))
    b = matching.select(
        "series", (F.col("scene") + 1).alias("scene"), F.col("com2").alias("com"),
        node(F.col("scene") + 1, F.col("com2")).alias("node"), node(F.col("scene"), F.col("com1")).alias("up"),
    )
    nodes = cut(a.unionByName(b).groupBy("series", "scene", "com", "node").agg(F.coalesce(F.max("up"), F.max("node")).alias("up")))
    roots = find_roots(nodes, ["series"], "node", "up")
    size = roots.groupBy("series", "root").agg(F.count(F.lit(1)).alias("length"))
    size = size.withColumns({"o1": -F.col("length"), "o2": -F.substring_index("root", "|", 1).cast("long"), "o3": F.substring_index("root", "|", -1)})
    rank = row_index(size, ["series"], ["o1", "o2", "o3"], F.struct("o1", F.floor(F.col("o2") / 1024)), "chain")
    return nodes.join(roots, ["series", "node"]).join(rank, ["series", "root"]).select("series", "scene", "com", "chain", "length")


def relabel_communities(members: DataFrame, chains: DataFrame) -> DataFrame:
    """Communities in a chain take its number, all others 0."""
    c = chains.where("length > 1").select(*VIEW, "com", "chain")
    return members.join(c, [*VIEW, "com"], "left").select(*VIEW, "speaker", F.coalesce("chain", F.lit(0).cast("long")).alias("com"))


def track_speaker(snapshots: DataFrame, members: DataFrame, speaker: str | None = None) -> DataFrame:
    """Per scene: modularity, weight and balance of a speaker's community, and its own strength in it."""
    s = member_strength(snapshots, members)
    if speaker is not None:
        s = s.where(F.col("speaker") == speaker)
    return s.join(community_scores(snapshots, members), [*VIEW, "com"])


def key_moments(snapshots: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """For every speaker, the ``n + 1`` communities that matter most to it and repeat least.

    Each round takes the community of highest value and lowers the others by
    twice their similarity to it.  All speakers advance in the same round and
    only the picked vectors are compared with the rest.
    """
    vec = community_vectors(snapshots, members)
    norm = vec.groupBy(*VIEW, "com").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    vec = cut(vec.join(norm, [*VIEW, "com"]).where("norm > 0").select(*VIEW, "com", "key", (F.col("w") / F.col("norm")).alias("u")))
    who = ["series", "speaker"]
    rest = cut(member_strength(snapshots, members).select(*who, "scene", "com", F.col("strength").alias("value")))
    picked = None
    for step in range(n + 1):
        best = rest.groupBy(*who).agg(F.min_by(F.struct("scene", "com", "value"), F.struct(-F.round("value", 9), "scene", "com")).alias("b"))
        best = cut(best.select(*who, "b.*", F.lit(step).alias("step")))
        picked = best if picked is None else picked.unionByName(best)
        if step == n:
            break
        target = best.select(*who, "scene", "com").join(vec, [*VIEW, "com"]).select(*who, "key", F.col("u").alias("pu"))
        near = rest.join(vec, [*VIEW, "com"]).join(target, [*who, "key"]).groupBy(*who, "scene", "com").agg(F.sum(F.col("u") * F.col("pu")).alias("sim"))
        left = rest.join(best.select(*who, "scene", "com"), [*who, "scene", "com"], "left_anti").join(near, [*who, "scene", "com"], "left")
        rest = cut(left.select(*who, "scene", "com", (F.col("value") - 2 * F.coalesce("sim", F.lit(0.0))).alias("value")))
    return picked


def longest_communities(chains: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Balance through time of the ``n`` longest chains of each series."""
    return chains.where(F.col("chain") <= n).join(scores, [*VIEW, "com"]).select("series", "chain", "scene", "balance")


def rank_members(members: DataFrame, strengths: DataFrame, min_size: int, min_strength: float, keys: Sequence[str] = tuple(VIEW)) -> DataFrame:
    """Members by strength within communities that are big enough."""
    size = members.groupBy(*keys, "com").agg(F.count(F.lit(1)).alias("size"))
    m = members.join(size.where(F.col("size") >= min_size), [*keys, "com"]).join(strengths, [*keys, "speaker"])
    w = Window.partitionBy(*keys, "com").orderBy(F.desc("strength"), F.desc("speaker"))
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("strength") >= min_strength)
