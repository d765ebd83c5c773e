"""Histograms, covariance, distances and clustering of vectors.

Vectors are ``array<double>``.  ``unit`` groups the vectors that are compared;
``pos`` is their position in the unit.  Pair tables hold all pairs inside a unit,
never across units, formed tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.vectors import block_distance, euclid
from turnloom.plans.ordered import pairs_within, row_index
from turnloom.plans.rounds import best_matching, find_roots
from turnloom.session import cut

CRITERIA = ("min", "max", "mean", "ward")


# ---- histograms ------------------------------------------------------------


def block_id(pixels: DataFrame, rows: int, cols: int, n_vertical: int, n_horizontal: int) -> DataFrame:
    """Regular grid of whole blocks; remainder rows and columns are ignored.

    ``pixels``: x, y and channels.  Blocks are numbered row by row.
    """
    bh, bw = rows // n_vertical, cols // n_horizontal
    down, across = rows // bh, cols // bw
    inside = (F.col("y") < bh * down) & (F.col("x") < bw * across)
    bid = F.floor(F.col("y") / bh) * across + F.floor(F.col("x") / bw)
    return pixels.where(inside).withColumn("block", bid.cast("int"))


def histogram(values: DataFrame, keys: Sequence[str], channels: Sequence[tuple[str, int, float, float]]) -> DataFrame:
    """L1-normalised histogram over one to three channels ``(column, bins, low, high)``.

    Values outside a range are not counted; bins are numbered with the last channel fastest.
    """
    keys = list(keys)
    ok, flat = F.lit(True), F.lit(0)
    for col, bins, low, high in channels:
        ok = ok & (F.col(col) >= low) & (F.col(col) < high)
        flat = flat * bins + F.floor((F.col(col) - low) * bins / (high - low))
    c = values.where(ok).groupBy(*keys, flat.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(c.groupBy(*keys).agg(F.sum("n").alias("total")), keys).select(*keys, "bin", (F.col("n") / F.col("total")).alias("share"))


def shot_correlation(shots: DataFrame, n_blocks: int, metric: str = "correl", keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Distance between the first frame of a shot and the last frame of each earlier shot of its unit."""
    p = pairs_within(shots, keys, "shot_idx", ["first_hist", "last_hist"])
    return p.select(*keys, F.col("shot_idx2").alias("i"), F.col("shot_idx1").alias("j"), block_distance(F.col("first_hist2"), F.col("last_hist1"), n_blocks, metric).alias("d"))


# ---- covariance ------------------------------------------------------------


def _scatter(rows: DataFrame) -> DataFrame:
    """Sum of ``x_i * x_j`` for i <= j and ``n``: one small matrix per Arrow batch, summed by Spark."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = None, 0
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            i, j = np.triu_indices(total.shape[0])
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "s": total[i, j], "n": n})

    out = rows.select("x").mapInPandas(part, "i int, j int, s double, n long")
    return out.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def vector_means(rows: DataFrame, keys: Sequence[str] = (), name: str = "mean") -> DataFrame:
    """Mean vector per key; batches send partial sums, so a hot key costs one short row per batch."""
    keys = list(keys)
    fields = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            groups = b.groupby(keys, sort=False, dropna=False) if keys else [((), b)]
            rec = []
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                rec.append((*k, np.stack(g["x"].to_numpy()).sum(axis=0), len(g)))
            yield pd.DataFrame(rec, columns=[*keys, "s", "n"])

    p = rows.select(*keys, "x").mapInPandas(part, ", ".join([*fields, "s array<double>", "n long"]))
    dims = p.select(*keys, "n", F.posexplode("s").alias("dim", "v")).groupBy(*keys, "dim").agg((F.sum("v") / F.sum("n")).alias("v"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda t: t["v"]).alias(name))


def _centred(rows: DataFrame, means: DataFrame, keys: list[str]) -> DataFrame:
    j = rows.join(means, keys) if keys else rows.crossJoin(means)  # one row without keys
    return j.withColumn("x", F.zip_with("x", "mean", lambda a, b: a - b)).drop("mean")


def within_covariance(rows: DataFrame, label: str | None = "label") -> DataFrame:
    """Pooled scatter around the label means over all rows; plain covariance without labels."""
    if label is None:
        return covariance(rows)
    c = _scatter(_centred(rows, vector_means(rows, [label]), [label]))
    return c.select("i", "j", (F.col("s") / F.col("n")).alias("cov"))


def covariance(rows: DataFrame) -> DataFrame:
    """Sample covariance (n - 1) for i <= j."""
    c = _scatter(_centred(rows, vector_means(rows), []))
    return c.select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("cov"))


def inverse_factor(cov: DataFrame) -> np.ndarray:
    """Factor L with ``L L' = pinv(cov)``; the d x d matrix is the only value the driver holds."""
    m = cov.toPandas()
    d = int(m["j"].max()) + 1
    full = np.zeros((d, d))
    full[m["i"], m["j"]] = m["cov"]
    full[m["j"], m["i"]] = m["cov"]
    val, vec = np.linalg.eigh(np.linalg.pinv(full))
    return vec * np.sqrt(np.clip(val, 0, None))


def whiten(rows: DataFrame, factor: np.ndarray) -> DataFrame:
    """Map vectors so that plain distances become Mahalanobis distances: d x d work per row, not per pair."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["x"] = list(np.stack(b["x"].to_numpy()) @ factor)
            yield b

    return rows.mapInPandas(part, rows.schema)


# ---- pairs -----------------------------------------------------------------


def pair_distance(rows: DataFrame, factor: np.ndarray | None = None, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Euclidean (or, with the factor of an inverse covariance, Mahalanobis) distance inside a unit."""
    r = rows if factor is None else whiten(rows.select(*keys, "pos", "x"), factor)
    p = pairs_within(r, keys, "pos", ["x"])
    return p.select(*keys, F.col("pos1").alias("i"), F.col("pos2").alias("j"), euclid(F.col("x1"), F.col("x2")).alias("d"))


def mask_pairs(pairs: DataFrame, labels: DataFrame, pattern: str = r"(.+\d+\)?)_.+", keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Forbid merging inside one pattern: pairs whose labels share it are dropped (infinitely far).

    ``labels``: keys, pos, label.
    """
    keys = list(keys)
    pat = labels.select(*keys, "pos", F.regexp_extract("label", pattern, 1).alias("pat"))
    a = pat.withColumnsRenamed({"pos": "i", "pat": "pat1"})
    b = pat.withColumnsRenamed({"pos": "j", "pat": "pat2"})
    return pairs.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where("pat1 <> pat2").select(*pairs.columns)


def ward_init(pairs: DataFrame, weights: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Start value ``w_i * w_j * d^2``; ``weights``: keys, pos, w."""
    keys = list(keys)
    a = weights.select(*keys, F.col("pos").alias("i"), F.col("w").alias("_wi"))
    b = weights.select(*keys, F.col("pos").alias("j"), F.col("w").alias("_wj"))
    return pairs.join(a, [*keys, "i"]).join(b, [*keys, "j"]).withColumn("d", F.col("_wi") * F.col("_wj") * F.col("d") ** 2).select(*pairs.columns)


# ---- agglomeration ---------------------------------------------------------


def agglomerate(pairs: DataFrame, weights: DataFrame, criterion: str = "mean", temporal: bool = False) -> DataFrame:
    """Merges of a hierarchical clustering, all units in the same rounds.

    Pairs that are each other's nearest are merged together in one round: for
    these criteria that builds the same tree as one merge at a time, in few
    rounds.  With ``temporal`` only clusters that follow each other may merge,
    and then one merge per unit and round is made.  A distance exists between
    two clusters only if it exists between all their parts (else infinite).

    ``pairs``: unit, i < j, d (Ward start values for "ward"); ``weights``: unit,
    pos, w.  Returns unit, step, left, right (smallest member of each part),
    height, size.
    """
    if criterion not in CRITERIA:
        raise ValueError(criterion)
    clusters = weights.select("unit", F.col("pos").alias("c"), "w", F.lit(1).cast("long").alias("size"), F.col("pos").alias("hi"))
    dist = cut(pairs.select("unit", F.col("i").alias("a"), F.col("j").alias("b"), "d"))
    clusters = cut(clusters)
    done = None
    rnd = 0
    while True:
        cand = dist
        if temporal:
            nb = clusters.select("unit", F.col("c").alias("a"), (F.col("hi") + 1).alias("b"))
            cand = dist.join(nb, ["unit", "a", "b"], "left_semi")
        key = F.struct("d", "a", "b")
        if temporal:
            hit = cand.groupBy("unit").agg(F.min(key).alias("k")).select("unit", "k.a", "k.b", "k.d")
        else:
            near = cand.select("unit", F.explode(F.array("a", "b")).alias("c"), "a", "b", "d").groupBy("unit", "c").agg(F.min(key).alias("k"))
            both = near.groupBy("unit", "k").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
            hit = both.select("unit", "k.a", "k.b", "k.d")
        ca = clusters.select("unit", F.col("c").alias("a"), F.col("w").alias("wa"), F.col("size").alias("sa"))
        cb = clusters.select("unit", F.col("c").alias("b"), F.col("w").alias("wb"), F.col("size").alias("sb"), F.col("hi").alias("hb"))
        hit = cut(hit.join(ca, ["unit", "a"]).join(cb, ["unit", "b"]).withColumn("round", F.lit(rnd)))
        if hit.limit(1).count() == 0:
            break
        made = hit.select("unit", "round", F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), (F.col("sa") + F.col("sb")).alias("size"))
        done = made if done is None else done.unionByName(made)
        # Part -> cluster after this round, with the part's share of its cluster's weight.
        inner = F.col("wa") * F.col("wb") / (F.col("wa") + F.col("wb")) ** 2 * _as_square(F.col("d"), F.col("wa"), F.col("wb"))
        joined = hit.select("unit", "a", "b", "wa", "wb", "sa", "sb", "hb", (inner if criterion == "ward" else F.lit(0.0)).alias("inner"))
        part = joined.select("unit", F.explode(F.array(
            F.struct(F.col("a").alias("c"), F.col("a").alias("to"), F.col("wa").alias("pw")),
            F.struct(F.col("b").alias("c"), F.col("a").alias("to"), F.col("wb").alias("pw")),
        )).alias("p"), (F.col("wa") + F.col("wb")).alias("tw"), F.lit(2).alias("parts"), "inner", (F.col("sa") + F.col("sb")).alias("ts"), F.col("hb").alias("thi"))
        part = part.select("unit", "p.c", "p.to", "p.pw", "tw", "parts", "inner", "ts", "thi")
        state = clusters.join(part, ["unit", "c"], "left").select(
            "unit", "c", F.coalesce("to", "c").alias("to"), F.coalesce("pw", "w").alias("pw"), F.coalesce("tw", "w").alias("tw"),
            F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("inner", F.lit(0.0)).alias("inner"), F.coalesce("ts", "size").alias("ts"),
            F.coalesce("thi", "hi").alias("thi"),
        )
        state = cut(state)
        dist = cut(_merge_distances(dist, state, criterion))
        clusters = state.where("c = to").select("unit", "c", F.col("tw").alias("w"), F.col("ts").alias("size"), F.col("thi").alias("hi"))
        rnd += 1
    if done is None:
        done = hit.select("unit", "round", F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"), F.lit(0).cast("long").alias("size"))
    # Steps are numbered through blocks of similar height (or of rounds), not by one sort per unit.
    if temporal:
        return row_index(done, ["unit"], ["round"], F.floor(F.col("round") / 1024), "step").drop("round")
    level = F.floor(F.log2(F.greatest("height", F.lit(1e-300))) * 16)
    return row_index(done, ["unit"], ["height", "round", "left"], level, "step").drop("round")


def _as_square(d: Column, wx: Column, wy: Column) -> Column:
    """Ward value of two clusters as a squared distance between their centres."""
    return d * (wx + wy) / (wx * wy)


def _merge_distances(dist: DataFrame, state: DataFrame, criterion: str) -> DataFrame:
    """Distances between the clusters of the next round, from the (up to four) old ones of each pair.

    For Ward this is the decomposition of the squared distance between centres,
    the closed form of applying the update rule once per merged side.
    """
    x = state.select("unit", F.col("c").alias("a"), F.col("to").alias("x"), F.col("pw").alias("pwx"), F.col("tw").alias("twx"), F.col("parts").alias("nx"), F.col("inner").alias("inx"))
    y = state.select("unit", F.col("c").alias("b"), F.col("to").alias("y"), F.col("pw").alias("pwy"), F.col("tw").alias("twy"), F.col("parts").alias("ny"), F.col("inner").alias("iny"))
    j = dist.join(x, ["unit", "a"]).join(y, ["unit", "b"]).where("x <> y")
    share = F.col("pwx") * F.col("pwy") / (F.col("twx") * F.col("twy"))
    value = {
        "min": F.min("d"),
        "max": F.max("d"),
        "mean": F.sum(share * F.col("d")),
        "ward": F.sum(share * _as_square(F.col("d"), F.col("pwx"), F.col("pwy"))),
    }[criterion]
    low, high = F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
    g = j.groupBy("unit", low, high).agg(
        value.alias("d"), F.count(F.lit(1)).alias("n"), F.max(F.col("nx") * F.col("ny")).alias("need"),
        F.max("twx").alias("t1"), F.max("twy").alias("t2"), F.max(F.col("inx") + F.col("iny")).alias("inner"),
        F.max(F.col("twx") * F.col("twy")).alias("tt"), F.max(F.col("twx") + F.col("twy")).alias("ts"),
    ).where("n = need")
    d = F.col("d") if criterion != "ward" else (F.col("d") - F.col("inner")) * F.col("tt") / F.col("ts")
    return g.select("unit", "a", "b", d.alias("d"))


def cut_tree(merges: DataFrame, items: DataFrame, heights: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Clusters of each item when the tree is cut at a height.

    ``heights``: keys and ``height`` (one row per wanted cut, extra key columns
    allowed); ``items``: unit, pos.  A part points at the part it joined; roots
    come by pointer doubling.
    """
    extra = [c for c in heights.columns if c not in ("unit", "height")]
    h = heights.withColumnRenamed("height", "at")
    low = merges.join(h, "unit").where(F.col("height") <= F.col("at")).select("unit", *extra, F.col("right").alias("pos"), F.col("left").alias("up"))
    nodes = items.select("unit", "pos").join(h.drop("at"), "unit")
    links = nodes.join(low, ["unit", *extra, "pos"], "left").withColumn("up", F.coalesce("up", "pos"))
    return find_roots(links, ["unit", *extra], "pos", "up").withColumnRenamed("root", "cluster")


def silhouette(pairs: DataFrame, clusters: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Silhouette of each item: ``(b - a) / max(a, b)``, 0 for an item alone.

    ``clusters``: keys, pos, cluster.
    """
    keys = list(keys)
    both = pairs.select("unit", F.col("i").alias("pos"), F.col("j").alias("other"), "d").unionByName(
        pairs.select("unit", F.col("j").alias("pos"), F.col("i").alias("other"), "d")
    )
    o = clusters.withColumnsRenamed({"pos": "other", "cluster": "oc"})
    near = both.join(o, ["unit", "other"]).groupBy(*keys, "pos", "oc").agg(F.avg("d").alias("m"))
    n = clusters.join(near, [*keys, "pos"], "left")
    own = F.col("oc") == F.col("cluster")
    ab = n.groupBy(*keys, "pos", "cluster").agg(F.min(F.when(own, F.col("m"))).alias("a"), F.min(F.when(~own, F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    return ab.select(*keys, "pos", "cluster", F.when(F.col("a").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top).alias("s"))


ITEM_BLOCK = 64


def _cut_scores(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
    """Sum and number of the silhouettes of some items of a unit at every cut of its tree, from one pass up the tree.

    Each item keeps the sum of its distances to every cluster.  A merge adds two
    columns; the mean of the merged cluster lies between those of its parts, so
    the nearest other cluster changes only for items that had one of the two.
    """
    ids = np.unique(np.concatenate([rows["pos"], rows["other"].dropna(), tree["left"].dropna(), tree["right"].dropna()]).astype(np.int64))
    items = np.unique(rows["pos"].to_numpy(np.int64))
    has = rows[rows["other"].notna()]
    at = (np.searchsorted(items, has["pos"]), np.searchsorted(ids, has["other"].astype(np.int64)))
    total, count = np.zeros((len(items), len(ids))), np.zeros((len(items), len(ids)))
    np.add.at(total, at, has["d"].to_numpy())
    np.add.at(count, at, 1.0)
    mean = np.full(total.shape, np.inf)
    np.divide(total, count, out=mean, where=count > 0)
    of, me = np.arange(len(ids)), np.searchsorted(ids, items)
    line = np.arange(len(items))

    def nearest(which: np.ndarray) -> None:
        m = mean[which]
        m[np.arange(len(which)), of[me[which]]] = np.inf
        arg[which] = m.argmin(axis=1)
        low[which] = m[np.arange(len(which)), arg[which]]

    arg, low = np.zeros(len(items), np.int64), np.full(len(items), np.inf)
    nearest(line)
    out = []
    tree = tree.sort_values(["height", "cut_id"], na_position="first")  # merges before cuts of the same height
    for cut_id, left, right in zip(tree["cut_id"], tree["left"], tree["right"], strict=True):
        if not np.isnan(cut_id):
            own = of[me]
            n, a = count[line, own], mean[line, own]
            top = np.maximum(a, np.where(np.isinf(low), -np.inf, low))
            known = (n > 0) & (top != 0)
            s = np.zeros(len(items))
            s[known] = np.where(np.isinf(low[known]), np.nan, (low[known] - a[known]) / top[known])
            out.append((int(cut_id), float(np.nansum(s)), int((~np.isnan(s)).sum())))
            continue
        l, r = np.searchsorted(ids, (int(left), int(right)))
        total[:, l] += total[:, r]
        count[:, l] += count[:, r]
        mean[:, l] = np.inf
        np.divide(total[:, l], count[:, l], out=mean[:, l], where=count[:, l] > 0)
        mean[:, r] = np.inf
        of[of == r] = l
        nearest(np.flatnonzero((arg == l) | (arg == r)))
    return pd.DataFrame(out, columns=["cut_id", "s", "n"])


def cut_scores(merges: DataFrame, pairs: DataFrame, items: DataFrame, cuts: DataFrame) -> DataFrame:
    """unit, cut_id, q: mean silhouette of the items of a unit at every cut (unit, cut_id, height) of its tree.

    Work is dealt by unit and blocks of ``ITEM_BLOCK`` items, which share nothing
    but the tree; all cuts of a unit cost about its pairs.
    """
    block = F.floor(F.col("pos") / ITEM_BLOCK).alias("_blk")
    own = items.join(cuts.select("unit").distinct(), "unit", "left_semi").select("unit", "pos")
    both = pairs.select("unit", F.explode(F.array(F.struct(F.col("i").alias("pos"), F.col("j").alias("other")), F.struct(F.col("j").alias("pos"), F.col("i").alias("other")))).alias("e"), "d")
    rows = both.select("unit", "e.pos", "e.other", "d").join(own, ["unit", "pos"], "right").select("unit", block, "pos", F.col("other").cast("long").alias("other"), "d")
    none = F.lit(None).cast("long")
    tree = merges.select("unit", "height", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), none.alias("cut_id"))
    tree = tree.unionByName(cuts.select("unit", "height", none.alias("left"), none.alias("right"), F.col("cut_id").cast("long").alias("cut_id")))
    tree = tree.join(own.select("unit", block).distinct(), "unit")
    kind = dict(items.dtypes)["unit"]

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"unit": [], "cut_id": [], "s": [], "n": []})
        got = _cut_scores(a, b)
        got.insert(0, "unit", key[0])
        return got

    got = rows.groupBy("unit", "_blk").cogroup(tree.groupBy("unit", "_blk")).applyInPandas(run, f"unit {kind}, cut_id long, s double, n long")
    return got.groupBy("unit", "cut_id").agg(F.round(F.sum("s") / F.when(F.sum("n") > 0, F.sum("n")), 9).alias("q"))


def best_cut(merges: DataFrame, pairs: DataFrame, items: DataFrame, bipartition: bool = False) -> DataFrame:
    """Height at which each unit's tree is cut, and the clusters it gives.

    Candidates lie halfway between all successive heights, so they give any
    number of parts from 2 on; the best mean silhouette wins, ties going to the lower
    cut.  ``bipartition`` takes the first candidate.  Returns unit, pos,
    cluster, height.
    """
    hs = merges.select("unit", "height").unionByName(merges.select("unit", F.lit(0.0).alias("height"))).distinct()
    w = Window.partitionBy("unit").orderBy(F.desc("height"))
    c = hs.withColumns({"cut_id": F.row_number().over(w), "low": F.lead("height").over(w)}).where("low is not null")
    c = cut((c.where("cut_id = 1") if bipartition else c).select("unit", "cut_id", ((F.col("height") + F.col("low")) / 2).alias("height")))
    if not bipartition:
        q = cut_scores(merges, pairs, items, c)
        pick = q.groupBy("unit").agg(F.max_by("cut_id", F.struct("q", "cut_id")).alias("cut_id"))
        c = cut(c.join(pick, ["unit", "cut_id"], "left_semi"))
    parts = cut_tree(merges, items, c)
    return parts.join(c, ["unit", "cut_id"]).select("unit", "pos", "cluster", "height")


def medoid(pairs: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Member with the smallest sum of distances; ties go to the first."""
    keys = list(keys)
    both = pairs.select(*keys, F.explode(F.array("i", "j")).alias("pos"), "d")
    tot = both.groupBy(*keys, "pos").agg(F.round(F.sum("d"), 9).alias("total"))
    return tot.groupBy(*keys).agg(F.min_by("pos", F.struct("total", "pos")).alias("medoid"), F.min("total").alias("total"))


def centroid(rows: DataFrame, keys: Sequence[str] = ("unit",)) -> DataFrame:
    return vector_means(rows, keys, "centroid")


# ---- diarization -----------------------------------------------------------


def local_diarization(
    rows: DataFrame, criterion: str = "ward", factor: np.ndarray | None = None, weights: bool = True, bipartition: bool = False,
) -> DataFrame:
    """Cluster the utterances of each unit with at least two of them.

    ``rows``: unit, pos, x, dur.  Weights are shares of the unit's duration, or equal.
    """
    w = F.col("dur").cast("double") if weights else F.lit(1.0)
    tot = rows.groupBy("unit").agg(F.sum(w).alias("_t"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    r = cut(rows.join(tot, "unit").withColumn("w", w / F.col("_t")).drop("_t", "_n"))
    pairs = pair_distance(r, factor)
    pairs = cut(ward_init(pairs, r) if criterion == "ward" else pairs)
    merges = cut(agglomerate(pairs, r, criterion))
    return best_cut(merges, pairs, r, bipartition)


def relabel(clusters: DataFrame, prefix: str = "LSU") -> DataFrame:
    """Automatic label ``<prefix><unit>_S<i>``, i counting the clusters of the unit by first member."""
    first = clusters.groupBy("unit", "cluster").agg(F.min("pos").alias("_f"))
    no = first.withColumn("_i", F.row_number().over(Window.partitionBy("unit").orderBy("_f")) - 1)
    lab = F.concat(F.lit(prefix), F.col("unit").cast("string"), F.lit("_S"), F.col("_i").cast("string"))
    return clusters.join(no, ["unit", "cluster"]).select("unit", "pos", lab.alias("hyp"))


def speaker_error(labelled: DataFrame) -> DataFrame:
    """Share of time (in %) whose mapped label differs, per unit.

    ``labelled``: unit, ref, hyp, dur.  Labels are matched one to one on shared
    duration, such that the matched time is longest.
    """
    shared = labelled.groupBy("unit", "ref", "hyp").agg(F.sum("dur").cast("double").alias("shared"))
    good = best_matching(shared, ["unit"], "ref", "hyp", "shared").groupBy("unit").agg(F.sum("shared").alias("good"))
    tot = labelled.groupBy("unit").agg(F.sum("dur").cast("double").alias("duration"))
    e = (F.col("duration") - F.coalesce("good", F.lit(0.0))) / F.col("duration") * 100
    return tot.join(good, "unit", "left").select("unit", e.alias("error"), "duration")


def show_error(errors: DataFrame) -> DataFrame:
    """Duration-weighted mean error."""
    return errors.agg((F.sum(F.col("error") * F.col("duration")) / F.sum("duration")).alias("error"))


# ---- centres ---------------------------------------------------------------


def k_centers(rows: DataFrame, p: int) -> DataFrame:
    """``p`` centres per unit, farthest first, each item with its nearest centre.

    The first centre is the first item; each next one is the item farthest from
    all centres so far, found for all units in one round.  The covering
    distance is at most twice the best possible.  ``ambiguous`` marks items
    that lie within the final covering distance of several centres.
    """
    r = rows.select("unit", "pos", "x")
    centre = r.groupBy("unit").agg(F.min_by(F.struct("pos", "x"), "pos").alias("c"))
    state = r.withColumns({"d": F.lit(float("inf")), "center": F.lit(None).cast("int"), "seen": F.array().cast("array<double>")})
    for step in range(p):
        c = centre.select("unit", F.col("c.pos").alias("cpos"), F.col("c.x").alias("cx"))
        s = state.join(c, "unit", "left").withColumn("nd", euclid(F.col("x"), F.col("cx")))
        nearer = F.col("nd") < F.col("d")
        state = cut(s.select(
            "unit", "pos", "x", F.when(nearer, F.col("nd")).otherwise(F.col("d")).alias("d"),
            F.when(nearer, F.col("cpos")).otherwise(F.col("center")).alias("center"), F.array_append("seen", F.col("nd")).alias("seen"),
        ))
        if step < p - 1:
            centre = state.groupBy("unit").agg(F.max_by(F.struct("pos", "x"), F.struct(F.round("d", 9), -F.col("pos"))).alias("c"))
    far = state.groupBy("unit").agg(F.max("d").alias("covering"))
    out = state.join(far, "unit")
    many = F.size(F.filter("seen", lambda v: v <= F.col("covering"))) > 1
    return out.select("unit", "pos", "center", "d", "covering", many.alias("ambiguous"))


def covering_sweep(rows: DataFrame, p_max: int) -> DataFrame:
    """Covering distance of each number of centres and the drop it brings; ``best`` marks the steepest drop per unit.

    Farthest-first centres for p are the first p centres for ``p_max``, so one
    run serves all p.
    """
    r = rows.select("unit", "pos", "x")
    centre = r.groupBy("unit").agg(F.min_by(F.struct("pos", "x"), "pos").alias("c"))
    state, out = r.withColumn("d", F.lit(float("inf"))), None
    for p in range(1, p_max + 1):
        c = centre.select("unit", F.col("c.x").alias("cx"))
        s = state.join(c, "unit", "left").select("unit", "pos", "x", F.least("d", euclid(F.col("x"), F.col("cx"))).alias("d"))
        state = cut(s)
        centre = state.groupBy("unit").agg(F.max_by(F.struct("pos", "x"), F.struct(F.round("d", 9), -F.col("pos"))).alias("c"))
        cov = state.groupBy("unit").agg(F.max("d").alias("covering")).withColumn("p", F.lit(p))
        out = cov if out is None else out.unionByName(cov)
    w = Window.partitionBy("unit").orderBy("p")
    o = cut(out).withColumn("fall", F.lag("covering").over(w) - F.col("covering"))
    best = o.where("fall is not null").groupBy("unit").agg(F.max_by("p", F.struct(F.round("fall", 9), -F.col("p"))).alias("best_p"))
    return o.join(best, "unit", "left").select("unit", "p", "covering", "fall", (F.col("p") == F.col("best_p")).alias("best"))
