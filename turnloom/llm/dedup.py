"""Near duplicates by fast similarity sketches, banding and exact verification.

Sketch: ``BINS`` coordinates.  In round i every shingle is hashed to a bin and a
value; a bin keeps the smallest (round, value).  Rounds go on until all bins are
filled; from round ``BINS`` on, round i places every shingle in bin
``i - BINS``, so that at most ``2 * BINS`` rounds fill every coordinate, however
small the set.  Two sets agree in a coordinate with the probability of their
Jaccard similarity, with concentration as for independent hash functions.

Plan: documents with equal shingle sets form one class.  Classes that share a
band go to a bucket.  First each member of a bucket is held against one member,
the same for all bands; buckets whose members are then in one component are
done.  In the others this is repeated ``TURNS`` times with another member per
bucket.  Of what is left, pairs from different components that share one of
their rarest shingles follow, a lossless filter.  So every pair of classes that
shares a band is connected already, verified on its full sets, or below the
similarity, and the components are those of all links; the work grows with the
sizes of the buckets, not with their squares.  At the least similarity 0.8 a
linked pair shares none of 32 bands of 4 coordinates with probability 5e-8.

Cases: a null or empty text, or one without words, has an empty set and is
linked with nothing.  Fewer words than a shingle make one shingle.  Null ids
come after all others; repeated rows are rows of the same class, each returned.
Other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import joined, mix64, release, slices, words
from turnloom.llm.components import connected
from turnloom.session import cut

BINS, ROWS = 128, 4
PERCENT = 80
TURNS = 1


def shingle_sets(parts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text."""
    data, starts = joined(parts)
    h, at = words(data)
    first = np.searchsorted(at, starts)
    step = np.uint64(0xD6E8FEB86659FD93)
    full = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
    for j in range(k if len(full) else 0):
        full = full * step + h[j : j + len(full)]
    full = mix64(full + np.uint64(k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            one = np.zeros(1, dtype=np.uint64)
            for w in h[a:b]:
                one = one * step + w
            yield mix64(one + np.uint64(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set: per bin the smallest (round, value)."""
    out = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    done, shift = 0, np.uint64(64 - (bins - 1).bit_length())
    while done < 2 * bins:
        want = 1 if len(items) > 12 * bins else max(1, int(bins * 10 / len(items)))
        rounds = np.arange(done, min(done + want, bins if done < bins else 2 * bins), dtype=np.uint64)
        h = mix64(items[None, :] ^ mix64(rounds + np.uint64(1))[:, None])
        key = (h & ((np.uint64(1) << np.uint64(48)) - np.uint64(1))) | (rounds[:, None] << np.uint64(48))
        if done < bins:
            np.minimum.at(out, (h >> shift).astype(np.int64).ravel(), key.ravel())
        else:
            at = rounds.astype(np.int64) - bins
            out[at] = np.minimum(out[at], key.min(axis=1))
        done = int(rounds[-1]) + 1
        if (out != np.iinfo(np.uint64).max).all():
            break
    return out


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    c = coordinates.reshape(-1, rows)
    key = np.zeros(len(c), dtype=np.uint64)
    for j in range(rows):
        key = mix64(key + c[:, j])
    return key


def _signatures(k: int, bands: bool | None):
    """Size and identity of each text's set, with its bands, the whole set (False) or neither (None)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, parts in slices(pdf["text"]):  # handed on slice by slice: the sets of a whole batch are not held
                out = {"n": [], "h1": [], "h2": [], "detail": []}
                for s in shingle_sets(parts, k):
                    out["n"].append(len(s))
                    out["h1"].append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
                    out["h2"].append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    detail = band_keys(sketch(s)) if bands and len(s) else s if bands is not None else np.zeros(0, np.uint64)
                    out["detail"].append(detail.view(np.int64))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(parts)].reset_index(drop=True), **out})
                del out
            del pdf
            release()

    return run


_SCHEMA = "doc_id long, n long, h1 long, h2 long, detail array<long>"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a").join(b, "b")
        .withColumn("both", both)
        .where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.size("sa") + F.size("sb") - F.col("both")))
        .select("a", "b")
    )


def _near(x: str, y: str, percent: int):
    """Sizes that a linked pair can have."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _torn(spots: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that hold more than one component."""
    placed = spots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    torn = placed.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return cut(placed.join(torn.select("band", "key"), ["band", "key"], "left_semi"))


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` from different components that share one of their rarest shingles.

    A linked pair has at least ``percent`` of either set in common.  So in any
    one order of all shingles it shares one of the first ``n - need + 1`` of
    both sets; rare ones come first, so that passages in many texts make no
    pairs.  Nor can it have more in common than either has with other
    components at all, or from the first shingle in common on.
    """
    items = cut(nodes.join(sets, "node").select("node", "n", "root", F.explode("items").alias("item")))
    often = items.groupBy("item").agg(F.count("*").alias("often"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    ranked = items.join(often, "item").select("node", "n", "root", "lo", "hi", F.struct("often", "item").alias("o"))
    lists = ranked.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("o", "lo", "hi"))).alias("l"))  # one set
    need = F.floor((F.col("n") * percent + 99) / 100)
    lists = lists.withColumn("m", F.size(F.filter("l", lambda e: e["lo"] < e["hi"]))).where(F.col("m") >= need)
    head = lists.select("node", "n", "m", "root", F.posexplode(F.slice("l", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("i", "e"))
    head = head.where("e.lo < e.hi").select("node", F.least(F.col("m"), F.col("n") - F.col("i")).alias("most"), "n", "root", F.col("e.o.item").alias("item"))
    left = head.select("item", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("root").alias("ra"))
    right = head.select("item", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("root").alias("rb"))
    enough = F.least("ma", "mb") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return left.join(right, "item").where("a < b and ra != rb").where(enough & _near("na", "nb", percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, h1, h2 (the identity of the shingle set).

    Also root, a number of the component that holds whatever its ids; null for texts without words.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(src.mapInPandas(_signatures(k, True), _SCHEMA))
    classes = rows.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first_id"), F.first("detail").alias("bands"))
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    spots = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    centre = spots.groupBy("band", "key").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a < last").drop("last")
    spots = cut(spots.join(centre, ["band", "key"]))  # members of buckets with more than one class
    stars = spots.where("node != a").select("a", F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    stars = stars.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").where(_near("na", "nb", percent))
    spots = spots.drop("a")
    busy = spots.select("node").distinct()  # only their texts are read again
    wanted = nodes.join(busy, "node", "left_semi").select("node", "h1", "h2", "first_id")
    texts = src.join(wanted.select(F.col("first_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    again = texts.mapInPandas(_signatures(k, False), _SCHEMA).select("doc_id", "h1", "h2", F.col("detail").alias("items"))
    again = again.join(wanted.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2"),
                       F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    sets = cut(again.select("node", "items").dropDuplicates(["node"]))

    links = cut(_verified(stars.select("a", "b"), sets, percent))
    roots = cut(connected(links, "a", "b"))
    for turn in range(TURNS):
        torn = _torn(spots, roots)
        first = torn.groupBy("band", "key").agg(F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", "band", F.lit(turn))).alias("c"))
        pairs = torn.join(first, ["band", "key"]).where((F.col("root") != F.col("c.root")) & _near("n", "c.n", percent))
        pairs = pairs.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        links = cut(links.unionByName(_verified(pairs, sets, percent)))
        roots = cut(connected(links, "a", "b"))
    rest = _rare_pairs(_torn(spots, roots).select("node", "n", "root").distinct(), sets, percent)
    more = cut(_verified(rest, sets, percent))
    if more.limit(1).count():
        roots = connected(links.unionByName(more), "a", "b")

    member = nodes.select("node", "h1", "h2", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(lowest, "root").select("h1", "h2", "component_id", "root")
    full = rows.where("n > 0").select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"])
    alone = rows.where("n = 0").select("doc_id", "n", "h1", "h2", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.select(*alone.columns).unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h1", "h2", "root",
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stands for each group of near duplicates.

    That is the row with the smallest doc_id; rows without words all stay.
    """
    found = near_duplicates(docs, k, percent)
    # by root: groups without any id share a null component_id, and unrelated texts may share an id
    first = found.where("kept and n_shingles > 0").groupBy("root").agg(F.min(F.struct("h1", "h2")).alias("f"), F.first("doc_id").alias("w_id"))
    first = first.select("w_id", F.col("f.h1").alias("w1"), F.col("f.h2").alias("w2"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("n", "h1", "h2")})  # for a batch without rows

    @F.pandas_udf("n long, h1 long, h2 long")
    def signature(texts: pd.Series) -> pd.DataFrame:
        return pd.concat([none, *(p[["n", "h1", "h2"]] for p in _signatures(k, None)([pd.DataFrame({"doc_id": 0, "text": texts})]))], ignore_index=True)

    src = docs.select(row, F.col("doc_id").cast("long").alias("id"), signature(F.col("text").cast("string")).alias("s"))
    src = src.select("row", "id", "s.n", "s.h1", "s.h2")
    same = F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))
    kept = src.where("n > 0").join(first, same, "left_semi").groupBy("id", "h1", "h2").agg(F.min_by("row", F.hash("row")).alias("row"))
    return kept.select("row.*").unionByName(src.where("n = 0").select("row.*"))
