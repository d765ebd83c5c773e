"""One-to-one matching and cuts of a tree against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.operators import vectors as V
from turnloom.plans.rounds import _assign, best_matching


def test_assignment_is_best():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 6):
        for kind in (rng.random((n, n)), rng.integers(0, 3, (n, n)).astype(float), np.zeros((n, n))):
            best = max(sum(kind[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            got = _assign(kind)
            assert sorted(got) == list(range(n)) and abs(kind[np.arange(n), got].sum() - best) < 1e-9


def test_matching_of_all_groups(spark):
    r = random.Random(3)
    rows = [(g, f"l{a}", f"r{b}", float(r.choice([0, 1, 2, 2, 5, 8]))) for g in range(8) for a in range(r.randrange(1, 6)) for b in range(r.randrange(1, 6)) if r.random() < 0.7]
    rows += [(9, "x", "y", 3.0), (9, "x", "z", 2.5), (9, "w", "y", 2.5)]  # mutual best alone would take 3
    got = best_matching(spark.createDataFrame(rows, "g int, a string, b string, w double"), ["g"], "a", "b", "w").collect()
    for g in {x[0] for x in rows}:
        w = {(a, b): v for h, a, b, v in rows if h == g}
        left, right = sorted({a for a, _ in w}), sorted({b for _, b in w})
        small, large = (left, right) if len(left) <= len(right) else (right, left)
        key = (lambda s, t: (s, t)) if small is left else (lambda s, t: (t, s))
        best = max(sum(w.get(key(s, t), 0.0) for s, t in zip(small, p, strict=True)) for p in itertools.permutations(large, len(small)))
        mine = [x for x in got if x["g"] == g]
        assert abs(sum(x["w"] for x in mine) - best) < 1e-9
        assert len({x["a"] for x in mine}) == len({x["b"] for x in mine}) == len(mine) and all(w[x["a"], x["b"]] == x["w"] > 0 for x in mine)


def test_errors_of_speakers_and_shows(spark):
    """Error of a unit: time that no one-to-one mapping of labels explains, by all mappings; of a show: weighted mean."""
    r = random.Random(8)
    rows = [(u, r.choice("abcd"[: 1 + u % 4]), r.choice("vwxyz"[: 1 + u % 5]), r.choice([0.5, 1.0, 1.0, 2.25])) for u in range(25) for _ in range(r.randrange(1, 14))]
    rows += [(90, "a", "x", 4.0), (90, "a", "x", 4.0), (91, "a", "x", 3.0), (91, "a", "y", 2.5), (91, "b", "x", 2.5)]  # 91: mutual best alone explains 3 of 8
    want = {}
    for u in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == u]
        refs, hyps = sorted({x[1] for x in own}), sorted({x[2] for x in own})
        hyps += [None] * max(0, len(refs) - len(hyps))
        good = max(sum(x[3] for x in own if dict(zip(refs, p, strict=True))[x[1]] == x[2]) for p in itertools.permutations(hyps, len(refs)))
        total = sum(x[3] for x in own)
        want[u] = (100 * (total - good) / total, total)
    errors = V.speaker_error(spark.createDataFrame(rows, "unit int, ref string, hyp string, dur double").repartition(5))
    got = {x["unit"]: (x["error"], x["duration"]) for x in errors.collect()}
    assert got.keys() == want.keys() and want[91][0] == 37.5
    assert all(abs(a - b) < 1e-9 for u in want for a, b in zip(got[u], want[u], strict=True))
    mean = sum(e * d for e, d in want.values()) / sum(d for _, d in want.values())
    assert abs(V.show_error(errors).first()["error"] - mean) < 1e-9


def test_all_cuts_in_one_pass(spark):
    """The mean silhouette of every cut equals that of the partition it gives; masked pairs, ties and a large unit."""
    rng = np.random.default_rng(7)
    x = [rng.normal(size=2).round(1).tolist() for _ in range(70)]
    df = spark.createDataFrame([(u, i, x[i] if u else [x[i][0], 0.0], f"g{i % 9}") for u in range(2) for i in range(70 if u else 12)], "unit int, pos int, x array<double>, label string")
    pairs = V.pair_distance(df).where("unit = 1 or (i + j) % 5 <> 0").cache()
    merges = V.agglomerate(pairs, df.select("unit", "pos", F.lit(1.0).alias("w")), "mean").cache()
    cuts = merges.select("unit", "height").distinct().withColumn("cut_id", F.xxhash64("height") % 1000000)
    got = {(r["unit"], r["cut_id"]): r["q"] for r in V.cut_scores(merges, pairs, df, cuts).collect()}
    parts = V.cut_tree(merges, df, cuts)
    want = V.silhouette(pairs, parts, ["unit", "cut_id"]).groupBy("unit", "cut_id").agg(F.round(F.avg("s"), 9).alias("q")).collect()
    assert len(got) == len(want)
    for r in want:
        q = got[r["unit"], r["cut_id"]]
        assert q == r["q"] or abs(q - r["q"]) < 1e-8
