"""Story units against loops, selection against brute force, vector clustering against numpy."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.operators import selection as O
from turnloom.operators import sequences as S
from turnloom.operators import vectors as V
from turnloom.plans.ordered import running
from turnloom.session import cut


def _runs(cams, first, last):
    """Story units of the window first..last of shots with these cameras."""
    inside = [any(cams[a] == cams[b] and cams[a] != -1 for a in range(first, i) for b in range(i + 1, last + 1)) for i in range(first, last + 1)]
    out, k = [], 0
    while k < len(inside):
        if inside[k]:
            j = k
            while inside[j]:
                j += 1
            out.append((first + k - 1, first + j))
            k = j
        k += 1
    return out


def test_story_units(spark):
    r = random.Random(10)
    cases = [[1, 2, 1], [1, 1], [1, 2, 3, 1, 3], [-1, -1, -1]] + [[r.choice([-1, 0, 1, 2, 3, 4, 5, 6]) for _ in range(r.randrange(2, 18))] for _ in range(60)]
    rows, times = [], []
    for e, cams in enumerate(cases):
        t, ts = 0, []
        for i, c in enumerate(cams):
            d = r.randrange(1, 8)
            ts.append((t, t + d))
            rows.append((e, i + 1, t, t + d, c))
            t += d
        times.append(ts)
    df = spark.createDataFrame(rows, "episode int, shot_idx long, start_ms long, end_ms long, cam_manual int")
    pairs = lambda d: {(x["episode"], x["first_shot"] - 1, x["last_shot"] - 1) for x in d.collect()}
    assert pairs(S.extract_lsus(df)) == {(e, *u) for e, c in enumerate(cases) for u in _runs(c, 0, len(c) - 1)}
    low, high = 6, 25
    flat, nested = set(), set()
    for e, cams in enumerate(cases):
        ts = times[e]
        dur = lambda u: ts[u[1]][1] - ts[u[0]][0]

        def search(first, last, seen):
            if last <= first or dur((first, last)) < low:
                return
            for u in _runs(cams, first, last):
                if dur(u) >= low and u not in seen:
                    seen.add(u)
                    search(u[0] + 1, u[1], seen)
                    search(u[0], u[1] - 1, seen)

        seen = set()
        for f in range(len(cams)):
            ends = [k for k in range(f, len(cams)) if ts[k][1] - ts[f][0] <= high]
            if len(ends) >= 2:
                flat |= {(e, *u) for u in _runs(cams, f, ends[-1]) if dur(u) >= low}
                search(f, ends[-1], seen)
        nested |= {(e, *u) for u in seen}
    assert pairs(S.extract_bounded_lsus(df, low, high)) == flat
    assert pairs(S.extract_bounded_lsus(df, low, high, nested=True)) == nested


def test_story_units_of_dense_shots(spark):
    """Six thousand shots, hundreds to a window: the same units as by looking at every window alone."""
    r = random.Random(4)
    cams = [r.choice([-1, *range(60)]) if r.random() < 0.5 else r.randrange(60) for _ in range(6000)]
    df = spark.createDataFrame([(1, i + 1, 10 * i, 10 * i + 10, c) for i, c in enumerate(cams)], "episode int, shot_idx long, start_ms long, end_ms long, cam_manual int")
    width = 300
    want = set()
    for f in range(len(cams) - 1):
        want |= {u for u in _runs(cams, f, min(f + width, len(cams)) - 1) if u[1] - u[0] + 1 >= 5}
    got = S.extract_bounded_lsus(df, 50, 10 * width)
    assert {(x["first_shot"] - 1, x["last_shot"] - 1) for x in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
    deep = S.extract_bounded_lsus(df.where("shot_idx <= 700"), 50, 600, nested=True)
    spanned = set()
    for f in range(700):
        link = {}
        for k in range(f, min(f + 60, 700)):
            c = cams[k]
            if c != -1:
                link.setdefault(c, [k, k])[1] = k
            if k >= f + 4 and all(any(a < m < b for a, b in link.values()) for m in range(f + 1, k)):
                spanned.add((f, k))
    assert {(x["first_shot"] - 1, x["last_shot"] - 1) for x in deep.collect()} == spanned


def test_greedy_selection(spark):
    r = random.Random(11)
    items = [(f"g{g}", i, r.random(), float(r.randrange(1, 9))) for g in range(6) for i in range(12)]
    clash = [(a, b) for a, b in itertools.combinations(range(12), 2) if r.random() < 0.15]
    gain = {(a, b): r.random() for a in range(12) for b in range(12)}
    it = spark.createDataFrame(items, "grp string, item int, value double, weight double")
    cl = spark.createDataFrame(clash, "item1 int, item2 int")
    gd = spark.createDataFrame([(a, b, v) for (a, b), v in gain.items()], "item int, pick int, gain double")
    by_pick = lambda picks, rest: rest.join(picks.withColumnRenamed("item", "pick"), "grp").join(gd, ["item", "pick"])
    got = {}
    for x in O.mmr(it, 15.0, cl, by_pick, 0.5).collect():
        got.setdefault(x["grp"], []).append((x["step"], x["item"]))
    for g in {i[0] for i in items}:
        val = {i: v for h, i, v, _ in items if h == g}
        wt = {i: w for h, i, _, w in items if h == g}
        left, chosen = 15.0, []
        while True:
            ok = [i for i in val if i not in chosen and wt[i] <= left and not any((min(i, c), max(i, c)) in clash for c in chosen)]
            if not ok:
                break
            best = max(ok, key=lambda i: (round(val[i] / wt[i], 12), i))
            chosen.append(best)
            left -= wt[best]
            for i in val:
                val[i] += 2 * 0.5 * gain[i, best]
        assert [i for _, i in sorted(got[g])] == chosen
    rnd = O.random_selection(it, 15.0, cl, 5).collect()
    for g in {i[0] for i in items}:
        mine = [x["item"] for x in rnd if x["grp"] == g]
        wt = {i: w for h, i, _, w in items if h == g}
        left = 15.0 - sum(wt[i] for i in mine)
        assert left >= 0 and not any((min(a, b), max(a, b)) in clash for a, b in itertools.combinations(mine, 2))
        assert all(wt[i] > left or any((min(i, c), max(i, c)) in clash for c in mine) for i in wt if i not in mine)


def test_many_picks_to_a_round(spark, monkeypatch):
    """Fixed ranks: the same picks in the same order as one pick at a time, in fewer written tables."""
    r = random.Random(21)
    items = [(f"g{g}", i, r.choice([0.0, -1.0, 2.0, r.random()]), float(r.randrange(1, 9)) / 4) for g in range(4) for i in range(40)]
    clash = [(a, b) for a, b in itertools.combinations(range(40), 2) if r.random() < 0.1]
    it = spark.createDataFrame(items, "grp string, item int, value double, weight double").cache()
    cl = spark.createDataFrame(clash, "item1 int, item2 int")
    rank = F.round(F.col("value") / F.col("weight"), 12)
    key = lambda d: sorted((x["grp"], x["step"], x["item"]) for x in d.collect())
    tables = []
    real = O.cut
    monkeypatch.setattr(O, "cut", lambda d: tables.append(1) or real(d))
    for conflicts in (cl, None):
        want = key(O._choose(it, 20.0, conflicts, lambda: rank, None, 0.0))
        before, tables[:] = len(tables), []
        assert key(O.mmr(it, 20.0, conflicts)) == want
        assert len(tables) < before
        tables[:] = []
    want = key(O._choose(it, 20.0, cl, lambda: F.xxhash64(F.lit(3), "grp", "item"), None, 0.0))
    assert key(O.random_selection(it, 20.0, cl, 3)) == want
    assert O.mmr(it.limit(0), 5.0, cl).count() == O.mmr(it, 0.1, cl).count() == 0


def _tree(d, w, crit, temporal=False):
    """Heights and member sets of serial merging with the update formula."""
    cl = {i: (frozenset([i]), w[i]) for i in range(len(w))}
    d = {frozenset(k): v for k, v in d.items()}
    out = []
    while len(cl) > 1:
        keys = [k for k in d if not temporal or max(cl[min(k)][0]) + 1 == min(cl[max(k)][0])]
        k = min(keys, key=lambda k: (d[k], sorted(k)))
        a, b = sorted(k)
        h = d[k]
        for c in cl:
            if c in k:
                continue
            x, y = d[frozenset((a, c))], d[frozenset((b, c))]
            wa, wb, wc = cl[a][1], cl[b][1], cl[c][1]
            if crit == "min":
                v = min(x, y)
            elif crit == "max":
                v = max(x, y)
            elif crit == "mean":
                v = (wa * x + wb * y) / (wa + wb)
            else:
                v = ((wc + wa) * x + (wc + wb) * y - wc * h) / (wa + wb + wc)
            d[frozenset((a, c))] = v
            del d[frozenset((b, c))]
        del d[k]
        cl[a] = (cl[a][0] | cl[b][0], cl[a][1] + cl[b][1])
        del cl[b]
        out.append((round(h, 8), a, b))
    return out


def test_agglomeration(spark):
    rng = np.random.default_rng(12)
    n, units = 7, 3
    x = rng.normal(size=(units, n, 3))
    w = rng.uniform(0.5, 2.0, size=(units, n))
    rows = [(u, i, x[u, i].tolist(), float(w[u, i])) for u in range(units) for i in range(n)]
    df = spark.createDataFrame(rows, "unit int, pos int, x array<double>, w double")
    pairs = V.pair_distance(df).cache()
    for crit in V.CRITERIA:
        p = V.ward_init(pairs, df) if crit == "ward" else pairs
        m = V.agglomerate(p, df, crit).collect()
        for u in range(units):
            d = {(i, j): float(np.linalg.norm(x[u, i] - x[u, j])) for i in range(n) for j in range(i + 1, n)}
            if crit == "ward":
                d = {(i, j): w[u, i] * w[u, j] * v * v for (i, j), v in d.items()}
            want = _tree(d, list(w[u]), crit)
            got = [(round(r["height"], 8), r["left"], r["right"]) for r in sorted((r for r in m if r["unit"] == u), key=lambda r: r["step"])]
            assert sorted(got) == sorted(want), crit
    t = V.agglomerate(pairs, df, "mean", temporal=True).collect()
    for u in range(units):
        d = {(i, j): float(np.linalg.norm(x[u, i] - x[u, j])) for i in range(n) for j in range(i + 1, n)}
        got = [(round(r["height"], 8), r["left"], r["right"]) for r in sorted((r for r in t if r["unit"] == u), key=lambda r: r["step"])]
        assert got == _tree(d, list(w[u]), "mean", True)
    # The chosen cut is the candidate of best mean silhouette.
    merges = V.agglomerate(pairs, df, "mean")
    best = V.best_cut(merges, pairs, df).collect()
    for u in range(units):
        dm = np.linalg.norm(x[u][:, None] - x[u][None], axis=2)
        steps = _tree({(i, j): float(dm[i, j]) for i in range(n) for j in range(i + 1, n)}, list(w[u]), "mean")
        scored = []
        for k in range(2, n + 1):
            lab = list(range(n))
            for _, a, b in steps[: n - k]:
                lab = [a if v == b else v for v in lab]
            s = []
            for i in range(n):
                own = [j for j in range(n) if lab[j] == lab[i] and j != i]
                if not own:
                    s.append(0.0)
                    continue
                a_ = dm[i, own].mean()
                b_ = min(dm[i, [j for j in range(n) if lab[j] == c]].mean() for c in set(lab) if c != lab[i])
                s.append((b_ - a_) / max(a_, b_))
            scored.append((round(float(np.mean(s)), 9), k, lab))
        want = max(scored, key=lambda t: (t[0], t[1]))[2]
        assert [r["cluster"] for r in sorted((r for r in best if r["unit"] == u), key=lambda r: r["pos"])] == want


def test_covariance_whitening_and_centres(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    lab = [str(i % 5) for i in range(60)]
    rows = [(0, i, x[i].tolist(), lab[i]) for i in range(60)]
    df = spark.createDataFrame(rows, "unit int, pos int, x array<double>, label string")
    got = {(r["i"], r["j"]): r["cov"] for r in V.covariance(df).collect()}
    assert all(abs(v - np.cov(x.T)[k]) < 1e-9 for k, v in got.items()) and len(got) == 10
    c = x - np.array([x[[j for j in range(60) if lab[j] == lab[i]]].mean(0) for i in range(60)])
    wc = c.T @ c / 60
    cov = V.within_covariance(df)
    assert all(abs(r["cov"] - wc[r["i"], r["j"]]) < 1e-9 for r in cov.collect())
    inv = np.linalg.pinv(wc)
    for r in V.pair_distance(df, V.inverse_factor(cov)).collect():
        d = x[r["i"]] - x[r["j"]]
        assert abs(r["d"] - np.sqrt(d @ inv @ d)) < 1e-6
    out = V.k_centers(df, 4).collect()
    dm = np.linalg.norm(x[:, None] - x[None], axis=2)
    cs = [0]
    while len(cs) < 4:
        cs.append(int(np.argmax(dm[:, cs].min(1))))
    assert {r["center"] for r in out} == set(cs)
    assert abs(out[0]["covering"] - dm[:, cs].min(1).max()) < 1e-9
    err = V.speaker_error(spark.createDataFrame([(0, "a", "x", 3.0), (0, "a", "y", 1.0), (0, "b", "y", 2.0), (1, "a", "z", 4.0)], "unit int, ref string, hyp string, dur double"))
    assert {r["unit"]: round(r["error"], 6) for r in err.collect()} == {0: round(100 / 6, 6), 1: 0.0}
    assert abs(V.show_error(err).first()[0] - 10.0) < 1e-9


def test_masked_pairs_never_merge(spark):
    rows = [(0, i, [float(i)], f"LSU{i // 2}_S{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "unit int, pos int, x array<double>, label string")
    p = V.mask_pairs(V.pair_distance(df), df)
    assert {(r["i"], r["j"]) for r in p.collect()} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    m = V.agglomerate(p, df.withColumn("w", F.lit(1.0)), "min").collect()
    # {1, 2} and {0, 3} hold a forbidden pair and stay apart.
    assert [(r["left"], r["right"]) for r in m] == [(1, 2), (0, 3)]


def test_cuts_by_brute_force(spark):
    """A cut opens where one large distance stands between two small ones; blocks of frames of any size find the same."""
    r = random.Random(30)
    rows = []
    for v in range(3):
        base = [r.random() for _ in range(8)]
        for i in range(40):
            if r.random() < 0.15:
                base = [r.random() for _ in range(8)]
            rows.append((v, i, [x + r.random() / 50 for x in base]))
    hist = {(v, i): np.array(h) for v, i, h in rows}
    dist = lambda a, b: float(np.mean([1 - abs(np.corrcoef(a[k : k + 4], b[k : k + 4])[0, 1]) for k in (0, 4)]))
    d = {(v, i): dist(h, hist[v, i - 1]) for (v, i), h in hist.items() if i}
    want = set()
    for v in range(3):
        starts = [0] + [i - 1 for i in range(3, 40) if d[v, i - 2] <= 0.2 and d[v, i - 1] >= 0.3 and d[v, i] <= 0.2]
        want |= {(v, a, b) for a, b in zip(starts, [*starts[1:], 40])}
    assert len(want) > 6
    df = spark.createDataFrame(rows, "video int, frame_idx int, hist array<double>")
    assert {tuple(x) for x in S.detect_cuts(df, 2).select("video", "start_frame", "end_frame").collect()} == want
    small = S.frame_distances(df, 2, size=7).collect()
    assert len(small) == len(rows) and all(abs(x["d2"] - d[x["video"], x["frame_idx"]]) < 1e-9 for x in small if x["frame_idx"])


def test_story_units_leave_a_task_in_parts(spark, monkeypatch):
    """Nested units may be square in the shots of a window: a sweep holds only some of them, and no shuffle follows."""
    import pandas as pd

    n = 400
    shots = pd.DataFrame({"episode": 1, "shot_idx": range(1, n + 1), "start_ms": range(0, 10 * n, 10), "end_ms": range(10, 10 * n + 10, 10),
                          "nxt": [i + 2 if i + 2 <= n else -1 for i in range(1, n + 1)], "_own": True})
    monkeypatch.setattr(S, "UNITS", 1000)
    parts = list(S._sweep(30, 3000, True)(iter([shots[:150], shots[150:]])))
    assert len(parts) > 50 and max(map(len, parts)) < 1000 + n
    got = pd.concat(parts)
    assert len(got) == len(got.drop_duplicates()) == sum(min(300, n - f) - 2 for f in range(n - 2))
    df = spark.createDataFrame(shots.assign(cam_manual=1 + shots["shot_idx"] % 2).drop(columns=["nxt", "_own"]))
    deep = S.extract_bounded_lsus(df, 30, 3000, nested=True)
    assert deep.count() == len(got)
    assert "Aggregate [episode" not in deep._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0]


def test_conflicts_by_spans(spark):
    """Spans of units choose as their pairs do, with and without a changing value, and no pairs are formed beforehand."""
    r = random.Random(12)
    first = {i: r.randrange(60) for i in range(40)}
    spans = [(i, i % 2, first[i], first[i] + r.randrange(2, 12)) for i in first]
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(spans, 2) if a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]]
    units = spark.createDataFrame(spans, "lsu_id int, episode int, first_shot int, last_shot int")
    cl = spark.createDataFrame(pairs, "item1 int, item2 int")
    it = spark.createDataFrame([(f"g{g}", i, r.random(), float(r.randrange(1, 9))) for g in range(3) for i in first], "grp string, item int, value double, weight double")
    near = lambda picks, rest: rest.join(picks.select("grp", F.col("item").alias("pick")), "grp").select("grp", "item", (F.abs(F.col("item") - F.col("pick")) / 50.0).alias("gain"))
    key = lambda d: sorted((x["grp"], x["step"], x["item"]) for x in d.collect())
    by_spans = O.unit_conflicts(units)
    assert by_spans.of.count() == len(spans)
    assert len(pairs) > 20
    for choose in (lambda c: O.mmr(it, 25.0, c), lambda c: O.mmr(it, 25.0, c, near, 0.5), lambda c: O.random_selection(it, 25.0, c, 3)):
        assert key(choose(by_spans)) == key(choose(cl))


def test_units_are_not_broadcast(spark):
    """The shots of the units, unfolded, stay out of the driver however small the table of units is."""
    from turnloom.operators.joins import lsu_contents

    units = spark.createDataFrame([(1, 7, 1, 2)], "episode int, lsu_id long, first_shot long, last_shot long")
    shots = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20)], "episode int, shot_idx long, start_ms long, end_ms long")
    segs = spark.createDataFrame([(1, 5, 2, 6), (1, 6, 12, 18)], "episode int, seg_idx long, start_ms long, end_ms long")
    got = lsu_contents(units, shots, segs)
    assert sorted((x["lsu_id"], x["seg_idx"]) for x in got.collect()) == [(7, 5), (7, 6)]
    assert "SortMergeJoin [episode" in got._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_a_choice_broadcast_nothing(spark):
    it = spark.createDataFrame([("a", i, 1.0, 2.0) for i in range(6)], "grp string, item long, value double, weight double")
    spans = O.Spans(spark.createDataFrame([(i, 1, i, i + 1) for i in range(6)], "item long, part int, first int, last int"))
    mark, meet = O._conflicting(spans)
    marked = mark(it)
    for df in (meet(marked, marked), O._without(marked, marked, meet), running(it, ["grp"], ["item"], F.col("item"), {"n": ("sum", F.lit(1))})):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["_i1"], r["_i2"]) for r in meet(marked, marked).collect()} == {(i, j) for i in range(6) for j in range(6) if abs(i - j) == 1}


def test_features_of_units_broadcast_nothing(spark, monkeypatch):
    plans, table = [], lambda rows, schema: cut(spark.createDataFrame(rows, schema))  # with a size that a plan knows
    monkeypatch.setattr(O, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    shots = table([(1, i, i, 1000 * i - 1000, 1000 * i) for i in range(1, 6)], "episode int, shot_idx int, shot_id long, start_ms long, end_ms long").hint("merge")
    units = table([(1, 7, 2, 3), (1, 8, 4, 5)], "episode int, lsu_id long, first_shot int, last_shot int").hint("merge")
    speech = table([(1, 5, "a", 1100, 1900), (1, 6, "b", 2100, 2900)], "episode int, seg_idx long, speaker string, start_ms long, end_ms long").hint("merge")
    faces = table([(1, 1500, 130), (1, 1500, 20)], "episode int, frame_ms long, h int")
    music = table([(1, 1200, 1, 0.25), (1, 2200, 2, 0.75)], "episode int, pos_ms long, music_id long, rate double")
    got = O.unit_features(units, shots, speech, faces, music, 260)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)
    rows = {r["lsu_id"]: (r["start_ms"], r["end_ms"], r["seconds"], r["shot_size"], r["music_rate"]) for r in got.collect()}
    assert rows == {7: (1000, 2960, 1.96, 0.25, 0.5), 8: (3000, 4960, 1.96, 0.0, None)}
