"""Block-wise ordered passes and round kernels against plain Python."""

import random

from pyspark.sql import functions as F

from turnloom.plans import ordered as O
from turnloom.plans.intervals import asof, contains, overlaps
from turnloom.plans.rounds import find_roots, mutual_best


def _rows(seed, n=400, hot=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        g = 0 if hot and r.random() < 0.5 else r.randrange(4)
        out.append((g, r.randrange(10_000), i, r.choice(["a", "b", "c"]), r.choice([None, r.randrange(9)])))
    return out


def test_running_and_neighbours(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "g int, t long, i int, s string, v int")
    blk = F.floor(F.col("t") / 700)
    aggs = {"n": ("sum", F.lit(1)), "top": ("max", F.col("v")), "seen": ("last", F.col("v"))}
    fwd = {r["i"]: r for r in O.running(df, ["g"], ["t", "i"], blk, aggs).collect()}
    exc = {r["i"]: r for r in O.running(df, ["g"], ["t", "i"], blk, aggs, inclusive=False, reverse=True).collect()}
    near = {r["i"]: r for r in O.neighbours(df, ["g"], ["t", "i"], blk, {"ps": F.col("s"), "pv": F.col("v")}, {"ns": F.col("s")}).collect()}
    assert len(fwd) == len(exc) == len(near) == len(rows)
    for g in range(4):
        seq = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        last = None
        for k, r in enumerate(seq):
            last = r[4] if r[4] is not None else last
            top = max((x[4] for x in seq[: k + 1] if x[4] is not None), default=None)
            f = fwd[r[2]]
            assert (f["n"], f["top"], f["seen"]) == (k + 1, top, last)
            after = [x[4] for x in seq[k + 1 :] if x[4] is not None]
            e = exc[r[2]]
            assert e["seen"] == (after[0] if after else None)
            assert (e["n"] or 0) == len(seq) - k - 1
            m = near[r[2]]
            assert (m["ps"], m["pv"]) == ((seq[k - 1][3], seq[k - 1][4]) if k else (None, None))
            assert m["ns"] == (seq[k + 1][3] if k + 1 < len(seq) else None)


def test_islands_and_band(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "g int, t long, i int, s string, v int")
    blk = F.floor(F.col("t") / 300)
    got = {r["i"]: r["island"] for r in O.islands(df, ["g"], ["t", "i"], blk, {"_p": F.col("s")}, F.col("_p") != F.col("s")).collect()}
    idx = O.row_index(df, ["g"], ["t", "i"], blk)
    pairs = {(r["g"], r["idx1"], r["idx2"]) for r in O.band(idx, ["g"], "idx", 3, ["s"]).collect()}
    want = set()
    for g in range(4):
        seq = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        k = 0
        for j, r in enumerate(seq):
            k += j == 0 or seq[j - 1][3] != r[3]
            assert got[r[2]] == k
        want |= {(g, a, b) for a in range(1, len(seq) + 1) for b in range(a + 1, min(a + 3, len(seq)) + 1)}
    assert pairs == want


def test_intervals(spark):
    r = random.Random(3)
    spans, t = [], 0
    for i in range(120):
        t += r.randrange(0, 30)
        e = t + r.randrange(1, 90)
        spans.append((0, i, t, e))
        t = e
    pts = [(0, i, r.randrange(0, t + 50)) for i in range(200)]
    segs = [(0, i, a, a + r.randrange(1, 60)) for i, a in enumerate(sorted(r.sample(range(t), 100)))]
    sp = spark.createDataFrame(spans, "k int, sid int, s long, e long")
    pt = spark.createDataFrame(pts, "k int, pid int, at long")
    sg = spark.createDataFrame(segs, "k int, gid int, gs long, ge long")
    for closed in (False, True):
        got = {(x["pid"], x["sid"]) for x in contains(pt, sp, ["k"], F.col("at"), "s", "e", closed, grid=64).collect()}
        assert got == {(p[1], x[1]) for p in pts for x in spans if x[2] <= p[2] and (p[2] < x[3] or closed and p[2] == x[3])}
    got = [(x["sid"], x["gid"]) for x in overlaps(sp, sg, ["k"], ("s", "e"), ("gs", "ge"), grid=64).collect()]
    want = {(x[1], g[1]) for x in spans for g in segs if g[3] > x[2] and g[2] < x[3]}
    assert len(got) == len(want) and set(got) == want
    hit = {x["pid"]: x["sid"] for x in asof(pt, sp, ["k"], "at", "s", ["sid"], block=64).collect()}
    assert hit == {p[1]: max((x[1] for x in spans if x[2] <= p[2]), default=None) for p in pts}


def test_roots_and_matching(spark):
    links = [(0, i, max(i - 1, 0)) for i in range(50)] + [(1, i, i // 2) for i in range(40)]
    got = {(r["g"], r["n"]): r["root"] for r in find_roots(spark.createDataFrame(links, "g int, n int, p int"), ["g"], "n", "p").collect()}
    assert set(got.values()) == {0} and len(got) == 90
    r = random.Random(4)
    pairs = [(g, f"l{a}", f"r{b}", r.random()) for g in range(5) for a in range(6) for b in range(5) if r.random() < 0.7]
    out = mutual_best(spark.createDataFrame(pairs, "g int, a string, b string, w double"), ["g"], "a", "b", "w").collect()
    for g in range(5):
        want, la, lb = set(), set(), set()
        for _, a, b, w in sorted((p for p in pairs if p[0] == g), key=lambda p: -p[3]):
            if a not in la and b not in lb:
                want.add((a, b))
                la.add(a)
                lb.add(b)
        assert {(x["a"], x["b"]) for x in out if x["g"] == g} == want


def test_whole_table_as_one_sequence(spark, monkeypatch):
    """Without keys: ranges and a tree of totals give the same as one pass, and no exchange has a single partition."""
    monkeypatch.setattr(O, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        r = random.Random(9)
        rows = [(r.randrange(50), i, r.choice([None, r.randrange(9)])) for i in range(300)]
        df = spark.createDataFrame(rows, "t int, i int, v int")
        aggs = {"n": ("sum", F.lit(1)), "top": ("max", F.col("v")), "low": ("min", F.col("v")), "seen": ("last", F.col("v"))}
        for reverse in (False, True):
            for inclusive in (False, True):
                got = O.running(df, [], ["t", "i"], None, aggs, inclusive, reverse)
                assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
                by = {x["i"]: x for x in got.collect()}
                seq = sorted(rows, key=lambda x: x[:2], reverse=reverse)
                assert len(by) == len(rows)
                for k, (_, i, _) in enumerate(seq):
                    vs = [x[2] for x in seq[: k + inclusive] if x[2] is not None]
                    want = (k + inclusive or None, max(vs, default=None), min(vs, default=None), vs[-1] if vs else None)
                    assert tuple(by[i][c] for c in ("n", "top", "low", "seen")) == want
        assert O.running(df.limit(0), [], ["t", "i"], None, aggs).count() == 0
        keyed = O.row_index(df.withColumn("g", F.col("t") % 3), ["g"], ["t", "i"], None)
        for g in range(3):
            own = sorted(x[:2] for x in rows if x[0] % 3 == g)
            assert {(x["t"], x["i"]): x["idx"] for x in keyed.where(F.col("g") == g).collect()} == {x: k + 1 for k, x in enumerate(own)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
