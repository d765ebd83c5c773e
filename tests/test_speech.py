"""Turns, interlocutors, subtitles and summaries of speech: hand-written and random cases."""

import random

from pyspark.sql import functions as F

from turnloom.functions import columns as C
from turnloom.functions.text import preprocess
from turnloom.operators import interactions as I
from turnloom.operators import sequences as S
from turnloom.sources import adapters as A
from turnloom.sources import files
from turnloom.streaming import operators as X


def _sequential(segs, gap, drop, rules):
    """Interlocutor of each kept segment of one unit, read off the written rules."""
    segs = segs[: len(segs) - drop] if drop else segs
    turns = []
    for s in segs:
        if not turns or turns[-1][0]["spk"] != s["spk"]:
            turns.append([])
        turns[-1].append(s)
    out = {s["id"]: None for s in segs}
    n = len(turns)
    spk = [t[0]["spk"] for t in turns]
    for j, t in enumerate(turns):
        before = t[0]["a"] - turns[j - 1][-1]["b"] if j else None
        after = turns[j + 1][0]["a"] - t[-1]["b"] if j + 1 < n else None
        if n < 2:
            continue
        if j == 0:
            rule, to = 2, spk[1] if after <= gap else None
        elif j == n - 1:
            rule, to = 2, spk[j - 1] if before <= gap else None
        elif spk[j - 1] == spk[j + 1]:
            rule, to = 1, spk[j - 1] if before <= gap or after <= gap else None
        else:
            p, q = j >= 2 and spk[j - 2] == spk[j], j + 2 < n and spk[j + 2] == spk[j]
            if p and not q and before <= gap:
                rule, to = 3, spk[j - 1]
            elif q and not p and after <= gap:
                rule, to = 3, spk[j + 1]
            else:
                mid = (turns[j + 1][0]["a"] + turns[j - 1][-1]["b"]) // 2
                for s in t:
                    left = (s["a"] + s["b"]) // 2 <= mid
                    ok = before <= gap if left else after <= gap
                    if rules[3] and ok:
                        out[s["id"]] = spk[j - 1] if left else spk[j + 1]
                continue
        if rules[rule - 1]:
            for s in t:
                out[s["id"]] = to
    return out


def test_sequential_rules(spark):
    r = random.Random(5)
    units = [list(u) for u in ("a", "ab", "aba", "abc", "abcb", "babc", "abab", "aabbc", "abcabc")]
    units += [[r.choice("abcd") for _ in range(r.randrange(1, 14))] for _ in range(150)]
    rows, cases = [], {}
    for u, seq in enumerate(units):
        t = 0
        cases[u] = []
        for i, s in enumerate(seq):
            t += r.choice([0, 3, 10, 11, 400_000])
            cases[u].append(dict(id=u * 100 + i, spk=s, a=t, b=t + r.randrange(1, 30)))
            t = cases[u][-1]["b"]
            rows.append((u, u * 100 + i, s, cases[u][-1]["a"], t))
    df = spark.createDataFrame(rows, "unit int, seg_idx int, speaker string, start_ms long, end_ms long")
    for drop, rules in ((0, (1, 1, 1, 1)), (2, (1, 1, 1, 1)), (0, (1, 1, 0, 0))):
        got = {x["seg_idx"]: x["inter"] for x in I.sequential(df, drop, 10, rules).collect()}
        assert len(got) == len(rows)
        for u, segs in cases.items():
            want = _sequential(segs, 10, drop, rules)
            for s in segs:
                w = want.get(s["id"])
                assert got[s["id"]] == ([w] if w else []), (units[u], s)
    sets = {(x["rule_set"], x["seg_idx"]): x["inter"] for x in I.rule_ablation(df, 0, 10).collect()}
    for u, segs in cases.items():
        for k in (1, 2, 3, 4):
            want = _sequential(segs, 10, 0, [i < k for i in range(4)])
            assert all(sets[k, s["id"]] == ([want[s["id"]]] if want[s["id"]] else []) for s in segs)


def test_cooccurrence_graph_counts_both_ends(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "c")], "unit int, speaker string")
    got = {(r["src"], r["dst"]): r["weight"] for r in I.cooccurrence_graph(df).collect()}
    assert got == {("a", "b"): 4.0, ("a", "c"): 2.0, ("b", "c"): 2.0}


def test_perfect_hypothesis(spark):
    df = spark.createDataFrame([(1, 1, "a", 0, 1000, ["b"]), (1, 2, "b", 1000, 3000, ["a"])], "unit int, seg_idx int, speaker string, start_ms long, end_ms long, inter array<string>")
    for r in I.evaluate_interactions(df.withColumn("inter_ref", F.col("inter"))).collect():
        assert (r["precision"], r["recall"], r["f_score"], r["jaccard"]) == (1.0, 1.0, 1.0, 1.0)
        assert abs(r["cosine"] - 1) < 1e-12 and r["l2"] < 1e-6


def test_subtitles(spark):
    rows = [(1, 10.0, 14.0, "- a<br />- b c"), (2, 0.1, 2.0, "(door)"), (3, 5.0, 6.0, "plain text")]
    got = files.import_subtitles(spark.createDataFrame(rows, "sub_id int, start double, end double, text string")).orderBy("sub_id", "part").collect()
    assert [(r["sub_id"], r["start_ms"], r["end_ms"], r["text"], r["speaker"]) for r in got] == [
        (1, 9620, 10913, "a", "S"), (1, 10913, 13499, "b c", "S"), (2, 0, 1500, "(door)", ""), (3, 4620, 5500, "plain text", "S"),
    ]


def test_labels_and_positions(spark):
    r = spark.range(1).select(
        C.format_position(F.lit(3_600_000)).alias("a"), C.format_position(F.lit(3_601_005)).alias("b"),
        C.abbreviate_label(F.lit("John B Goode")).alias("c"), C.clean_label(F.lit("  a   b ")).alias("d"),
        C.scene_code(F.lit(1), F.lit(12), F.lit(7)).alias("e"), preprocess(F.lit("Can't you <i>see</i>, he won't - ok?")).alias("f"),
    ).first()
    assert tuple(r) == ("00:00.000", "01:00:01.005", "J. Goode", "a b", "S01E12_007", "ca not you see he will not ok")


def test_speech_rate_against_characters(spark):
    r = random.Random(6)
    rows = [(u, i, a, a + r.randrange(0, 4000), "x" * r.randrange(0, 60)) for u in range(3) for i, a in enumerate(sorted(r.sample(range(20_000), 12)))]
    got = {(x["unit"], x["t"]): x["rate"] for x in S.speech_rate(spark.createDataFrame(rows, "unit int, i int, start_ms long, end_ms long, text string"), ["unit"]).collect()}
    for u in range(3):
        at = sorted(a + k * (b - a) // len(x) for v, _, a, b, x in rows if v == u and x for k in range(len(x)))
        grid = range(0, (at[-1] + 750) // 500 * 500 + 501, 500)
        assert sorted(t for v, t in got if v == u) == list(grid)
        assert all(abs(got[u, t] - sum(max(t - 750, 0) <= c <= t + 750 for c in at) / 1.5) < 1e-9 for t in grid)


def test_streams_wait_for_rows_out_of_order(spark):
    """Rows within the watermark in any order and batch, ties, and a pause of hours give the batch result."""
    from pyspark.sql import functions as F

    from turnloom.streaming import operators as X
    from turnloom.streaming.run import drain, replay

    at = [0, 1000, 2500, 2500, 4000, 7_300_000, 7_301_000, 7_302_500, 7_310_000]
    spk = ["a", "b", "a", "c", "b", "a", "b", "c", "b"]
    rows = [(1, i, s, t, t + 900) for i, (s, t) in enumerate(zip(spk, at))]
    far = [(9, 0, "z", 40 * 86_400_000, 40 * 86_400_000 + 5)]
    cols = "unit long, seg_idx long, speaker string, start_ms long, end_ms long"

    def run(batches):
        frames = [r + (n,) for n, b in enumerate(batches) for r in b]
        df = spark.createDataFrame(frames, cols + ", n int")
        s = replay(df, order="n", batches=len(batches)).withColumn("ts", F.timestamp_millis(F.col("start_ms") + X.EPOCH_MS))
        return sorted(map(tuple, drain(X.stream_interactions(s, 5_000_000), "append").collect()))

    whole = run([rows, far])
    assert whole
    assert run([[rows[1], rows[0]], [rows[3]], [rows[2], rows[4]], [rows[6], rows[5]], [rows[8], rows[7]], far]) == whole


def test_x04_waits_for_scenes_out_of_order(spark):
    from pyspark.sql import functions as F

    from turnloom.streaming import operators as X
    from turnloom.streaming.run import drain, replay

    rows = [(1, 0, "a", "b", 4.0), (1, 1, "a", "c", 1.0), (1, 1, "b", "c", 2.0), (1, 500, "a", "b", 1.0), (1, 501, "c", "d", 3.0)]
    far = [(2, 90_000, "x", "y", 0.0)]

    def run(batches):
        df = spark.createDataFrame([r + (n,) for n, b in enumerate(batches) for r in b], "series int, scene long, src string, dst string, weight double, n int")
        s = replay(df, order="n", batches=len(batches)).withColumn("ts", F.timestamp_millis(F.col("scene") * 3_600_000 + X.EPOCH_MS))
        got = drain(X.stream_past_snapshots(s, delay="2 hours").where("series = 1"), "append")
        return sorted(map(tuple, got.collect()))

    whole = run([rows, far])
    assert len(whole) >= 5
    assert run([[rows[2]], [rows[0], rows[1]], [rows[4]], [rows[3]], far]) == whole


def test_words_are_counted_where_they_lie(spark):
    """Words per line and per document need no shuffle but that of the lines."""
    from turnloom.catalog import load

    for name in ("t03_term_counts", "t04_unit_terms"):
        df = load()[0][name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(unit") == 1 and "hashpartitioning(unit#" in plan
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and line.count("#") > 2 and "term" in line and "unit" in line]


def test_lines_of_orders_are_dealt_by_their_number(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, A.order_lines(spark, sf).collect()))
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    some = A.order_lines(spark, sf)
    assert sorted(map(tuple, some.collect())) == whole
    sizes = [r["count"] for r in some.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 300


def test_stream_speech_rate_keeps_blocks_of_grid_times(spark):
    rows = [(u, i * 1700, i * 1700 + 900 + u, "some words, spoken" if i % 5 else "") for u in (1, 2) for i in range(40)]
    segs = spark.createDataFrame(rows, "unit long, start_ms long, end_ms long, text string")
    blocks = X.stream_speech_rate(segs).collect()
    got = {(b["unit"], t): rate for b in blocks for t, rate in b["rates"] if rate > 0}
    want = {(r["unit"], r["t"]): r["rate"] for r in S.speech_rate(segs, ["unit"]).collect() if r["rate"] > 0}
    assert got == want
    assert len(blocks) <= len(want) / 8 and all([t for t, _ in b["rates"]] == sorted(t for t, _ in b["rates"]) for b in blocks)
