"""Snapshots through time against loops over scenes; storylines and key moments."""

import math
import random

from pyspark.sql import functions as F

from turnloom.operators import communities as C
from turnloom.operators import networks as N
from turnloom.operators import selection as O

SCHEMA = "series int, scene long, src string, dst string, weight double"


def _case(r, n_scenes, names="abcd", p=0.35):
    pairs = [(a, b) for a in names for b in names if a < b]
    return [{k: float(r.randrange(1, 9)) for k in pairs if r.random() < p / 2} for _ in range(n_scenes)]


def _rows(cases):
    return [(c, s, a, b, w) for c, scenes in cases.items() for s, e in enumerate(scenes) for (a, b), w in e.items()]


def _act(e, x):
    hit = [w for k, w in e.items() if x in k]
    return sum(hit) if hit else None


def _narrative(scenes, pair):
    n, out = len(scenes), {}
    a = [_act(e, pair[0]) for e in scenes]
    b = [_act(e, pair[1]) for e in scenes]
    o = [x if x is not None else (y if y is not None else 0.0) for x, y in zip(a, b)]
    live = [x is not None or y is not None for x, y in zip(a, b)]
    own = [i for i, e in enumerate(scenes) if pair in e]
    for i in own:
        out[i] = scenes[i][pair]
    for p, q in zip(own, own[1:]):
        mid = [i for i in range(p + 1, q) if live[i]]
        stop = mid[-1] if mid else p
        down, up = scenes[p][pair], scenes[q][pair] - sum(o[p + 1 : q])
        for j in range(p + 1, q):
            down -= o[j]
            out[j] = max(down, up)
            up += o[j] if j < stop else 0.0
    first, last = own[0], own[-1]
    before = [i for i in range(first) if live[i]]
    if before:
        w = scenes[first][pair] - sum((a[i] or 0.0) + (b[i] or 0.0) for i in before)
        for i in range(before[0], first):
            out[i] = w
            w += o[i] if i < before[-1] else 0.0
    after = [i for i in range(last + 1, n) if live[i]]
    w = scenes[last][pair]
    for i in range(last + 1, (after[-1] if after else last) + 1):
        w -= o[i]
        out[i] = w
    return {i: 1 / (1 + math.exp(-0.01 * w)) for i, w in out.items()}


def test_narrative_snapshots(spark):
    r = random.Random(7)
    cases = {c: _case(r, 14, p=r.choice([0.15, 0.4, 0.8])) for c in range(120)}
    got = {(x["series"], x["src"], x["dst"], x["scene"]): x["weight"] for x in N.narrative_snapshots(spark.createDataFrame(_rows(cases), SCHEMA)).collect()}
    want = {}
    for c, scenes in cases.items():
        for k in {k for e in scenes for k in e}:
            want.update({(c, *k, i): w for i, w in _narrative(scenes, k).items()})
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def _half(scenes):
    book, out = {}, []
    for e in scenes:
        for (a, b), w in e.items():
            for k in book:
                if a in k or b in k:
                    book[k] -= w
        book.update(e)
        out.append(dict(book))
    return out


def test_past_future_snapshots(spark):
    r = random.Random(8)
    cases = {c: _case(r, 12) for c in range(80)}
    df = spark.createDataFrame(_rows(cases), SCHEMA)
    got = {(x["series"], x["scene"], x["src"], x["dst"]): x["weight"] for x in N.past_future_snapshots(df).collect()}
    past_got = {(x["series"], x["scene"], x["src"], x["dst"]): x["weight"] for x in N.past_snapshots(df).collect()}
    sig = lambda x: 1 / (1 + math.exp(-0.01 * x))
    want = {}
    for c, scenes in cases.items():
        past, future = _half(scenes), _half(scenes[::-1])[::-1]
        for i in range(len(scenes) - 1):
            p, f = past[i], future[i + 1]
            pn, fn = {x for k in p for x in k}, {x for k in f for x in k}
            for k in set(p) | set(f):
                if k in p and k in f:
                    want[c, i, *k] = sig(max(p[k], f[k]))
                elif k in p and set(k) & fn:
                    want[c, i, *k] = sig(p[k])
                elif k in f and set(k) & pn:
                    want[c, i, *k] = sig(f[k])
        for (cc, i, a, b), w in past_got.items():
            if cc == c:
                assert abs(past[i][a, b] - w) < 1e-9
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_storyline_cover_and_key_moments(spark):
    r = random.Random(9)
    cases = {c: [e for e in _case(r, 16, "abcde", 0.9)] for c in range(4)}
    df = spark.createDataFrame(_rows(cases), SCHEMA)
    steps, states = O.split_storyline(df, df, 0.8)
    got = {}
    for x in steps.collect():
        got.setdefault((x["series"], x["speaker"]), {})[x["scene"]] = x["center"]
    for c, scenes in cases.items():
        for s in "abcde":
            mine = [i for i, e in enumerate(scenes) if any(s in k for k in e)]
            ego = {i: {k: w for k, w in scenes[i].items() if s in k} for i in mine}
            if not mine:
                continue

            def dist(i, j):
                na, nb = (math.sqrt(sum(w * w for w in ego[x].values())) for x in (i, j))
                return math.sqrt(max(2 - 2 * sum(w * ego[j].get(k, 0) for k, w in ego[i].items()) / na / nb, 0))

            cover = {i: {i} for i in mine}
            for x, i in enumerate(mine):
                for j in mine[x + 1 : x + 6]:
                    if dist(i, j) > 0.8:
                        break
                    cover[i].add(j)
                    cover[j].add(i)
            left, chosen = set(mine), []
            while left:
                best = min(mine, key=lambda i: (-len(cover[i] & left), i))
                chosen.append(best)
                left -= cover[best]
            want = {m: min((i for i in chosen if m in cover[i]), key=lambda i: (round(dist(i, m), 9) if i != m else 0.0, -i)) for m in mine}
            assert got[c, s] == want
    members = C.communities(df)
    picks = C.key_moments(df, members, 2).collect()
    per = {}
    for p in picks:
        per.setdefault((p["series"], p["speaker"]), []).append((p["step"], p["scene"], p["com"]))
    for v in per.values():
        assert len(v) <= 3 and len({(s, c) for _, s, c in v}) == len(v)


def test_communities_are_consistent(spark):
    e = [(0, 0, "a", "b", 5.0), (0, 0, "b", "c", 5.0), (0, 0, "c", "d", 0.1), (0, 0, "d", "e", 5.0), (0, 1, "a", "b", 2.0), (0, 1, "d", "e", 2.0)]
    df = spark.createDataFrame(e, SCHEMA)
    m = C.communities(df)
    com = {(r["scene"], r["speaker"]): r["com"] for r in m.collect()}
    assert com[0, "a"] == com[0, "b"] == com[0, "c"] != com[0, "d"] == com[0, "e"]
    chains = C.dynamic_communities(C.match_partitions(C.community_similarity(C.community_vectors(df, m))))
    new = {(r["scene"], r["speaker"]): r["com"] for r in C.relabel_communities(m, chains).collect()}
    assert new[0, "a"] == new[1, "a"] and new[0, "d"] == new[1, "d"] and new[0, "a"] != new[0, "d"]
    assert {r["modularity"] for r in C.community_scores(df, m).where(F.col("scene") == 1).collect()} == {1.0}
