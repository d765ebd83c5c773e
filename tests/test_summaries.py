"""Summaries, longest communities and local diarization against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_shots import _tree
from turnloom.operators import communities as C
from turnloom.operators import selection as O
from turnloom.operators import vectors as V

BUDGET = 40.0


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(17)
    units = {}
    for u in range(24):
        start = u * 5_000 + r.randrange(3_000)
        units[u] = dict(episode=u // 8, start=start, end=start + r.randrange(4, 12) * 1000, shot=r.choice([None, r.random()]), music=r.random())
    talk = sorted({(r.choice("abc"), u) for u in units for _ in range(2)})
    clash = sorted({(u, u + 1) for u in units if u + 1 in units and r.random() < 0.4})
    edges = {(u, *sorted(r.sample("abcd", 2))): float(r.randrange(1, 6)) for u in units if r.random() < 0.8 for _ in range(2)}
    scene = {u: (1, u // 4) for u in units}
    steps = sorted({(1, sc, sp, 0 if sc < 3 else 3) for sp in "abc" for sc in range(6)})
    states = {(1, sp, ce, o): float(r.randrange(1, 5)) for sp in "abc" for ce in (0, 3) for o in "abcd" if o != sp and r.random() < 0.7}
    f = spark.createDataFrame([(u, x["episode"], x["start"], x["end"], (x["end"] - x["start"]) / 1000.0, x["shot"], x["music"]) for u, x in units.items()],
                              "lsu_id long, episode int, start_ms long, end_ms long, seconds double, shot_size double, music_rate double")
    tables = dict(
        features=f, mine=spark.createDataFrame(talk, "grp string, lsu_id long"), conflicts=spark.createDataFrame(clash, "item1 long, item2 long"))
    story = dict(
        unit_scene=spark.createDataFrame([(u, *s) for u, s in scene.items()], "lsu_id long, series int, scene long"),
        unit_edges=spark.createDataFrame([(*k, w) for k, w in edges.items()], "unit long, src string, dst string, weight double"),
        steps=spark.createDataFrame(steps, "series int, scene long, speaker string, center long"),
        states=spark.createDataFrame([(*k, w) for k, w in states.items()], "series int, speaker string, center long, other string, w double"))
    return dict(units=units, talk=talk, clash=clash, edges=edges, scene=scene, steps=steps, states=states, tables=tables, story=story)


def greedy(w, value, factor=0.0):
    """Units in the order of their choice."""
    wt = {u: (w["units"][u]["end"] - w["units"][u]["start"]) / 1000.0 for u in value}
    vec = {}
    for (u, a, b), x in w["edges"].items():
        vec.setdefault(u, {})[a, b] = x
    vec = {u: {k: x / math.sqrt(sum(y * y for y in v.values())) for k, x in v.items()} for u, v in vec.items()}
    value, left, out = dict(value), BUDGET, []
    while ok := [u for u in value if u not in out and wt[u] <= left and not any((min(u, c), max(u, c)) in w["clash"] for c in out)]:
        best = max(ok, key=lambda u: (round(value[u] / wt[u], 12), u))
        out.append(best)
        left -= wt[best]
        for u in value:
            if factor and u in vec and best in vec:
                both = vec[u].keys() & vec[best].keys()
                part = sum(vec[u][k] ** 2 + vec[best][k] ** 2 - 4 * vec[u][k] * vec[best][k] for k in both)
                value[u] += 2 * factor * math.sqrt(max(2 + part, 0.0))
    return out


def chosen(df):
    out = {}
    for x in df.collect():
        out.setdefault(x["grp"], []).append((x["step"], x["item"]))
    return {g: [i for _, i in sorted(v)] for g, v in out.items()}


def style(w):
    mean = lambda u: ((w["units"][u]["shot"] or 0.0) + w["units"][u]["music"]) / 2
    return {g: greedy(w, {u: mean(u) for h, u in w["talk"] if h == g}) for g in "abc"}


def full(w, weight):
    def relevance(sp, ce, u):
        mine = {}
        for (v, a, b), x in w["edges"].items():
            if v == u and sp in (a, b):
                mine[b if a == sp else a] = x
        state = {o: x for (_, s, c, o), x in w["states"].items() if (s, c) == (sp, ce)}
        if not mine or not state:
            return 0.0
        norm = math.sqrt(sum(x * x for x in mine.values()) * sum(x * x for x in state.values()))
        return sum(x * state.get(o, 0.0) for o, x in mine.items()) / norm

    out = {}
    for sp, ce in sorted({(s[2], s[3]) for s in w["steps"]}):
        inside = {(s[0], s[1]) for s in w["steps"] if s[2:] == (sp, ce)}
        value = {}
        for g, u in w["talk"]:
            if g == sp and w["scene"][u] in inside:
                x = w["units"][u]
                value[u] = (weight * (x["shot"] or 0.0) + weight * x["music"] + relevance(sp, ce, u)) / (2 * weight + 1)
        if value:
            out[f"{sp}#1#{ce:08d}"] = greedy(w, value, O.SOCIAL_WEIGHT)
    return out


def merged(w, picks):
    out = set()
    for g, us in picks.items():
        for e in {w["units"][u]["episode"] for u in us}:
            spans = sorted((w["units"][u]["start"], w["units"][u]["end"]) for u in us if w["units"][u]["episode"] == e)
            run = list(spans[0])
            for a, b in spans[1:]:
                if a > run[1]:
                    out.add((g, e, *run))
                    run = [a, b]
                run[1] = max(run[1], b)
            out.add((g, e, *run))
    return out


def test_style_and_random(world):
    t = world["tables"]
    want = style(world)
    assert chosen(O.summary_style(t["features"], t["mine"], t["conflicts"], BUDGET)) == want
    got = chosen(O.summary_random(t["features"], t["mine"], t["conflicts"], BUDGET, 5))
    rank = {(x["grp"], x["lsu_id"]): x["h"] for x in t["mine"].select("grp", "lsu_id", F.xxhash64(F.lit(5), "grp", "lsu_id").alias("h")).collect()}
    for g in "abc":
        left, mine = BUDGET, []
        for u in sorted((u for h, u in world["talk"] if h == g), key=lambda u: -rank[g, u]):
            size = (world["units"][u]["end"] - world["units"][u]["start"]) / 1000.0
            if size <= left and not any((min(u, c), max(u, c)) in world["clash"] for c in mine):
                mine.append(u)
                left -= size
        assert got[g] == mine


@pytest.mark.parametrize(("method", "weight"), [("content", 0.0), ("both", O.STYLE_WEIGHT)])
def test_full(spark, world, method, weight):
    t, want = world["tables"], full(world, weight)
    got = O.summary_full(t["features"], t["mine"], conflicts=t["conflicts"], budget=BUDGET, style_weight=weight, **world["story"])
    assert chosen(got) == want
    season = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "episode int, season int")
    out = O.summarise(method, **{k: t[k] for k in ("features", "mine", "conflicts")}, budget=BUDGET, season_of=season, season=1, **world["story"])
    assert {(x["grp"], x["episode"], x["start_ms"], x["end_ms"]) for x in out.collect()} == {m for m in merged(world, want) if m[1] < 2}


def test_summarise_style(world):
    t = world["tables"]
    out = O.summarise("style", t["features"], t["mine"], t["conflicts"], BUDGET)
    assert {(x["grp"], x["episode"], x["start_ms"], x["end_ms"]) for x in out.collect()} == merged(world, style(world))
    with pytest.raises(ValueError):
        O.summarise("none", t["features"], t["mine"], t["conflicts"], BUDGET)


def test_longest_communities(spark):
    chains = [(1, sc, f"c{ch}", ch, 6 - ch) for ch in range(1, 5) for sc in range(6 - ch)]
    scores = [(1, sc, f"c{ch}", 10.0 * ch + sc) for ch in range(1, 5) for sc in range(5)]
    got = C.longest_communities(spark.createDataFrame(chains, "series int, scene long, com string, chain long, length long"),
                                spark.createDataFrame(scores, "series int, scene long, com string, balance double"), 2)
    assert {tuple(x) for x in got.select("series", "chain", "scene", "balance").collect()} == {(1, ch, sc, 10.0 * ch + sc) for ch in (1, 2) for sc in range(6 - ch)}


def test_local_diarization(spark):
    rng = np.random.default_rng(31)
    n = 7
    x, dur = rng.normal(size=(2, n, 2)), rng.uniform(0.5, 2.0, size=(2, n))
    rows = [(u, i, x[u, i].tolist(), float(dur[u, i])) for u in range(2) for i in range(n)] + [(5, 0, [0.0, 1.0], 1.0)]
    got = V.local_diarization(spark.createDataFrame(rows, "unit int, pos int, x array<double>, dur double")).collect()
    assert {g["unit"] for g in got} == {0, 1}  # a unit of one utterance is left out
    for u in range(2):
        w = dur[u] / dur[u].sum()
        dm = np.linalg.norm(x[u][:, None] - x[u][None], axis=2) ** 2 * w[:, None] * w[None]
        steps = _tree({(i, j): float(dm[i, j]) for i in range(n) for j in range(i + 1, n)}, list(w), "ward")
        scored = []
        for k in range(2, n + 1):
            lab = list(range(n))
            for _, a, b in steps[: n - k]:
                lab = [a if v == b else v for v in lab]
            s = []
            for i in range(n):
                own = [j for j in range(n) if lab[j] == lab[i] and j != i]
                if own:
                    a_ = dm[i, own].mean()
                    b_ = min(dm[i, [j for j in range(n) if lab[j] == c]].mean() for c in set(lab) if c != lab[i])
                    s.append((b_ - a_) / max(a_, b_))
                else:
                    s.append(0.0)
            scored.append((round(float(np.mean(s)), 9), k, lab))
        assert [g["cluster"] for g in sorted((g for g in got if g["unit"] == u), key=lambda g: g["pos"])] == max(scored, key=lambda t: t[:2])[2]
