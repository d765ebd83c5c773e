"""Communities by modularity against all partitions, planted ones and label propagation."""

import random

import numpy as np
from pyspark.sql import functions as F

from turnloom.catalog.communities import views
from turnloom.operators import communities as C


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [items[0], *part], *rest[i + 1 :]]


def score(edges, groups):
    of = {v: i for i, g in enumerate(groups) for v in g}
    all_ = 2 * sum(edges.values())
    deg = {}
    for (a, b), w in edges.items():
        deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
    inside = 2 * sum(w for (a, b), w in edges.items() if of[a] == of[b])
    return inside / all_ - sum(sum(deg[v] for v in g) ** 2 for g in groups) / all_**2


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["com"], []).append(r["speaker"])
    assert all(min(g) == c for c, g in out.items())
    return list(out.values())


def test_small_views_are_best_and_moves_come_close(spark, monkeypatch):
    r = random.Random(2)
    nets = []
    for _ in range(12):
        names = [f"s{i}" for i in range(r.randrange(2, 8))]
        e = {(a, b): float(r.randrange(1, 9)) for i, a in enumerate(names) for b in names[i + 1 :] if r.random() < 0.6}
        nets.append(e or {("s0", "s1"): 1.0})
    df = spark.createDataFrame([(1, k, a, b, w) for k, e in enumerate(nets) for (a, b), w in e.items()], "series int, scene long, src string, dst string, weight double").cache()
    best = [max(score(e, p) for p in partitions(sorted({v for x in e for v in x}))) for e in nets]
    got = C.modular_communities(df).collect()
    for k, e in enumerate(nets):
        assert abs(score(e, groups_of([x for x in got if x["scene"] == k])) - best[k]) < 1e-9
    q = {x["scene"]: x["modularity"] for x in C.modularity(df, C.modular_communities(df)).collect()}
    assert all(abs(q[k] - best[k]) < 1e-9 for k in range(len(nets)))
    for k, e in enumerate(nets):  # the same views by moves alone
        both = [(a, b, w) for (a, b), w in e.items()] + [(b, a, w) for (a, b), w in e.items()]
        names = sorted({a for a, _, _ in both})
        links = [{names.index(b): w for a, b, w in both if a == n} for n in names]
        label = C._multilevel(links, list(range(len(names))))
        assert score(e, [[n for n, c in zip(names, label, strict=True) if c == x] for x in set(label.tolist())]) > best[k] - 0.1


def test_planted_groups(spark):
    r = random.Random(8)
    rows = [(1, 1, f"p{i:02}", f"p{j:02}", float(r.randrange(5, 9) if i % 4 == j % 4 else r.randrange(0, 2))) for i in range(40) for j in range(i + 1, 40)]
    df = spark.createDataFrame(rows, "series int, scene long, src string, dst string, weight double")
    got = C.modular_communities(df).collect()
    assert {frozenset(g) for g in groups_of(got)} == {frozenset(f"p{i:02}" for i in range(k, 40, 4)) for k in range(4)}
    assert C.modular_communities(df.limit(0)).count() == 0


def test_not_below_label_propagation(spark):
    v = views(spark, "/root/testdata/sf0.01")
    a = C.modularity(v, C.modular_communities(v)).withColumnRenamed("modularity", "q1")
    b = C.modularity(v, C.communities(v)).withColumnRenamed("modularity", "q2")
    both = a.join(b, ["series", "scene"], "full")
    assert both.count() > 50 and both.where("q1 is null or q2 is null or q1 < q2 - 1e-9").count() == 0


def test_partitions():
    assert [len(C._partitions(n)) for n in range(1, 7)] == [1, 2, 5, 15, 52, 203]
    assert len(np.unique(C._partitions(6), axis=0)) == 203
