"""Representative episodes against all sets."""

import itertools
import random
from collections import Counter

from turnloom.operators import aggregates as A


def test_best_set_of_episodes(spark, monkeypatch):
    monkeypatch.setattr(A, "EPISODE_TILE", 3)
    r = random.Random(6)
    rows, units = [], 0
    for e in range(9):
        for _ in range(r.randrange(3, 9)):
            units += 1
            for s in range(r.choice([1, 1, 2, 3, 4])):
                rows += [(e, units, f"s{s}", 0, 10)] * r.randrange(1, 3)
    df = spark.createDataFrame(rows, "episode int, unit int, speaker string, start_ms long, end_ms long")
    hist = {}
    for e in range(9):
        per = {}
        for ep, u, s, _, _ in rows:
            if ep == e:
                per.setdefault(u, []).append(s)
        hist[e] = Counter()
        for own in per.values():
            hist[e][len(set(own))] += len(own)
    share = lambda h: {k: v / sum(h.values()) for k, v in h.items()}
    goal = share(sum(hist.values(), Counter()))
    for k in (1, 2, 3):
        best = None
        for some in itertools.combinations(range(9), k):
            p = share(sum((hist[e] for e in some), Counter()))
            d = round(sum(abs(p.get(b, 0) - goal[b]) for b in goal), 9)
            best = max(best or (-d, some), (-d, some))
        got = sorted((x["step"], x["episode"], round(x["distance"], 8)) for x in A.representative_episodes(df, k).collect())
        assert got == [(i + 1, e, round(-best[0], 8)) for i, e in enumerate(best[1])]
    assert A.representative_episodes(df.where("episode < 2"), 5).count() == 2
    assert A.representative_episodes(df.limit(0), 2).count() == 0
