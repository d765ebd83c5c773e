import hashlib
import math

import pytest
from pyspark.sql import functions as F

from turnloom.llm import mixing


def expected(rows, budget, entropy, repeats):
    """(copies by row, weights) with an exponent found by trying 2 ** 14 steps and weights compared loosely by the caller."""
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    total = {s: n for s, n in total.items() if n}
    p = {s: n / sum(total.values()) for s, n in total.items()}

    def weights(x):
        z = sum(v**x for v in p.values())
        return {s: v**x / z for s, v in p.items()}

    def fits(x):
        w = weights(x)
        return -sum(v * math.log(v) for v in w.values()) >= entropy * math.log(len(w))

    def calm(x):
        return max(w * budget / total[s] for s, w in weights(x).items()) <= repeats

    steps = [i / 2**14 for i in range(2**14 + 1)]
    x = max((i for i in steps if fits(i)), default=0)
    while x < 1 and not calm(x):
        x += 2**-14
    return weights(x), total


@pytest.mark.parametrize("entropy,repeats,share", [(0.95, 4.0, 1.0), (0.99, 1.5, 0.8), (0.5, 9.0, 2.0), (1.0, 100.0, 1.0)])
def test_weights_and_copies(spark, entropy, repeats, share):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", 5 + i * 7919 % 90) for i in range(900)] + [(1000, None, 40), (None, None, 30), (1001, "empty", 0)]
    budget = int(share * sum(r[2] for r in rows))
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = mixing.mixed(df, ["doc_id", "source"], F.col("n"), budget, entropy, repeats).collect()
    weights, total = expected(rows, budget, entropy, repeats)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        assert abs(r["weight"] - weights.get(r["source"], 0)) < 2e-4
        seen.setdefault(r["source"], []).append(r)
    for s, rs in seen.items():
        if not total.get(s):
            assert [r["copies"] for r in rs] == [1] * len(rs)
            continue
        due = math.floor(rs[0]["weight"] * budget)
        passes, rest = divmod(due, total[s])
        used = 0
        blocks = {}
        for r in rs:
            key = hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
            blocks.setdefault(key[:3], []).append((key, r))
        for b in sorted(blocks, key=lambda b: (hashlib.md5(f"{s or ''}:{b}".encode()).hexdigest(), b)):
            block = sorted(blocks[b], key=lambda x: (x[0], x[1]["doc_id"] or 0))
            size, room = sum(r["n_tokens"] for _, r in block), rest - used
            upto = 0
            for _, r in block:
                upto += r["n_tokens"]
                assert r["copies"] == passes + (room > 0 and (size <= room or upto <= room))
            used += size
        assert sum(r["copies"] * r["n_tokens"] for r in rs) <= due


def test_edge_cases(spark, edge, none):
    got = mixing.mixed(edge, ["doc_id", "text"], mixing.token_estimate(F.col("text")))
    rows = got.collect()
    assert len(rows) == edge.count() and all(r["copies"] >= 0 for r in rows)
    assert mixing.mixed(none, ["doc_id"], mixing.token_estimate(F.col("text"))).count() == 0
    one = edge.where("source = 'a'")
    assert {r["copies"] for r in mixing.mixed(one, ["doc_id"], mixing.token_estimate(F.col("text"))).collect()} == {1}
