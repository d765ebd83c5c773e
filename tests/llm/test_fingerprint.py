import hashlib
import random
import re
from collections import Counter

import pytest

from turnloom.llm import fingerprint


def plain(rows):
    """doc_id, length, digest of the edited text, and the similarities themselves."""
    terms = lambda t: Counter(re.split(r"[ \t-\r]", t))

    def alike(a, b):
        a, b = terms(a), terms(b)
        return sum((a & b).values()) / sum((a | b).values())

    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), alike(t, edited), alike(t, after)))
    return out


def test_edge_cases(spark, edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = fingerprint.fingerprints(edge).collect()
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(str(r[:3]) for r in plain(rows))
    assert all(len(r["fingerprint"]) == len(r["edited_fingerprint"]) == fingerprint.SAMPLES * fingerprint.DIGITS for r in got)
    assert fingerprint.fingerprints(none).count() == 0
    (one,) = fingerprint.fingerprints(edge.where("doc_id = 1")).collect()
    assert one["near_next"] == 1.0


def test_likeness_follows_the_similarity(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{rng.randrange(300)}" for _ in range(4))])
    rows, t = [], [word() for _ in range(60)]
    for i in range(150):
        t = [w if rng.random() < 0.8 else word() for w in t] if i % 7 else [word() for _ in range(rng.randrange(1, 200))]
        rows.append((3 * i, " ".join(t)))
    rows += [(3 * i + 1, rows[i][1]) for i in range(0, 150, 9)]
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints, off = {}, []
    for d, n, sha, near_edited, near_next in plain(rows):
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        off += [r["near_edited"] - near_edited, r["near_next"] - near_next]
        prints.setdefault(dict(rows)[d], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert abs(sum(off) / len(off)) < 0.015  # no bias
    assert (sum(x * x for x in off) / len(off)) ** 0.5 < 0.06 and max(map(abs, off)) < 0.25  # sqrt(p (1 - p) / 64)


def test_plan_has_no_python(spark, edge):
    plan = fingerprint.fingerprints(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("count", [1, 2, 7, 50])
def test_blocks(spark, count):
    rows = [(i * 3 % 101, "t") for i in range(101)] + [(5, "u"), (5, "a")]
    df = spark.createDataFrame(rows, "key long, text string")
    out, n = fingerprint._blocks(df, count)
    out = out.collect()
    own = [r for r in out if not r["halo"]]
    assert len(own) == len(rows) and 1 <= n <= count
    low = {}
    for r in own:
        low.setdefault(r["block"], []).append(r["key"])
    tops = [max(low[b]) for b in range(n)]
    assert tops == sorted(tops) and all(min(low[b + 1]) > tops[b] for b in range(n - 1))
    for r in out:
        if r["halo"]:
            assert r["key"] == tops[(r["block"] - 1) % n]
    assert {r["block"] for r in out if r["halo"]} == set(range(n))
