import random
import re

import numpy as np
import pandas as pd
import pytest

from turnloom.llm import dedup
from turnloom.llm.components import connected


def plain_sets(rows, k):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((doc_id, {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()))
    return out


def plain_components(rows, k, percent=80):
    sets = plain_sets(rows, k)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted((str(d), len(s), str(None if low[find(i)][0] else low[find(i)][1])) for i, (d, s) in enumerate(sets))


def near_copies(n, seed):
    """A large group of near copies edited more and less, chains, exact copies, a common passage in short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(90)], [word() for _ in range(30)]
    texts = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    for i in range(n // 2):
        texts.append(passage + [word() for _ in range(rng.randrange(1, 25))])
    chain = [word() for _ in range(60)]
    for i in range(20):
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(list(chain))
    texts += [texts[0]] * 10 + [["A", "b"], ["a", "B"], ["a", "c"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k", [(1, 4), (2, 5)])
def test_components_as_by_comparing_all(spark, seed, k):
    rows = near_copies(80, seed)
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edge_cases(spark, edge, none):
    got = dedup.near_duplicates(edge, k=4).collect()
    rows = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows, 4)
    assert dedup.near_duplicates(none).count() == 0
    one = dedup.one_of_each(edge, k=4)
    assert one.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in one.collect()) == sorted(map(str, [1, 3, 4, 5, None, None, 7, 9, 10, 11, 12]))
    assert dedup.one_of_each(none).count() == 0


def test_one_of_each_group_whatever_its_ids(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " end"), (None, text("b")), (5, text("c")), (5, text("d")), (5, text("d")), (6, text("d") + " end"),
            (None, text("e")), (7, text("e") + " end"), (8, text("f")), (8, text("f") + " end")]
    kept = [(r["doc_id"], r["text"].split()[0][0]) for r in dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept, key=str) == sorted([(None, "a"), (None, "b"), (5, "c"), (5, "d"), (7, "e"), (8, "f")], key=str)


def test_sketch_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 1500):
        shared = rng.integers(0, 2**63, n, dtype=np.uint64)
        own = [rng.integers(0, 2**63, n // 3, dtype=np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate((shared, o))) for o in own)
        sa, sb = dedup.sketch(a), dedup.sketch(b)
        assert (sa != np.iinfo(np.uint64).max).all() and (sb != np.iinfo(np.uint64).max).all()
        assert abs((sa == sb).mean() - n / (n + 2 * (n // 3))) < 0.2
    assert (dedup.sketch(np.array([5], np.uint64)) == dedup.sketch(np.array([5], np.uint64))).all()


def test_connected(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    low = {}
    for _ in range(400):
        for a, b in links:
            low[a] = low[b] = min(low.get(a, a), low.get(b, b))
    want = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: low[x] for x in want}


def test_signatures_are_handed_on_in_parts():
    texts = [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(40)] + [None, "", "one"]
    pdf = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    got = list(dedup._signatures(5, False)([pdf]))
    assert len(got) > 2 and max(sum(map(len, g["detail"])) for g in got) < 100_000
    assert [d for g in got for d in g["doc_id"]] == list(range(len(texts)))
    assert [n for g in got for n in g["n"]] == [3996] * 40 + [0, 0, 1]
    for bare in dedup._signatures(5, None)([pdf]):
        assert all(d.base is None or d.base.size == 0 for d in bare["detail"])  # keeps no set alive
