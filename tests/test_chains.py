"""Chains of matched communities and their numbers, against walking along the links."""

import random

import pytest

from turnloom.catalog import load
from turnloom.operators import communities as C

SMALL = "/root/testdata/sf0.001"


def walked(links):
    """{(series, scene, com): (number of its chain, its length)} of links (series, scene, com1, com2)."""
    after = {(s, t, a): (s, t + 1, b) for s, t, a, b in links}
    heads = set(after) - set(after.values())
    chains = []
    for at in heads:
        chain = [at]
        while chain[-1] in after:
            chain.append(after[chain[-1]])
        chains.append(chain)
    out, used = {}, {}
    for chain in sorted(chains, key=lambda c: (c[0][0], -len(c), -c[0][1], c[0][2])):
        used[chain[0][0]] = number = used.get(chain[0][0], 0) + 1
        out.update({at: (number, len(chain)) for at in chain})
    return out


def rows(df):
    got = [((r["series"], r["scene"], r["com"]), (r["chain"], r["length"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.fixture(scope="module")
def links():
    """Random one-to-one links: three series, one of them a single chain of 300 scenes, one full of ties."""
    r, out = random.Random(5), []
    for t in range(40):
        a, b = list("abcde"), list("abcde")
        r.shuffle(a)
        r.shuffle(b)
        out += [(1, t, x, y) for x, y in zip(a, b, strict=True) if r.random() < 0.7]
    out += [(2, t, "x", "x") for t in range(299)]
    out += [(3, t, c, c) for t in range(0, 3000, 2) for c in ("p", "q")]
    return out


def test_chains(spark, links):
    matching = spark.createDataFrame([(*x, 0.5) for x in links], "series int, scene long, com1 string, com2 string, cosine double")
    chains = C.dynamic_communities(matching.repartition(7))
    assert rows(chains) == walked(links)


def test_no_chains(spark):
    none = spark.createDataFrame([], "series int, scene long, com1 string, com2 string, cosine double")
    assert C.dynamic_communities(none).count() == 0


def test_labels(spark, links):
    want = walked(links)
    r = random.Random(6)
    found = {(s, t, c) for s, t, c in want} | {(1, t, "alone") for t in range(5)} | {(9, 0, "a")}
    members = [(s, t, f"{c}{k}", c) for s, t, c in sorted(found) if s != 2 or t % 7 == 0 for k in range(r.randrange(1, 3))]
    df = spark.createDataFrame(members, "series int, scene long, speaker string, com string")
    chains = spark.createDataFrame([(*k, *v) for k, v in want.items()], "series int, scene long, com string, chain long, length long")
    got = sorted((x["series"], x["scene"], x["speaker"], x["com"]) for x in C.relabel_communities(df, chains).collect())
    assert got == sorted((s, t, p, want.get((s, t, c), (0, 0))[0]) for s, t, p, c in members)


def test_registered_chains(spark):
    """The registered chains are those of the registered matching."""
    queries = load()[0]
    got = queries["c09_match_partitions"](spark, SMALL).collect()
    links = [(r["series"], r["scene"], r["com1"], r["com2"]) for r in got]
    assert links
    assert len({x[:3] for x in links}) == len({(x[0], x[1], x[3]) for x in links}) == len(links)
    chains = queries["c10_dynamic_communities"](spark, SMALL)
    assert rows(chains) == walked(links)
    longest = {k for k, v in rows(chains).items() if v[1] > 1}
    new = queries["c11_relabel_communities"](spark, SMALL)
    labels = {(r["series"], r["scene"], r["com"]) for r in new.collect()} - {(r["series"], r["scene"], 0) for r in new.collect()}
    assert labels == {(k[0], k[1], walked(links)[k][0]) for k in longest}
