import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from turnloom.llm import exact, spread
from turnloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return sorted(((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
                   for d, t in rows), key=repr)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def check(df, capacity=exact.CAPACITY):
    got = exact.exact_duplicates(df, capacity).collect()
    rows = pairs(df)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == expected(rows)
    kept = [r for r in got if r["kept"]]
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert sorted(r["text_sha256"] for r in kept) == sorted({e[3] for e in expected(rows)})  # one row of each group, no more
    stay = exact.one_of_each(df, capacity)
    assert stay.columns == df.columns
    assert sorted(pairs(stay), key=repr) == sorted(((r["doc_id"], t) for r in kept for t in {t for _, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"] and (r["doc_id"], t) in rows}), key=repr)


def test_query(spark, docs):
    got = QUERIES["op12_exact"](spark, SF)
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()), key=repr) == expected(pairs(docs))
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_edge_cases(spark, edge, none):
    rows = edge.where("text is not null and doc_id is not null or doc_id is null")
    check(rows.where("text is not null"))
    assert exact.exact_duplicates(none).collect() == []
    assert exact.one_of_each(none).collect() == []
    got = {(r["doc_id"], r["group_size"], r["keep_id"], r["kept"]) for r in exact.exact_duplicates(edge.where("coalesce(text, '') = ''")).collect()}
    assert got == {(3, 3, 4, False), (4, 3, 4, True), (None, 3, 4, False)}  # null and empty are equal


def test_chains_where_keys_collide(spark, docs, monkeypatch):
    monkeypatch.setattr(exact, "key_of", lambda text: F.shiftleft(F.length(text) % 3, 62))
    index, _ = exact.build_index(docs, 1)
    links = index.groupBy("bucket", "key").agg(F.count("*").alias("n"), F.max("link").alias("m"), F.countDistinct("sha").alias("d")).collect()
    assert len(links) == 3 and all(r["n"] == r["m"] == r["d"] for r in links)
    check(docs.select("doc_id", "text"), 1)


def test_hot_groups(spark, docs, monkeypatch):
    for share in (1, 10**9):  # every group goes by the shuffled join, or every group by broadcast
        monkeypatch.setattr(spread, "HOT", share)
        check(docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id + 10000 as doc_id", "'the same' as text")))


def test_directory(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    for capacity in (1, 50, 10**6):
        rows = exact.directory(spark, keys, capacity).collect()
        slots = {r["slot"]: (r["depth"], r["bucket"]) for r in rows}
        assert len(rows) == len(slots) == 1 << exact.MAX_DEPTH
        top = [(r["key"] % 2**64) >> (64 - exact.MAX_DEPTH) for r in keys.collect()]
        within = lambda first, depth: sum(first <= t < first + (1 << (exact.MAX_DEPTH - depth)) for t in top)
        for depth, bucket in random.Random(3).sample(sorted(set(slots.values())), min(40, len(set(slots.values())))):
            width = 1 << (exact.MAX_DEPTH - depth)
            assert bucket % width == 0 and all(slots[s] == (depth, bucket) for s in (bucket, bucket + width - 1))
            assert within(bucket, depth) <= capacity or depth == exact.MAX_DEPTH
            assert depth == 0 or within(bucket & ~width, depth - 1) > capacity  # not split without need
