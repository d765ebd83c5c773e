import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom.llm import language, quality, toxicity


# ---- language


def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(letters.split()) + " "
    grams = Counter()
    if padded.strip():
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if not (n == 1 and g == " " or n == 3 and g[1] == " "):
                    grams[g] += 1
    return grams


def by_code(grams):
    value = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return [value(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], value(x[0])))][: language.TOP]


def test_language_as_by_counting(spark, docs):
    rows = docs.select("doc_id", "text", "lang").collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    counts = {}
    for r in train:
        counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    want = {lang: by_code(c) for lang, c in counts.items()}
    got = language.learn_profiles(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    assert {k: list(v) for k, v in got} == want
    place = {lang: {g: i for i, g in enumerate(p)} for lang, p in want.items()}
    pred = {r["doc_id"]: r["p"] for r in docs.select("doc_id", language.predict(got, F.col("text")).alias("p")).collect()}
    right = 0
    for r in rows:
        own = by_code(plain_grams(r["text"]))
        far = {lang: sum(abs(i - p[g]) if g in p else language.TOP for i, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(far), key=lambda x: far[x])
        assert pred[r["doc_id"]]["lang_pred"] == best
        assert abs(pred[r["doc_id"]]["score"] - (1 - far[best] / language.TOP / len(own))) < 1e-12
        right += best == r["lang"]
    assert right >= 0.97 * len(rows)


def test_language_edge_cases(spark, edge, none):
    profiles = language.learn_profiles(edge)
    assert [p[0] for p in profiles] == ["", "de", "en", "fr"]
    got = edge.select("doc_id", "text", language.predict(profiles, F.col("text")).alias("q")).collect()
    for r in got:
        has = r["text"] is not None and any(c.isalpha() for c in r["text"])
        assert (r["q"]["lang_pred"] == "und") == (not has) and 0 <= r["q"]["score"] <= 1
    assert language.learn_profiles(none) == []
    assert {r["q"]["lang_pred"] for r in edge.select(language.predict([], F.col("text")).alias("q")).collect()} == {"und"}


# ---- toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    bad = [f"zork{w}" for w in words[:10]] + ["quux", "blarg"]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                t[rng.randrange(len(t))] = rng.choice(bad).upper() if rng.random() < 0.3 else rng.choice(bad) + "!"
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_toxicity_learns_from_positive_and_unlabelled(spark):
    rows = toxic_rows(3000, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.where("doc_id % 2 = 0 and doc_id < 2400").select("doc_id", "toxic")
    model = toxicity.learn(df.where("doc_id < 2400").drop("toxic"), labels)
    got = df.where("doc_id >= 2400").select("toxic", (toxicity.score(model, F.col("text")) >= 0.5).cast("int").alias("p")).collect()
    wrong = [r for r in got if r["toxic"] != r["p"]]
    assert len(wrong) <= 0.02 * len(got)


@pytest.mark.parametrize("n,toxic", [(120, 6), (600, 180), (600, 300)])
def test_toxicity_learns_from_few_and_from_many(spark, n, toxic):
    rng = random.Random(n + toxic)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join([word() for _ in range(30)] + ["zork"] * (i < toxic)), int(i < toxic)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = df.select("toxic", (toxicity.score(model, F.col("text")) >= 0.5).cast("int").alias("p")).collect()
    assert all(r["toxic"] == r["p"] for r in got)


def test_toxicity_without_a_telling_word_keeps_all(spark):
    df = spark.createDataFrame([(i, f"word{i}", i % 3 // 2) for i in range(60)], "doc_id long, text string, toxic int")
    for labels in (df, df.withColumn("toxic", F.lit(1)), df.where("toxic = 0")):
        model = toxicity.learn(df, labels.select("doc_id", "toxic"))
        assert all(r["q"] < 0.5 for r in df.select(toxicity.score(model, F.col("text")).alias("q")).collect())


def test_toxicity_edge_cases(spark, edge, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (7, 0)], "doc_id long, toxic int")
    for d, lab in ((edge, labels), (none, labels), (edge, labels.limit(0)), (none, labels.limit(0))):
        model = toxicity.learn(d, lab)
        got = edge.select(toxicity.score(model, F.col("text")).alias("q")).collect()
        assert all(0 <= r["q"] <= 1 for r in got)
    assert all(r["q"] < 0.5 for r in got)


def test_toxicity_score_sees_the_whole_text():
    model = toxicity.Model(np.sort(toxicity.word_hashes([b"bad"])[0]), np.array([10.0]), -5.0)
    long = b"fine " * 400_000
    assert model.logits([long, long + b"bad", b"bad bad", b"", b"badly"]).tolist() == [-5.0, 5.0, 5.0, -5.0, -5.0]


# ---- quality


def test_quality_gradient():
    rng = np.random.default_rng(1)
    model = quality.start()
    parts = [bytes(rng.integers(32, 120, n, dtype=np.uint8)) for n in (5, 300, 700, 0)]
    y, w = np.array([1, 0, 1, 0]), np.array([0.5, 1.0, 2.0, 1.0])
    model.table = model.table.astype(np.float64)

    def loss():
        z = quality.forward(model, parts)["logit"]
        return float((w * (np.logaddexp(0, z) - y * z)).sum())

    grad = quality.gradient(model, parts, y, w)
    for name in ("text", "chunk", "table"):
        a, g = getattr(model, name), getattr(grad, name)
        for at in [np.unravel_index(i, a.shape) for i in np.argsort(-np.abs(g).ravel())[:4]]:
            old, step = a[at], 1e-4
            a[at] = old + step
            up = loss()
            a[at] = old - step
            down = loss()
            a[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 2e-2 * max(1, abs(g[at]))


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        _, first, last, doc = quality.layout([b"q" * n, b"r" * 10])
        own = [(a, b) for a, b, d in zip(first, last, doc, strict=True) if d == 0]
        assert own[0][0] == 0 and own[-1][1] == max(n, 1)
        assert all(b > c for (_, b), (c, _) in zip(own, own[1:], strict=False))


def test_quality_learns(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        good = rng.random() < 0.7
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(20, 200)))
        rows.append((i, t if good else t[: len(t) // 2] + " ### $$$ &&& " * 4 + t[len(t) // 2 :], int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.learn(df, df.where("doc_id < 500").select("doc_id", "quality"))
    got = df.where("doc_id >= 500").select("quality", (quality.score(model, F.col("text")) >= 0.3).cast("int").alias("p")).collect()
    assert sum(r["quality"] != r["p"] for r in got) <= 0.03 * len(got)


def test_quality_edge_cases(spark, edge, none):
    both = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None), (9, 0)], "doc_id long, quality int")
    for d, lab in ((edge, both), (edge, both.where("quality = 1")), (edge, both.limit(0)), (none, both)):
        model = quality.learn(d, lab)
        got = edge.select(quality.score(model, F.col("text")).alias("q")).collect()
        assert all(0 <= r["q"] <= 1 for r in got)


def test_language_limits_count_every_text(spark):
    rows = spark.range(20_000).select(
        F.xxhash64("id").alias("text_hash"), F.lit("en").alias("lang"), F.lit("en").alias("lang_pred"), ((F.col("id") + 1) / 20_000).alias("score"))
    none = spark.createDataFrame([(-1, None, "en", 0.0), (-2, "en", "und", 0.0)], "text_hash long, lang string, lang_pred string, score double")
    got = language.loosest_scores(rows.unionByName(rows).unionByName(none))  # copies count once, nameless and unknown texts not at all
    assert list(got) == ["en"] and abs(got["en"] * 20_000 - 40) <= 2
