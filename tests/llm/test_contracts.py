"""The registered queries against their contracts, and the two fits against plain formulas."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from turnloom.llm import quality, toxicity
from turnloom.llm.common import run_hashes
from turnloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(spark, name):
    got = QUERIES[name](spark, SF).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize(("name", "limit"), [("op2_toxicity", 0.5), ("op8_quality", 0.3)])
def test_scores(spark, texts, name, limit):
    got = by_id(spark, name)
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    same = {}
    for d, t in texts.items():
        assert same.setdefault(t, got[d]["score"]) == got[d]["score"]


def test_media(spark, texts):
    got = by_id(spark, "op4_webp")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        raw = t.encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-64:]) and r["media_bytes"] > 0 and len(r["media_sha256"]) == 64 and r["feature"]
    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a] == texts[b]:
            assert got[a]["media_sha256"] == got[b]["media_sha256"] and got[a]["feature"] == got[b]["feature"]


def test_id_files(spark, texts):
    lib, start, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, by_id(spark, "op5_id_files")
    for d in sorted(texts):
        ids = [*lib.encode(texts[d], add_special_tokens=False).ids, 0]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces(spark, texts):
    sp, got = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), by_id(spark, "op7_pieces")
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = sp.encode(t)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_fingerprints(spark, texts):
    got, order = by_id(spark, "op10_fingerprints"), sorted(texts, reverse=True)
    assert got.keys() == texts.keys()
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        t, half = texts[d], len(texts[d]) // 2
        edited = t[: len(t) - half] + texts[after][:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == got[after]["fingerprint"]) == (r["near_next"] == 1)
        if edited == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]


def test_toxicity_follows_the_risk(monkeypatch):
    """Weights after a few steps, with gradients taken from the risk itself by differences."""
    monkeypatch.setattr(toxicity, "EPOCHS", 25)
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(0, 2**63, 6).astype(np.uint64))
    dense = [(rng.random((n, 6)) < 0.5).astype(float) for n in (9, 30)]
    dense[0][:, 0] = 1
    lists = [[np.flatnonzero(row) for row in x] for x in dense]
    for prior in (0.2, 0.9):  # the second drives the negative part below zero
        got = toxicity.fit(*lists, words, prior)
        (pos, unl), w = dense, np.zeros(7)
        soft = lambda z: np.logaddexp(0, z)

        def parts(w):
            zp, zu = pos @ w[:6] + w[6], unl @ w[:6] + w[6]
            return prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean()

        m, v, low = np.zeros(7), np.zeros(7), False
        for step in range(1, 26):
            negative = parts(w)[1]
            low |= negative < 0
            risk = (lambda x: sum(parts(x))) if negative >= 0 else (lambda x: -parts(x)[1])
            g = np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(7) * 1e-5])
            g[:6] += toxicity.DECAY * w[:6]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        assert np.allclose(np.append(got.weights, got.bias), w, atol=1e-4)
        assert low == (prior == 0.9)


def test_toxicity_score_by_words():
    hash_of = lambda b: int(run_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
    known = {b"scum": 1.5, b"idiot": 2.0, b"idio": -0.25, "größe".encode(): 0.5}
    pairs = sorted((hash_of(k), v) for k, v in known.items())
    model = toxicity.Model(np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]), -1.0)
    for t in ("", "idiot idiot scum!", "an idiotic größe", "scums", "Scum".lower(), "x" * 5000 + " scum"):
        raw, seen = t.encode(), set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", raw):
            seen |= {word} | {word[:n] for n in toxicity.BEGINNINGS if len(word) > n}
        assert math.isclose(model.logits([raw])[0], -1.0 + sum(v for k, v in known.items() if k in seen))


def test_quality_forward_is_a_plain_convolution():
    rng = np.random.default_rng(5)
    model = quality.start(3)
    model.table[...] = rng.normal(size=model.table.shape)
    model.bias[...] = rng.normal(size=model.bias.shape)
    model.chunk[...] = rng.normal(size=model.chunk.shape)
    model.text[...] = rng.normal(size=model.text.shape)
    parts = [b"a short text", b"", bytes(rng.integers(1, 256, 1500).astype(np.uint8))]
    got = quality.forward(model, parts)
    data, first, last, doc = quality.layout(parts)
    low, mean = [[] for _ in parts], None
    for a, b, d in zip(first, last, doc, strict=True):
        best = np.zeros(quality.FILTERS)
        for t in range(a, b):
            z = model.bias.astype(float).copy()
            for o in range(quality.WIDTH):
                if t + o < len(data):
                    z += model.table[o][data[t + o]]
            best = np.maximum(best, z)
        low[d].append(best @ model.chunk[:-1] + model.chunk[-1])
    for d, c in enumerate(low):
        mean = float(np.mean(c))
        assert math.isclose(got["logit"][d], model.text[0] * min(c) + model.text[1] * mean + model.text[2], rel_tol=1e-3, abs_tol=1e-3)


def test_one_text_per_labelled_row(spark):
    """Rows that repeat a labelled id do not swell the sample; whole texts, however long."""
    from turnloom.llm.labelled import with_texts

    rows = [(1, "a")] * 50 + [(1, "b")] * 50 + [(2, "x" * 150_000), (3, None), (None, "y"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    got = sorted((r["doc_id"], r["toxic"], r["text"][:1], len(r["text"])) for r in with_texts(docs, ids).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (2, 1)] and got[0][2] == got[1][2] and got[2][3] == 150_000
