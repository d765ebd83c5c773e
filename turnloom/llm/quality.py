"""Text quality by a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it.
``FILTERS`` learned filters, ``WIDTH`` bytes wide, slide over every chunk; each
is max-pooled to one value per chunk and filter.  A chunk's values give one chunk
logit; the lowest and the mean chunk logit of the text are combined into the
logit of its quality.  A filter is a table of one weight per place and byte,
which is a convolution over one-hot bytes.

The fit is bounded by documented parameters: at most ``EACH`` texts of either
label, weighted back to the shares of the labels.  Scoring reads all bytes.

Cases: a null or empty text is one chunk without bytes.  With one label only, or
none, every score is the share of good labels (1 without labels).  Rows without
a doc_id or a label are never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import slices
from turnloom.llm.labelled import hashed_sample, with_texts

FILTERS, WIDTH, CHUNK, STRIDE = 16, 6, 256, 192
EACH, EPOCHS, BATCH, RATE = 900, 10, 40, 0.01


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    chunk: np.ndarray  # FILTERS + 1: weights of the pooled values, constant
    text: np.ndarray  # 3: lowest chunk, mean chunk, constant


def start(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    return Model(
        rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        np.append(rng.normal(0, 0.3, FILTERS), 0.0).astype(np.float32), np.array([1.0, 0.3, 1.0], np.float32),
    )


def layout(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded by WIDTH zeros; first and last window of each chunk; text of each chunk."""
    data = np.frombuffer(b"".join(p + bytes(WIDTH) for p in parts), dtype=np.uint8)
    n = np.array([len(p) for p in parts], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(n + WIDTH)))[:-1]
    chunks = np.maximum(1, -(-(n - (CHUNK - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(parts)), chunks)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = base[doc] + within * STRIDE
    last = np.minimum(first + CHUNK, base[doc] + np.maximum(n[doc], 1))
    return data, first, last, doc


def pooled(model: Model, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter responses at every byte, and their maximum per chunk (at least 0)."""
    z = model.table[0][data]
    for o in range(1, WIDTH):
        z[:-o] += model.table[o][data[o:]]
    z += model.bias
    ends = np.stack((first, last), axis=1).ravel()
    # the chunks overlap: every second piece of reduceat is a chunk, the others are skipped
    return z, np.maximum(np.maximum.reduceat(z, np.minimum(ends, len(z) - 1), axis=0)[::2], 0)


def forward(model: Model, parts: list[bytes]) -> dict[str, np.ndarray]:
    data, first, last, doc = layout(parts)
    z, h = pooled(model, data, first, last)
    c = h @ model.chunk[:-1] + model.chunk[-1]
    at = np.searchsorted(doc, np.arange(len(parts)))
    low = np.minimum.reduceat(c, at)
    mean = np.add.reduceat(c, at) / np.diff(np.append(at, len(c)))
    logit = model.text[0] * low + model.text[1] * mean + model.text[2]
    return {"data": data, "first": first, "last": last, "doc": doc, "z": z, "h": h, "c": c, "at": at, "low": low, "mean": mean, "logit": logit}


def gradient(model: Model, parts: list[bytes], y: np.ndarray, weight: np.ndarray) -> Model:
    """Gradient of the weighted logistic loss; pooling passes it to the place of the maximum."""
    f = forward(model, parts)
    g = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight
    text = np.array([g @ f["low"], g @ f["mean"], g.sum()])
    count = np.diff(np.append(f["at"], len(f["c"])))
    gc = (g * model.text[1] / count)[f["doc"]]
    lowest = np.flatnonzero(f["c"] == f["low"][f["doc"]])
    lowest = lowest[np.concatenate(([True], np.diff(f["doc"][lowest]) > 0))]
    gc[lowest] += g * model.text[0]
    chunk = np.append(gc @ f["h"], gc.sum())
    gh = gc[:, None] * model.chunk[:-1] * (f["h"] > 0)
    table, bias = np.zeros_like(model.table), gh.sum(axis=0)
    place = np.stack([a + f["z"][a:b].argmax(axis=0) for a, b in zip(f["first"], f["last"], strict=True)])
    who = np.broadcast_to(np.arange(FILTERS), place.shape)
    for o in range(WIDTH):
        np.add.at(table[o], (f["data"][np.minimum(place + o, len(f["data"]) - 1)], who), gh)
    return Model(table, bias, chunk, text)


def fit(texts: list[bytes], y: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 7) -> Model:
    model, rng = start(seed), np.random.default_rng(seed)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    names = [x.name for x in fields(Model)]
    m = {k: np.zeros_like(getattr(model, k)) for k in names}
    v = {k: np.zeros_like(getattr(model, k)) for k in names}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            g = gradient(model, [texts[i] for i in pick], y[pick], weight[pick] / len(pick))
            step += 1
            for k in names:
                d = getattr(g, k).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                rate = RATE * (1 - epoch / epochs)
                getattr(model, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return model


def constant(p: float) -> Model:
    model = start()
    p = min(max(p, 1e-9), 1 - 1e-9)
    model.text[:] = (0, 0, np.log(p / (1 - p)))
    return model


def learn(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Model:
    """Fit on the texts of ``labels`` (doc_id, quality); pass only rows that may be learned from."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null")
    share = lab.agg(F.avg("quality")).first()[0]
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = None
    for q in (0, 1):
        part = hashed_sample(lab.where(F.col("quality") == q), each).withColumn("quality", F.lit(q))
        ids = part if ids is None else ids.unionByName(part)
    got = sorted(with_texts(docs, ids).select("doc_id", "text", "quality").collect())
    y = np.array([r["quality"] for r in got])
    if share is None or len(set(y.tolist())) < 2:
        return constant(1.0 if share is None else share)
    return fit([r["text"].encode() for r in got], y, share)


def score(model: Model, text: Column) -> Column:
    """Probability that a text is of good quality."""

    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for at, parts in slices(texts, 1 << 18):
            out[at : at + len(parts)] = 1 / (1 + np.exp(-np.clip(forward(model, parts)["logit"], -40, 40)))
        return pd.Series(out)

    return apply(text)
