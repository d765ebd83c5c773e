"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled ones.  With the share ``p``
of toxic texts as class prior, the risk of a linear classifier on the presence
of words and of beginnings of words is
``p * E_toxic[l(z)] + max(0, E_unlabelled[l(-z)] - p * E_toxic[l(-z)])``; where
the second part falls below zero, its gradient is reversed, so that the
classifier does not fit the negative estimate.  ``l`` is the logistic loss.

The fit is bounded by documented parameters: at most ``POSITIVES`` toxic and
``UNLABELLED`` unlabelled texts, of which the driver receives those words that
are features.
Scoring covers all words of every text.

A word is a feature if its share among the toxic texts speaks against its share
among the others.  The unlabelled sample holds toxic texts too, so the latter is
estimated as ``(share in unlabelled - p * share in toxic) / (1 - p)``; the evidence
is the log-likelihood ratio of the two shares, which grows with the number of
toxic texts, so that neither few of them nor many toxic texts among the
unlabelled keep the words out.

Cases: null and empty texts have no words and score the bias alone.  Without
toxic or unlabelled training rows or a word that tells them apart every score is
0, so that a filter keeps all.  Rows without a doc_id are
never learned from.  A label counts as toxic if any row of the id says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import joined, release, run_hashes, runs, slices
from turnloom.llm.labelled import hashed_sample, with_texts
from turnloom.session import cut

POSITIVES, UNLABELLED = 4_000, 8_000
LEAST_EVIDENCE, LEAST_LIFT = 10.0, 2.0  # of a feature: log-likelihood ratio, and share among toxic texts by that among others
EPOCHS, RATE, DECAY = 300, 0.05, 2e-4

BEGINNINGS = (4, 5, 6)  # bytes

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word of a slice of lower-cased texts, and of the beginnings of longer words."""
    data, starts = joined(parts)
    a, b = runs(_WORD[data])
    doc = np.searchsorted(starts, a, "right") - 1
    hashes, docs = [run_hashes(data, a, b)], [doc]
    for n in BEGINNINGS:
        long = b - a > n
        hashes.append(run_hashes(data, a[long], a[long] + n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, parts: list[bytes]) -> np.ndarray:
        out = np.full(len(parts), self.bias)
        if not len(self.words):
            return out
        h, doc = word_hashes(parts)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True
        hit = maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
        h, doc = h[hit], doc[hit]
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ok = self.words[at] == h
        pair = np.unique(doc[ok] * len(self.words) + at[ok])
        np.add.at(out, pair // len(self.words), self.weights[pair % len(self.words)])
        return out


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = []
        for _, parts in slices(pdf["text"], lower=True):
            h, doc = word_hashes(parts)
            order = np.argsort(doc, kind="stable")
            cut_at = np.searchsorted(doc[order], np.arange(len(parts) + 1))
            got += [np.unique(h[order[a:b]]).view(np.int64) for a, b in zip(cut_at[:-1], cut_at[1:], strict=True)]
        yield pd.DataFrame({"toxic": pdf["toxic"], "words": got})


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], words: np.ndarray, prior: float) -> Model:
    """Non-negative risk, full batches, Adam; starts at zero, so the result is repeatable.

    Texts are lists of indices into ``words``, the sorted hashes of the features.
    """
    if not (positive and unlabelled and len(words) and 0 < prior < 1):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)

    def rows(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(group)), [len(g) for g in group]), np.concatenate(group)

    (pd_, pw), (ud, uw) = rows(positive), rows(unlabelled)
    w = np.zeros(len(words) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)

    def back(doc: np.ndarray, word: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(word, weights=g[doc], minlength=len(words)), g.sum())

    for step in range(1, EPOCHS + 1):
        zp = np.bincount(pd_, weights=w[pw], minlength=len(positive)) + w[-1]
        zu = np.bincount(ud, weights=w[uw], minlength=len(unlabelled)) + w[-1]
        negative = soft(zu).mean() - prior * soft(zp).mean()
        low = back(ud, uw, sig(zu) / len(zu)) - prior * back(pd_, pw, sig(zp) / len(zp))
        high = prior * back(pd_, pw, -sig(-zp) / len(zp))
        grad = high + low if negative >= 0 else -low
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(words, w[:-1], float(w[-1]))


def _telling(bad: Column, any_: Column, toxic: int, unlabelled: int, prior: float) -> Column:
    """Whether a word in ``bad`` of the toxic and ``any_`` of the unlabelled texts tells toxic texts from others."""
    if not (toxic and unlabelled and 0 < prior < 1):
        return F.lit(False)
    others = (1 - prior) * unlabelled  # expected number of texts that are not toxic
    share = bad / F.lit(float(toxic))
    usual = (F.greatest(any_ - prior * unlabelled * share, F.lit(0.0)) + 0.5) / (others + 1)
    absent = F.when(bad < toxic, (1 - share) * F.ln((1 - share) / (1 - usual))).otherwise(0.0)
    present = F.when(bad > 0, share * F.ln(share / usual)).otherwise(0.0)
    return (share >= LEAST_LIFT * usual) & (toxic * (present + absent) >= LEAST_EVIDENCE)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on ``labels`` (doc_id, toxic) and on any rows of ``docs``; pass only rows that may be learned from."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null")
    prior = lab.agg(F.avg("toxic")).first()[0] or 0.0
    ids = hashed_sample(lab.where("toxic = 1"), POSITIVES).withColumn("toxic", F.lit(1)).unionByName(
        hashed_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id")), UNLABELLED).withColumn("toxic", F.lit(0))
    )
    texts = cut(with_texts(docs, ids).mapInPandas(_features, "toxic int, words array<long>"))
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    seen = texts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("any"))
    telling = _telling(F.col("bad"), F.col("any"), size.get(1, 0), size.get(0, 0), float(prior))
    words = np.array([r["word"] for r in seen.where(telling).select("word").collect()], dtype=np.int64)
    words = np.sort(words.view(np.uint64))
    got = texts.select("toxic", _known(words)(F.col("words")).alias("at")).collect()
    group = lambda y: [np.array(r["at"], dtype=np.int64) for r in got if r["toxic"] == y]
    return fit(group(1), group(0), words, float(prior))


def _known(words: np.ndarray):
    """Indices of the features among the word hashes of each text."""

    @F.pandas_udf("array<int>")
    def apply(column: pd.Series) -> pd.Series:
        out = []
        for w in column:
            h = np.asarray(w, dtype=np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
            out.append(at[words[at] == h].astype(np.int32) if len(words) else at[:0].astype(np.int32))
        return pd.Series(out)

    return apply


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic."""

    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for at, parts in slices(texts, lower=True):
            out[at : at + len(parts)] = 1 / (1 + np.exp(-np.clip(model.logits(parts), -40, 40)))
        release()
        return pd.Series(out)

    return apply(text)
