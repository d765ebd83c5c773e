"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams (1 to 3 letters, words
padded with a blank) of a language, counted over all its training texts.  A
text's own list is held against each profile: the out-of-place distance adds,
per n-gram of the text, the difference of the two ranks, or the list length
where the profile lacks it.  The nearest language wins; ties go to the smaller
name.  Ranks order by count, then by the n-gram's code points.

Cases: a null text or one without a letter is ``und`` with score 0, as is every
text if nothing could be learned.  Null languages teach nothing.  Whole texts
are used, whatever their length; equal texts get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import release

TOP = 300
REJECT = 0.002  # of ``loosest_scores``
UNKNOWN = "und"
_BITS = 21
_letters = np.zeros(0x110000, dtype=np.int8)  # 0 not looked up yet, 1 letter, 2 other


def _codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; empty without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letters[cp]
    if (kind == 0).any():
        for c in np.unique(cp[kind == 0]):
            _letters[c] = 1 if chr(c).isalpha() else 2
        kind = _letters[cp]
    if not (kind == 1).any():
        return np.zeros(0, dtype=np.int64)
    c = np.concatenate(([32], np.where(kind == 1, cp, 32), [32])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]  # one blank between words
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    return np.concatenate((c[c != 32], two, three[c[1:-1] != 32]))


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(codes)
    at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    return s[at], np.diff(np.concatenate((at, [len(s)])))


def _top(codes: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in rank order."""
    value, n = _count(codes)
    if len(value) > 4 * top:  # the rest cannot reach the list
        keep = n >= np.partition(n, len(n) - top)[len(n) - top]
        value, n = value[keep], n[keep]
    return value[np.lexsort((value, -n))[:top]]


def _partial_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            parts: list[np.ndarray] = []
            held, size = [], 0
            for t in texts:
                held.append(_codes(t))
                size += len(held[-1])
                if size > 2_000_000:
                    parts.append(np.concatenate(held))
                    held, size = [], 0
                    v, n = _count(parts.pop())
                    yield pd.DataFrame({"lang": lang, "code": v, "n": n})
            if size:
                v, n = _count(np.concatenate(held))
                yield pd.DataFrame({"lang": lang, "code": v, "n": n})
        release()


def learn_profiles(docs: DataFrame, top: int = TOP) -> list[tuple[str, list[int]]]:
    """(language, n-gram codes in rank order) from columns ``text`` and ``lang``.

    Counts cover all rows; only ``top`` codes per language reach the driver.
    """
    src = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = src.where("text is not null and lang is not null").mapInPandas(_partial_counts, "lang string, code long, n long")
    n = n.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    got: dict[str, list[int]] = {}
    for r in n.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").collect():
        got.setdefault(r["lang"], []).append(r["code"])
    return sorted(got.items())


def loosest_scores(scored: DataFrame) -> dict[str, float]:
    """Per predicted language the score that all but a share ``REJECT`` of the different texts that name a language reach.

    From columns ``text_hash``, ``lang``, ``lang_pred`` and ``score`` of all
    rows; only one row per language reaches the driver.
    """
    named = scored.where(F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN))
    each = named.groupBy("text_hash").agg(F.first("lang_pred").alias("lang_pred"), F.first("score").alias("score"))  # equal for equal texts
    low = each.groupBy("lang_pred").agg(F.percentile_approx("score", REJECT, 10_000).alias("low"))
    return {r["lang_pred"]: r["low"] for r in low.collect()}


def predict(profiles: list[tuple[str, list[int]]], text: Column, top: int = TOP) -> Column:
    """Struct (lang_pred, score): score is 1 less the distance as a share of the largest possible one."""
    names = [p[0] for p in profiles]
    known = np.unique(np.array([c for _, p in profiles for c in p], dtype=np.int64))
    rank = np.full((len(names), len(known) + 1), -1, dtype=np.int64)  # the last column: in no profile
    for i, (_, p) in enumerate(profiles):
        rank[i, np.searchsorted(known, np.array(p, dtype=np.int64))] = np.arange(len(p))

    def one(t: str | None) -> tuple[str, float]:
        own = _codes(t) if isinstance(t, str) else known[:0]
        if not len(own) or not names:
            return UNKNOWN, 0.0
        own = _top(own, top)
        at = np.searchsorted(known, own)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == own[at < len(known)], at[at < len(known)], len(known))
        r = rank[:, at]
        d = np.where(r < 0, top, np.abs(r - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(d))
        return names[best], 1.0 - float(d[best]) / (top * len(own))

    @F.pandas_udf("lang_pred string, score double")
    def apply(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])
        release()
        return out

    return apply(text)
