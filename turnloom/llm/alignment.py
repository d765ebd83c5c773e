"""Alignment of two tokenizers' tokens by interval coalescing, with corpus-wide counts of linked ids.

Both vocabularies cover the bytes of blank + text without gaps.  All tokens of
both are sorted by start (lexsort) and the running maximum of their ends is
taken; a group breaks where a start reaches it, which is where tokens of both
end.  Within a group every A token is linked with every B token.

A text is cut before each single blank between two visible characters: both
vocabularies end a token there, so groups never cross a cut (where a vocabulary
does not promise that, a text is one chunk).  A worker keeps a table of distinct
chunks with their groups and links; it is emptied at ``TABLE`` chunks.

Documents are handled in blocks of about ``BLOCK_BYTES`` of text.  A block is a row
of a written table: what is known of its documents, their chunks, and the block's
distinct id pairs with the number of its documents that hold each.  Pairs are
summed over blocks, the highest count of each A id is taken (at most one row per
id of the vocabulary), and every block gets the counts of its own pairs back.  So
the rows that are shuffled are distinct pairs per block, never links.

Cases: a null or empty text, one whose tokens do not give back its bytes (such as
one with a literal U+2581), has no tokens: zeros and the empty string.  Repeated
rows are documents of their own and each counts.  An empty table gives no rows.
A document is never split, so a block holds at least one, whole.  Special tokens'
strings are plain text.  Other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import release
from turnloom.session import cut

TABLE = 200_000
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 19  # of text that is cut up at once
GROUP_ROWS = 1  # a block's row is about 7 MB; a reader holds a row group of each column
TASK_BLOCKS = 2  # blocks that a task gets its counts back for
SLICE = 1 << 16  # chunks whose (document, pair) rows are made distinct at once
MARK = "▁"
_TWO = re.compile(r"\s\s")
_ODD = re.compile(rf"[\s{MARK}]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The visible character of each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of the group of each interval, counted from 0 in order of start."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.concatenate(([False], start[order][1:] >= reach[:-1]))
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def all_pairs(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of all pairs of one group; both arrays are sorted and hold the same groups."""
    first, count = np.unique(group_b, return_index=True, return_counts=True)[1:]
    a_groups = np.searchsorted(np.unique(group_b), group_a)
    times = count[a_groups]
    a = np.repeat(np.arange(len(group_a)), times)
    within = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
    return a, first[a_groups][a] + within


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all items of the lists that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    s = np.sort(x)
    return s[np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1]))]


class Aligner:
    """Two vocabularies with a table of distinct chunks."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in alphabet for c in t)}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.size_b = len(names)
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.len_a = np.zeros(max(self.bytes_a, default=0) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.len_a[i] = len(x)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.feed_a, self.feed_b = self.a.encode("\n", add_special_tokens=False).ids, self.b.encode("x\n")[-1:]
        # what an id adds to the text of its group: not its last of that kind, or its last
        self.shown = [b"%d%c" % (i, c) for i in range(len(self.len_a)) for c in b",|"] + [b"%d%c" % (i, c) for i in range(self.size_b) for c in b",;"]
        with open(path_a, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        probe = " ﬁ①Ａ  a\n "
        self.by_chunk = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and self.b.normalize(probe) == MARK + probe.replace(" ", MARK) and not any(re.search(f"[^{MARK}]{MARK}", n) for n in names))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[bytes | None] = []  # groups of each chunk, each ended by a semicolon; None where bytes differ
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first = (array("q") for _ in range(5))
        self.links = array("q")  # a * size_b + b

    def chunks(self, text: str) -> list[str]:
        """Chunks of blank + text, each without its first blank."""
        if not self.by_chunk:
            return [text]
        if _TWO.search(text) or text[0].isspace() or text[-1].isspace():
            return _CUT.split(text)
        return text.split(" ")

    def _ids(self, chunks: list[str], plain: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each chunk, and how many, by both vocabularies.

        Plain chunks are asked for all at once, each ended by a line feed, which
        neither vocabulary joins with anything here.
        """
        if plain and chunks:
            text = "\n ".join(chunks) + "\n"
            flat = [np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64), np.array(self.b.encode(text), np.int64)]
            ends = [np.flatnonzero(f == feed[0]) for f, feed in zip(flat, (self.feed_a, self.feed_b), strict=True)]
            if len(self.feed_a) == 1 and len(ends[0]) == len(ends[1]) == len(chunks):
                return [np.delete(f, e) for f, e in zip(flat, ends, strict=True)], [np.diff(e, prepend=-1) - 1 for e in ends]
        both = ([e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)], self.b.encode(chunks, num_threads=1))
        return [np.array([i for x in k for i in x], np.int64) for k in both], [np.array([len(x) for x in k], np.int64) for k in both]

    def _good(self, chunks: list[str], ids: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Whether the tokens of each chunk give its bytes back, in both vocabularies."""
        want = [(" " + c).encode("utf-8", "surrogatepass") for c in chunks]
        whole, ok = b"".join(want), np.ones(len(chunks), bool)
        for f, n, know, size in zip(ids, counts, (self.bytes_a, self.bytes_b), (self.len_a, self.len_b), strict=True):
            upto = np.concatenate(([0], np.cumsum(n)))
            length = np.diff(np.concatenate(([0], np.cumsum(size[f])))[upto])
            if (size[f] > 0).all() and (length == [len(w) for w in want]).all() and b"".join([know[i] for i in f.tolist()]) == whole:
                continue
            for k, w in enumerate(want):
                own = f[upto[k] : upto[k + 1]].tolist()
                ok[k] &= all(size[own] > 0) and b"".join([know[i] for i in own]) == w if own else False
        return ok

    def learn(self, new: list[str], plain: bool = False) -> None:
        ids, counts = self._ids(new, plain)
        good = self._good(new, ids, counts)
        if not good.all():
            ids = [f[np.repeat(good, n)] for f, n in zip(ids, counts, strict=True)]
            counts = [n * good for n in counts]
        (a, b), (of_a, of_b) = ids, counts
        size_a, size_b = self.len_a[a], self.len_b[b]
        end = np.concatenate((np.cumsum(size_a), np.cumsum(size_b)))
        group = coalesce(end - np.concatenate((size_a, size_b)), end)
        group_a, group_b = group[: len(a)], group[len(a) :]
        link_a, link_b = all_pairs(group_a, group_b)
        # a chunk begins a group, so its groups and links follow from its tokens
        chunk_a = np.repeat(np.arange(len(new)), of_a)
        groups = np.bincount(chunk_a[np.diff(group_a, prepend=-1) > 0], minlength=len(new)) if len(a) else np.zeros(len(new), np.int64)
        links = np.bincount(chunk_a[link_a], minlength=len(new)) if len(a) else np.zeros(len(new), np.int64)
        kind = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(group)), kind, group))
        run = (group * 2 + kind)[order]
        last = np.diff(run, append=-1) != 0
        code = np.concatenate((a, b + len(self.len_a)))[order] * 2 + last
        shown = self.shown
        texts = [shown[c] for c in code.tolist()]
        upto = np.concatenate(([0], np.cumsum(of_a + of_b))).tolist()
        base, at = len(self.links), len(self.text)
        self.at.update(zip(new, range(at, at + len(new)), strict=True))
        self.text += [b"".join(texts[x:y]) if y > x else None for x, y in zip(upto[:-1], upto[1:], strict=True)]
        self.first.frombytes((base + np.cumsum(links) - links).astype(np.int64).tobytes())
        self.links.frombytes((a[link_a] * self.size_b + b[link_b]).astype(np.int64).tobytes())
        for column, n in ((self.n_a, of_a), (self.n_b, of_b), (self.n_groups, groups), (self.n_links, links)):
            column.frombytes(n.astype(np.int64).tobytes())

    def _learn_all(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self.at]
        plain = [c for c in new if c and not _ODD.search(c)]
        some = set(plain)
        other = [c for c in new if c not in some]
        for part, is_plain in ((plain, True), (other, False)):
            for i in range(0, len(part), 2048):
                self.learn(part[i : i + 2048], is_plain)

    def block(self, texts: list[str]) -> dict:
        """What a block's row holds besides the ids of its documents."""
        at, docs, shas, a = self.at, [], [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and size < SLICE_BYTES:
                size += len(texts[b])
                b += 1
            cut_up = [self.chunks(t) if t else [] for t in texts[a:b]]
            self._learn_all([c for chunks in cut_up for c in chunks])
            for chunks in cut_up:
                own = [at[c] for c in chunks]
                parts = [self.text[i] for i in own]
                if not own or None in parts:
                    own = []
                docs.append(np.array(own, np.int64))
                shas.append(hashlib.sha256(b"".join(parts)[:-1]).hexdigest() if own else "")
            a = b
        ends = np.cumsum([len(d) for d in docs])
        flat = np.concatenate([np.zeros(0, np.int64), *docs])
        seen = np.zeros(len(self.text), bool)
        seen[flat] = True
        used, flat = np.flatnonzero(seen), (np.cumsum(seen) - 1)[flat]
        col = lambda x: np.frombuffer(x, np.int64)[used] if len(used) else np.zeros(0, np.int64)
        sizes = col(self.n_links)
        links = np.frombuffer(self.links, np.int64)[ragged(col(self.first), sizes)] if len(used) else np.zeros(0, np.int64)
        pairs, place = np.unique(links, return_inverse=True)
        heads = np.cumsum(sizes) - sizes
        held = np.zeros(len(pairs), np.int64)
        doc, a = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), 0
        while a < len(flat):  # whole documents, so that a pair is counted once in each
            b = int(ends[np.searchsorted(ends, min(a + SLICE, len(flat)), "left")])
            once = distinct(doc[a:b] * len(used) + flat[a:b])
            chunk, owner = once % len(used), once // len(used)
            pair = place[ragged(heads[chunk], sizes[chunk])]
            held += np.bincount(distinct(np.repeat(owner, sizes[chunk]) * len(pairs) + pair) % len(pairs), minlength=len(pairs))
            a = b
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(col(x)[flat])))[np.concatenate(([0], ends)).astype(int)])
        out = {"n_a": total(self.n_a), "n_b": total(self.n_b), "n_groups": total(self.n_groups), "n_links": total(self.n_links), "sha": shas,
               "upto": ends, "chunks": flat.astype(np.int32), "links_of": sizes.astype(np.int32), "places": place.astype(np.int32),
               "pairs": pairs, "held": held}
        if len(self.text) > TABLE:
            self.clear()
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


_BLOCK = ("block long, doc_id array<long>, known array<boolean>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "sha array<string>, upto array<long>, chunks array<int>, links_of array<int>, places array<int>, pairs array<long>, held array<long>")
_DOCS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def block_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The written table of blocks; ``pairs`` are ids a * (size of B) + b."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, number, ids, texts, size = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, [], [], 0

        def made() -> pd.DataFrame:
            row = {"block": number, "doc_id": [i or 0 for i in ids], "known": [i is not None for i in ids], **tool.block(texts)}
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for pdf in batches:
            for i, known, text in zip(pdf["doc_id"].tolist(), pdf["known"].tolist(), pdf["text"].tolist(), strict=True):
                ids.append(int(i) if known else None)
                texts.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield made()
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield made()
        tool.clear()
        release()

    src = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cut(src.mapInPandas(run, _BLOCK), GROUP_ROWS)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it) and best: whether n is the highest of its A id."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.held").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {size_b}"))
    counts = cut(counts)
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))  # one row per id of A at most


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    size_b = aligner(path_a, path_b).size_b
    blocks = block_table(docs, path_a, path_b)
    # dealt by number of blocks: a partition leaves the JVM as one batch, whatever the number of shuffle partitions
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-blocks.select("block").count() // TASK_BLOCKS))
    wanted = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = wanted.join(pair_counts(blocks, size_b), "pair")
    found = found.select("block", "place", (F.col("n") * 2 + F.col("best").cast("long")).alias("value")).repartition(tasks, "block")
    looked = found.groupBy("block").agg(F.collect_list(F.struct("place", "value")).alias("v"))  # one block's distinct pairs
    looked = looked.select("block", F.col("v.place").alias("at"), F.col("v.value").alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                value = np.zeros(0, np.int64)
                if r.at is not None and len(r.at):
                    value = np.empty(len(r.at), np.int64)
                    value[np.asarray(r.at)] = r.value
                of = np.asarray(r.links_of, dtype=np.int64)
                owner = np.repeat(np.arange(len(of)), of)
                got = value[np.asarray(r.places, dtype=np.int64)]
                edge = np.concatenate(([0], np.asarray(r.upto, dtype=np.int64)))
                out = {}
                for name, x in (("n_best", got & 1), ("count_sum", got >> 1)):
                    per_chunk = np.zeros(len(of), np.int64)
                    np.add.at(per_chunk, owner, x)
                    upto = np.concatenate(([0], np.cumsum(per_chunk[np.asarray(r.chunks, dtype=np.int64)])))
                    out[name] = np.diff(upto[edge])
                ids = pd.array([int(i) if k else None for i, k in zip(r.doc_id, r.known, strict=True)], dtype="Int64")
                yield pd.DataFrame({"doc_id": ids, "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links,
                                    "n_best": out["n_best"], "count_sum": out["count_sum"], "groups_sha256": r.sha})
        release()

    full = blocks.drop("pairs", "held").repartition(tasks, "block").join(looked, "block", "left").drop("block")
    return full.mapInPandas(run, _DOCS)
