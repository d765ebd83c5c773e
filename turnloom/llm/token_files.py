"""Token-id files: tokenise texts, write their ids in order, read them back.

File: ``TLID3`` and the number of bits of an id, then blocks of up to ``BLOCK``
ids coded by ``id_coder``.  Before a block stand its number of ids, its length in
bytes, the crc32 of its ids and the documents that end in it: an index (doc_id,
number of ids).  A reader checks every block, and each block can be decoded on
its own.

Documents are dealt to files by ranges of doc_id and sorted within, so files in
order give all documents in ascending doc_id order (null ids first, rows of one
id ordered by text).  A document may run over any number of blocks;
no more than a block of ids is held besides the document at hand.  Every attempt
of a task writes a file of its own; only those named in the manifest, a table
written by the tasks that ended well, are read.

Cases: a null text counts as empty and has only the end id.  An empty table
gives no file and no rows.  Other columns of the input are not touched.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.alignment import byte_alphabet
from turnloom.llm.files import attempt_name, create, new_folder, open_read
from turnloom.llm.id_coder import BLOCK, decode_block, encode_block
from turnloom.session import cut

MAGIC = b"TLID3"
TABLE = 400_000
LOW = 0x2100  # code points whose classes are asked for
TEXT = 6_000_000  # characters that are looked up at once
_MARKS = ".,;:!?"
_HIGH = re.compile(f"[^\0-{chr(LOW - 1)}]")


def _pieces(split) -> re.Pattern:
    """The byte-level pattern for code points below ``LOW``, with the classes that ``split``, the library's own, gives them."""
    begins = np.zeros(6 * LOW, bool)
    begins[[at for _, (at, _) in split.pre_tokenize_str("".join(f"a{chr(c)}{chr(c)}1a\n" for c in range(LOW)))]] = True
    one, two, three = begins.reshape(-1, 6)[:, 1:4].T

    def members(some: np.ndarray) -> str:
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], some, [0]))))
        return "".join(f"\\u{x:04x}-\\u{y - 1:04x}" for x, y in cuts.reshape(-1, 2).tolist())

    letter, number, space = members(~one), members(one & ~two & ~three), members(two)
    return re.compile(
        f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class _Table(dict):
    """Values of keys, made when first asked for.  The table before still answers, and what it answers moves on."""

    def __init__(self, make: Callable[[str], bytes], part: int = 1):
        self.make, self.part, self.before = make, part, {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        self[key] = got = self.make(key) if got is None else got
        return got

    def turn(self) -> None:
        if len(self) > TABLE // self.part:
            self.before = dict(self)
            self.clear()


class Tokenizer:
    """A byte-level vocabulary with a table of distinct words.

    Its pattern always ends a token before a single blank that a visible
    character follows, so words between single blanks are tokenised once each
    and looked up after that.  A new word is cut into the pieces of the pattern,
    and only pieces that are new as well go to the library's model.  Texts
    with an added token or a code point from ``LOW`` on, and all texts of another
    kind of vocabulary, go to the library whole.  Beyond
    ``TABLE`` words a new table is begun; the one before still answers, and what
    it answers moves on, so frequent words stay and rare ones go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.lib = Library.from_file(path)
        form = json.loads(self.lib.to_str())
        split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_piece = (
            form["model"]["type"] == "BPE" and not form["model"]["dropout"]
            and not any(form[k] for k in ("normalizer", "truncation", "padding"))
            and split.items() <= (form["pre_tokenizer"] or {}).items()
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in form["added_tokens"]))
        self.added = [t["content"] for t in form["added_tokens"]]
        self.blank = next(c for c, b in byte_alphabet().items() if b == 32)
        self.visible = {b: c for c, b in byte_alphabet().items()}
        self.model = self.lib.model
        self.model._resize_cache(0)  # what repeats is in the tables
        self.cut = _pieces(self.lib.pre_tokenizer).findall if self.by_piece else None
        self.words = _Table(self._word)  # one piece after a blank
        self.mixed = _Table(None, 4)  # more than one
        self.inner = _Table(self._piece)  # pieces of words after their first, and of beginnings

    @property
    def before(self) -> dict[str, bytes]:
        return self.words.before

    def _piece(self, piece: str) -> bytes:
        seen = piece.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.model.tokenize(self.blank + word)]).tobytes()
        return self._piece(" " + word)

    def _new(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            got = self.words.before.get(word)
            if got is None:
                got = array("I", [t.id for t in self.model.tokenize(self.blank + word)]).tobytes()
            self.words[word] = got
            return got
        head = word.rstrip(_MARKS)
        if head.isascii() and head.isalpha():  # the marks after it are one piece
            return self.words[head] + self.inner[word[len(head) :]]
        got = self.mixed.get(word)
        if got is not None:
            return got
        got = self.mixed.before.get(word)
        if got is None:
            first, *rest = self.cut(" " + word)
            if not rest:
                return self.words[word]
            got = self.words[first[1:]] + b"".join(map(self.inner.__getitem__, rest))
        self.mixed[word] = got
        return got

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts without two blanks in a row: each distinct word is looked up once."""
        cut_up = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = cut_up.values.dictionary_encode()
        begin = cut_up.offsets.to_numpy()
        distinct = words.dictionary.to_numpy(zero_copy_only=False)
        value = list(map(self.words.get, distinct))
        for k in [k for k, v in enumerate(value) if v is None]:
            value[k] = self._new(distinct[k])
        which = words.indices.to_numpy().copy()
        which[begin[:-1]] = np.arange(len(value), len(value) + len(texts))
        value += [b"".join(map(self.inner.__getitem__, self.cut(t.split(" ", 1)[0]))) for t in texts]
        size = np.fromiter(map(len, value), np.int64, len(value)) >> 2
        pool, n = np.frombuffer(b"".join(value), "<u4"), size[which]
        end = np.concatenate(([0], np.cumsum(n)))
        ids = pool[np.repeat((np.cumsum(size) - size)[which] - end[:-1], n) + np.arange(end[-1])]
        ends = end[begin].tolist()
        return (ids[a:b].tobytes() for a, b in zip(ends, ends[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        held = 0

        def flush() -> None:
            for k, ids in zip(plain, self._some([texts[k] for k in plain]) if plain else (), strict=True):
                out[k] = ids
            plain.clear()

        for table in (self.words, self.mixed, self.inner):
            table.turn()
        for k, t in enumerate(texts):
            if not self.by_piece or any(x in t for x in self.added) or not t.isascii() and _HIGH.search(t):
                out[k] = array("I", self.lib.encode(t, add_special_tokens=False).ids).tobytes()
            elif "  " in t:
                out[k] = b"".join(map(self.inner.__getitem__, self.cut(t)))
            else:
                plain.append(k)
                held += len(t)
                if held >= TEXT:
                    flush()
                    held = 0
        flush()
        return out

    def bits(self) -> int:
        return (self.lib.get_vocab_size() - 1).bit_length()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Writer:
    def __init__(self, uri: str, bits: int):
        self.out, self.bits = create(uri), bits
        self.out.write(MAGIC + struct.pack("<B", bits))
        self.index: list[tuple[int, int, int]] = []
        self.parts: list[np.ndarray] = []
        self.held = self.docs = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for a in range(0, len(ids), BLOCK):
            self.parts.append(ids[a : a + BLOCK])
            self.held += len(self.parts[-1])
            while self.held >= BLOCK:
                self._block(BLOCK)
        self.index.append((doc_id is not None, doc_id or 0, len(ids)))
        self.docs += 1
        self.ids += len(ids)

    def _block(self, n: int) -> None:
        flat = np.concatenate([np.zeros(0, np.uint32), *self.parts])
        now, rest = flat[:n], flat[n:]
        coded = encode_block(now, self.bits)
        self.out.write(struct.pack("<IIII", len(self.index), n, len(coded), zlib.crc32(now.astype("<u4"))))
        self.out.write(b"".join(struct.pack("<?qQ", *d) for d in self.index))
        self.out.write(coded)
        self.index, self.parts, self.held = [], [rest] if len(rest) else [], len(rest)

    def close(self) -> None:
        if self.held or self.index:
            self._block(self.held)
        self.out.write(bytes(16))
        self.out.close()


def _exactly(src, n: int) -> bytes:
    got = src.read(n)
    if len(got) != n:
        raise OSError("the file ends too early")
    return bytes(got)


def read_file(uri: str) -> Iterator[tuple[list[tuple[int | None, int]], np.ndarray]]:
    """Per block: the documents that end in it (or before) and its ids."""
    with open_read(uri) as src:
        head = _exactly(src, len(MAGIC) + 1)
        if head[:-1] != MAGIC:
            raise OSError("not a token-id file")
        while True:
            docs, n, size, crc = struct.unpack("<IIII", _exactly(src, 16))
            if docs == n == 0:
                return
            index = [(d if known else None, k) for known, d, k in struct.iter_unpack("<?qQ", _exactly(src, 17 * docs))]
            ids = decode_block(_exactly(src, size), n, head[-1]).astype(np.int32)
            if zlib.crc32(ids.astype("<u4")) != crc:
                raise OSError("a block does not match its checksum")
            yield index, ids


def write_ids(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """Write all documents; the manifest: part, uri, docs, ids, start (ids in the files before)."""
    folder = new_folder(docs.sparkSession, "ids")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, out, uri = tokenizer(path), None, f"{folder}/{attempt_name()}"
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            for a in range(0, len(pdf), 2500):
                some = pdf.iloc[a : a + 2500]
                coded = tok.encode([t if isinstance(t, str) else "" for t in some["text"]])
                for d, known, ids in zip(some["doc_id"], some["known"], coded, strict=True):
                    out = out or Writer(uri, tok.bits())
                    out.add(int(d) if known else None, np.frombuffer(ids + end, dtype="<u4"))
        if out:
            out.close()
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "uri": [uri], "docs": [out.docs], "ids": [out.ids]})

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    src = src.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text")
    files = cut(src.mapInPandas(run, "part int, uri string, docs long, ids long"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids, from the files of a manifest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri, start in zip(pdf["uri"], pdf["start"], strict=True):
                waiting: list[np.ndarray] = []
                for index, ids in read_file(uri):
                    rows, at = [], 0
                    have = sum(map(len, waiting))
                    for doc_id, n in index:
                        take = n - have
                        own = np.concatenate([*waiting, ids[at : at + take]]) if waiting else ids[at : at + take]
                        at, have, waiting = at + take, 0, []
                        rows.append((doc_id, int(start), n, zlib.crc32(own.astype("<u4")), own if with_ids else None))
                        start += n
                    if at < len(ids):
                        waiting.append(ids[at:])
                    if rows:
                        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                        yield out.astype({"doc_id": "Int64"})

    n = max(1, manifest.count())
    files = manifest.select("uri", "start", "part").repartitionByRange(n, "part").select("uri", "start")
    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")
