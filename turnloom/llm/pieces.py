"""SentencePiece encoding and decoding through a table of distinct chunks.

When no piece of the vocabulary holds a whitespace marker after another
character, merges never cross from one marked word to the next: a text is cut
before each run of markers, every distinct chunk is segmented once by the
library and kept in a table, and the ids are joined back by position.  Decoding
is the library's own, on the whole id list.

The table belongs to a Python worker and is emptied at ``TABLE`` chunks, so
memory stays bounded whatever the vocabulary of the corpus.  Vocabularies for
which chunks may not be cut, or which normalise texts, get whole texts instead;
the ids are the same by either way.

Cases: null counts as the empty text, which has no ids.  Blanks and literal
markers in a text are the same to the library.  Whole texts, no sampling,
neither begin nor end ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.llm.common import release

TABLE = 200_000
MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")


def cut_chunks(text: str) -> list[str]:
    """Chunks of a text, each without its first marker: what the library has to be asked for.

    The empty string stands for a single marker at the end of the text.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [c[1:] for c in _CHUNK.findall(" " + text)]
    return text.split(" ")


class Segmenter:
    """One vocabulary with its table of distinct chunks."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        probe = " ﬁ①Ａ  a\n "
        plain = self.sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.by_chunk = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        self.table: dict[str, bytes] = {}  # ids as 32-bit integers

    def _add(self, new: Iterable[str]) -> None:
        ask = [c for c in new if c]
        for c, ids in zip(ask, self.sp.encode(ask, num_threads=1), strict=True):
            self.table[c] = np.array(ids, dtype=np.int32).tobytes()
        self.table[""] = np.array([self.sp.piece_to_id(MARK)], dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        if not self.by_chunk:
            return np.array(self.sp.encode(text), dtype=np.int32)
        chunks = cut_chunks(text)
        if len(self.table) > TABLE:
            self.table.clear()
        new = {c for c in chunks if c not in self.table}
        if new or "" not in self.table:
            self._add(new)
        return np.frombuffer(b"".join([self.table[c] for c in chunks]), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=4)
def segmenter(path: str) -> Segmenter:
    return Segmenter(path)


def encode_decode(text: Column, path: str) -> Column:
    """Struct (ids array<int>, decoded string) of a text column; ``path`` must exist on every executor."""

    @F.arrow_udf("ids array<int>, decoded string")
    def apply(texts: pa.Array) -> pa.Array:
        seg = segmenter(path)
        ids = [seg.encode(t.as_py() or "") for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
        out = pa.StructArray.from_arrays([lists, pa.array([seg.decode(i) for i in ids], type=pa.string())], names=["ids", "decoded"])
        del ids, flat, lists
        release()
        return out

    return apply(text)
