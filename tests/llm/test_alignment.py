import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from turnloom.llm import alignment
from turnloom.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B)
ALPHABET = alignment.byte_alphabet()
TEXT = st.text(st.sampled_from("ab ,.'\n\t▁é日　\xa0\r0<|>sS!") | st.characters(exclude_categories=("Cs",)), max_size=40)
ODD = ["<|endoftext|> x <|endoftext|>", "x\n \ny", "a  b", " lead", "trail ", "x\n ", "it's  we'll", "日本 語", "\x00 \x1c \x85 end", " ", "▁", "a ▁b"]


def groups_of(text):
    """Groups of one text, token by token."""
    if not text:
        return []
    a, b = LIB_A.encode(" " + text, add_special_tokens=False).ids, LIB_B.encode(text)
    bytes_a = [bytes(ALPHABET[c] for c in LIB_A.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    out, now, at_a, at_b = [], ([], []), 0, 0
    a, b = list(zip(a, bytes_a, strict=True)), list(zip(b, bytes_b, strict=True))
    while a or b:
        if at_a <= at_b:
            i, x = a.pop(0)
            at_a += len(x)
            now[0].append(i)
        else:
            i, x = b.pop(0)
            at_b += len(x)
            now[1].append(i)
        if at_a == at_b:
            out.append(now)
            now = ([], [])
    return out


def expected(rows):
    found = [(d, groups_of(t)) for d, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for _, g in found]
    held = Counter(p for ls in links for p in set(ls))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    for (d, g), ls in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls), sum(held[p] == top[p[0]] for p in ls), sum(held[p] for p in ls),
               hashlib.sha256(text.encode()).hexdigest() if g else "")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@given(TEXT | st.sampled_from(ODD))
@settings(max_examples=400, deadline=None)
def test_chunks_make_no_difference(text):
    tool = alignment.aligner(A, B)
    assert tool.by_chunk
    got = tool.block([text])
    want = groups_of(text)
    assert got["n_groups"].tolist() == [len(want)]
    assert got["n_a"].tolist() == [sum(len(a) for a, _ in want)] and got["n_links"].tolist() == [sum(len(a) * len(b) for a, b in want)]
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
    assert got["sha"] == [hashlib.sha256(text.encode()).hexdigest() if want else ""]


def test_coalesce_breaks_where_all_end():
    start, end = np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 7, 2, 5, 7])
    assert alignment.coalesce(start, end).tolist() == [0, 0, 1, 0, 0, 1]
    a, b = alignment.all_pairs(np.array([0, 0, 1]), np.array([0, 1, 1]))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_alignment"](spark, sf)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == sorted(expected(rows), key=repr)


def test_small_blocks_and_edges(spark, edge, none, monkeypatch):
    """Blocks of a few documents, an emptied table and slices do not show in the result."""
    want = sorted(expected([(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]), key=repr)
    assert rows_of(alignment.align(edge, A, B)) == want
    assert alignment.align(none, A, B).collect() == []
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string").repartition(3)
    assert rows_of(alignment.align(odd, A, B)) == sorted(expected(list(enumerate(ODD * 2))), key=repr)
    tool = alignment.Aligner(A, B)
    whole = tool.block(ODD)
    monkeypatch.setattr(alignment, "SLICE", 2)
    monkeypatch.setattr(alignment, "TABLE", 3)
    again = tool.block(ODD)
    assert len(tool.text) == 0
    for k in ("n_a", "n_links", "held"):
        assert whole[k].tolist() == again[k].tolist()


def test_large_rows_are_held_one_at_a_time(spark, monkeypatch):
    """Writers and readers hold a row group, and a task of the last step few blocks, whatever the number of shuffle partitions."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(alignment, "BLOCK_BYTES", 40)
    rows = [(i, f"some words of text number {i} again") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in alignment.block_table(docs, A, B).inputFiles()]
    sizes = [f.metadata.row_group(g).num_rows for f in files for g in range(f.num_row_groups)]
    assert sum(sizes) > 10 and max(sizes) == 1
    got = alignment.align(docs, A, B)
    assert got.rdd.getNumPartitions() >= sum(sizes) // alignment.TASK_BLOCKS > 4
    assert rows_of(got) == sorted(expected(rows), key=repr)
