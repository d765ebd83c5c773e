import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnloom.llm import id_coder, pieces, token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from("ab ,.'\n\t▁é日　\xa0\r0<|>sS!") | st.characters(exclude_categories=("Cs",)), max_size=40)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_pieces_like_the_library(text):
    seg = pieces.segmenter(PIECES)
    assert seg.by_chunk
    ids = seg.encode(text)
    assert ids.tolist() == seg.sp.encode(text)
    assert seg.decode(ids) == seg.sp.decode(seg.sp.encode(text))


def test_whole_texts_where_chunks_may_not_be_cut():
    seg = pieces.Segmenter(PIECES)
    seg.by_chunk = False
    assert seg.encode(" a b  c").tolist() == seg.sp.encode(" a b  c")


def test_piece_column(spark, docs, edge, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for d in (docs, edge):
        for r in d.select("text", pieces.encode_decode(F.col("text"), PIECES).alias("q")).collect():
            want = sp.encode(r["text"] or "")
            assert r["q"]["ids"] == want and r["q"]["decoded"] == sp.decode(want)
    assert none.select(pieces.encode_decode(F.col("text"), PIECES).alias("q")).count() == 0


@given(st.lists(TEXT | st.sampled_from(["<|endoftext|>x <|endoftext|> y", "it's we'll  I'm", " lead", "trail ", "a\n b", "  "]), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_like_the_library(texts):
    lib = Tokenizer.from_file(BYTES)
    got = token_files.tokenizer(BYTES).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=600))
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(ids):
    coded = id_coder.encode_block(np.array(ids, dtype=int), 16)
    assert id_coder.decode_block(coded, len(ids), 16).tolist() == ids
    assert id_coder.encode_block(np.array(ids, dtype=int), 16) == coded  # no block depends on an earlier one


def test_coder_limits():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 1 << 20, 3000), np.full(2500, (1 << 20) - 1), np.zeros(70_000, int)):
        coded = id_coder.encode_block(ids, 20)
        assert (id_coder.decode_block(coded, len(ids), 20) == ids).all()
    assert len(coded) < 11 * id_coder._shape(70_000)[0]  # what repeats costs little beyond the first id, a count and a last word per lane
    cycle = np.tile(rng.permutation(50_000)[:3000], 100)  # sure guesses that fail once in a while
    cycle[rng.integers(0, len(cycle), 500)] = 7
    coded = id_coder.encode_block(cycle, 16)
    assert (id_coder.decode_block(coded, len(cycle), 16) == cycle).all()
    assert len(coded) * 8 < 4 * len(cycle)
    for bad in (np.array([70000]), np.array([-1]), np.zeros(id_coder.BLOCK + 1, int)):
        with pytest.raises(ValueError):
            id_coder.encode_block(bad, 16)


def test_lanes_cover_the_block():
    for n in [*range(1, 1500), id_coder.BLOCK - 1, id_coder.BLOCK]:
        lanes, steps = id_coder._shape(n)
        assert (lanes - 1) * steps < n <= lanes * steps and lanes <= id_coder.LANES


def test_coder_is_smaller_than_order_zero():
    """Ids of real texts take less than their frequencies alone allow, and less than a general compressor needs."""
    got = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    ids = np.frombuffer(b"".join(token_files.tokenizer(BYTES).encode([t or "" for t in got])), "<u4").astype(int)[: id_coder.BLOCK]
    coded = id_coder.encode_block(ids, 16)
    assert (id_coder.decode_block(coded, len(ids), 16) == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    bits = 8 * len(coded) / len(ids)
    assert bits < 7.8 < -(share * np.log2(share)).sum()
    assert len(coded) < len(zlib.compress(ids.astype("<u2").tobytes(), 6))


def test_packed_slots_move_like_single_ones():
    """Tables of moves against the rules of the two slots of order 1 and the one of order 2, for all confidences and outcomes."""
    for s1 in range(8):
        for s3 in range(8):
            for hit in (0, 1, 2):  # neither, the first, the other one
                one, other, new = 5 << 3 | s1, 9 << 3 | s3, 11 << 3 | 1
                k = s1 | s3 << 3 | (hit == 1) << 6 | (hit == 2) << 7
                if hit == 1:
                    a, b = 5 << 3 | min(s1 + 1, 7), other
                elif hit == 2:
                    a, b = 5 << 3 | max(s1 - 1, 0), 9 << 3 | min(s3 + 1, 7)
                else:
                    a, b = one, other - 1 if s3 else new
                now = (other << 32 | one) + int(id_coder._ADD[k])
                if id_coder._PUT[k]:
                    now = now & 0xFFFFFFFF | new << 32
                assert (now & 0xFFFFFFFF, now >> 32) == (a, b) and id_coder._SWAP[k] == ((b & 7) > (a & 7))
        assert id_coder._ADD2[s1 + 8] == min(s1 + 1, 7) - s1 and id_coder._ADD2[s1] == s1 // 2 - s1


def test_full_block_of_wide_lanes():
    """A whole block, whose steps are no more than those of half as many ids before."""
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.3, id_coder.BLOCK), 50_255)
    lanes, steps = id_coder._shape(len(ids))
    assert steps <= 256 and lanes * steps == len(ids) == 1 << 21
    coded = id_coder.encode_block(ids, 16)
    assert (id_coder.decode_block(coded, len(ids), 16) == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert 8 * len(coded) / len(ids) < 1.1 * -(share * np.log2(share)).sum() + 0.3


def test_word_table_keeps_frequent_words(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE", 20)
    tok, lib = token_files.Tokenizer(BYTES), Tokenizer.from_file(BYTES)
    for k in range(8):
        texts = [f"the common word {' '.join(f'rare{k}x{j}' for j in range(12))} common", "x  y"]
        assert [np.frombuffer(g, "<u4").tolist() for g in tok.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tok.words) + len(tok.before) < 60 and "common" in tok.words


def test_pieces_go_to_the_model_once(monkeypatch):
    """Words that differ by their marks only cost one call of the library; results stay those of whole texts."""
    tok, lib = token_files.Tokenizer(BYTES), Tokenizer.from_file(BYTES)
    asked = []

    class Model:
        def tokenize(self, seen, model=tok.model):
            asked.append(seen)
            return model.tokenize(seen)

    tok.model = Model()
    texts = ["x erndeaha erndeaha. erndeaha, erndeaha\nerndeaha", "x ètionré? ètionré!\n ètionré", "x <|endoftext|> erndeaha", "x 日本 erndeaha", "a  b"]
    for size in (1, 1 << 22):
        monkeypatch.setattr(token_files, "TEXT", size)
        got = [np.frombuffer(g, "<u4").tolist() for g in tok.encode(texts)]
        assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked))
    assert len([a for a in asked if "erndeaha" in a]) == 2  # after a blank and after a line feed


def test_classes_are_those_of_the_library():
    split = Tokenizer.from_file(BYTES).pre_tokenizer
    tok = token_files.tokenizer(BYTES)
    assert tok.by_piece
    for c in range(token_files.LOW):
        text = f"é{chr(c)}{chr(c)}7 {chr(c)}'{chr(c)}"
        whole, at = [], 0
        for _, (x, y) in split.pre_tokenize_str(text):
            whole.append(text[x:y])
            at = y
        assert at == len(text) and tok.cut(text) == whole, c


def expected(rows):
    lib, start, out = Tokenizer.from_file(BYTES), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files(spark, docs, edge, none, monkeypatch):
    for d in (docs.repartition(5), edge):
        manifest = token_files.write_ids(d, BYTES)
        got = token_files.read_ids(manifest).collect()
        want = expected([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
        assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got) == [(w[1], w[0], *w[2:]) for w in want]
    assert token_files.read_ids(token_files.write_ids(none, BYTES)).count() == 0


def test_documents_across_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 64)
    rng = np.random.default_rng(3)
    lots = [rng.integers(0, 50000, n).astype(np.uint32) for n in (1, 200, 3, 64, 0, 127, 1)]
    uri = f"file://{tmp_path}/x"
    out = token_files.Writer(uri, 16)
    for i, ids in enumerate(lots):
        out.add(i if i else None, ids)
    out.close()
    index, ids = zip(*token_files.read_file(uri), strict=True)
    assert sum(index, []) == [(i if i else None, len(x)) for i, x in enumerate(lots)]
    assert np.concatenate(ids).tolist() == np.concatenate(lots).tolist()
    data = bytearray((tmp_path / "x").read_bytes())
    data[-18] ^= 4
    (tmp_path / "y").write_bytes(data)
    with pytest.raises(OSError):
        list(token_files.read_file(f"file://{tmp_path}/y"))
    (tmp_path / "z").write_bytes(data[:-9])
    with pytest.raises(OSError):
        list(token_files.read_file(f"file://{tmp_path}/z"))
