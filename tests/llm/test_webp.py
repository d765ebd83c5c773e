import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm import media, webp


def padded(b):
    return b + bytes(-len(b) % 64 if b else 64)


@given(st.binary(max_size=700) | st.lists(st.sampled_from([0, 65, 66, 255]), max_size=900).map(bytes) | st.tuples(st.binary(max_size=90), st.integers(1, 9000)).map(lambda x: x[0] + b"r" * x[1] + x[0]))
@settings(max_examples=150, deadline=None)
def test_stored_payloads_come_back(payload):
    payload = padded(payload)
    got = webp.decode(webp.encode(payload))
    assert b"".join(i[..., 1].tobytes() for i in got) == payload
    assert all((i[..., 3] == 255).all() and not i[..., [0, 2]].any() for i in got)


def test_long_payloads_are_several_files():
    payload = padded(bytes(np.random.default_rng(1).integers(0, 200, 2 * webp.PIECE + 5000, dtype=np.uint8)))
    got = webp.decode(webp.encode(payload))
    assert len(got) == 3 and b"".join(i[..., 1].tobytes() for i in got) == payload


# A small writer of whole streams: literals with flat codes, so that every feature of the format can be written by hand.


def head(out, width, height):
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(v, n)


FLAT = np.full(256, 8)


def flat_codes(out, cache_bits=0, distances=(0,)):
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    lengths = np.full(size, 9)
    lengths[: 512 - size] = 8  # which makes the code complete
    webp.write_code(out, lengths)
    for _ in range(3):
        webp.write_code(out, FLAT)
    d = np.zeros(40, np.int64)
    d[list(distances)] = 1 if len(distances) <= 2 else int(np.log2(len(distances)))
    webp.write_code(out, d)
    return webp.code_words(lengths), lengths, webp.code_words(FLAT), webp.code_words(d), d


def literal(out, codes, pixel):
    b, g, r, a = (int(x) for x in pixel)
    out.put(int(codes[0][g]), int(codes[1][g]))
    for v in (r, b, a):
        out.put(int(codes[2][v]), 8)


def sub_image(out, pixels):
    out.put(0, 1)
    codes = flat_codes(out)
    for p in pixels.reshape(-1, 4):
        literal(out, codes, p)


def main_image(out, pixels):
    out.put(0, 2)  # no cache, one code group
    codes = flat_codes(out)
    for p in pixels.reshape(-1, 4):
        literal(out, codes, p)


def noise(height, width, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)


def guess(mode, im, y, x):
    """Prediction of one pixel, straight from the definition of each mode."""
    if y == 0 and x == 0:
        return [0, 0, 0, 255]
    if y == 0:
        return im[0][x - 1]
    if x == 0:
        return im[y - 1][0]
    w = len(im[0])
    L, T, TL = im[y][x - 1], im[y - 1][x], im[y - 1][x - 1]
    TR = im[y - 1][x + 1] if x + 1 < w else im[y][0]
    avg = lambda a, b: [(p + q) // 2 for p, q in zip(a, b, strict=True)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        e = [a + b - c for a, b, c in zip(L, T, TL, strict=True)]
        return L if sum(abs(p - q) for p, q in zip(e, L, strict=True)) < sum(abs(p - q) for p, q in zip(e, T, strict=True)) else T
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(L, T, TL, strict=True)]
    if mode == 13:
        return [clip(m + int((m - c) / 2)) for m, c in zip(avg(L, T), TL, strict=True)]
    return {0: [0, 0, 0, 255], 1: L, 2: T, 3: TR, 4: TL, 5: avg(avg(L, TR), T), 6: avg(L, TL), 7: avg(L, T), 8: avg(TL, T),
            9: avg(T, TR), 10: avg(avg(L, TL), avg(T, TR))}[mode]


def test_predictor_modes():
    im = noise(16, 37, 1)
    modes = np.zeros((4, 10, 4), np.uint8)
    modes[..., 1] = (np.arange(40) % 14).reshape(4, 10)
    rows = im.astype(int).tolist()
    rest = im.copy()
    for y in range(16):
        for x in range(37):
            rest[y, x] = (im[y, x].astype(int) - guess(int(modes[y // 4, x // 4, 1]), rows, y, x)) & 255
    out = webp.Out()
    head(out, 37, 16)
    out.put(1, 1)
    out.put(webp.PREDICTOR, 2)
    out.put(0, 3)
    sub_image(out, modes)
    out.put(0, 1)
    main_image(out, rest)
    assert (webp.decode_image(out.bytes()) == im).all()


def test_cross_colour_and_subtract_green():
    im = noise(9, 21, 2)
    e = noise(3, 6, 3)
    rest = im.astype(int)
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: (signed(int(t)) * signed(int(c))) >> 5
    for y in range(9):
        for x in range(21):
            b, g, r, _ = (int(v) for v in im[y, x])
            gr, gb, rb = e[y // 4, x // 4][:3]
            rest[y, x, 2] = (r - delta(gr, g)) & 255
            rest[y, x, 0] = (b - delta(gb, g) - delta(rb, r)) & 255
    again = rest.copy()
    again[..., 0] = (again[..., 0] - again[..., 1]) & 255
    again[..., 2] = (again[..., 2] - again[..., 1]) & 255
    out = webp.Out()
    head(out, 21, 9)
    out.put(1, 1)
    out.put(webp.CROSS_COLOUR, 2)
    out.put(0, 3)
    sub_image(out, e)
    out.put(1, 1)
    out.put(webp.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    main_image(out, again.astype(np.uint8))
    assert (webp.decode_image(out.bytes()) == im).all()


@pytest.mark.parametrize("n,pack", [(2, 3), (3, 2), (16, 1), (17, 0)])
def test_palettes(n, pack):
    rng = np.random.default_rng(n)
    colours = rng.integers(0, 256, (n, 4))
    index = rng.integers(0, n, (5, 13))
    out = webp.Out()
    head(out, 13, 5)
    out.put(1, 1)
    out.put(webp.PALETTE, 2)
    out.put(n - 1, 8)
    sub_image(out, np.diff(colours, axis=0, prepend=np.zeros((1, 4), int)).astype(np.uint8))
    out.put(0, 1)
    width = -(-13 >> pack)
    packed = np.zeros((5, width, 4), np.uint8)
    for x in range(13):
        packed[:, x >> pack, 1] |= (index[:, x] << (x % (1 << pack)) * (8 >> pack)).astype(np.uint8)
    main_image(out, packed)
    assert (webp.decode_image(out.bytes()) == colours[index]).all()


@pytest.mark.parametrize("cache_bits", [0, 4])
def test_references_and_cache(cache_bits):
    """Literals, copies at near and far distances that overlap themselves, and pixels from the cache."""
    rng = np.random.default_rng(7)
    width, height = 20, 12
    out = webp.Out()
    head(out, width, height)
    out.put(0, 1)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    out.put(0, 1)
    codes = flat_codes(out, cache_bits, tuple(range(16)))
    want, cache = [], {}

    def put(p):
        want.append(p)
        b, g, r, a = p
        cache[(webp.CACHE_HASH * (a << 24 | r << 16 | g << 8 | b) & 0xFFFFFFFF) >> (32 - (cache_bits or 1))] = p

    while len(want) < width * height:
        kind = rng.integers(0, 3) if want else 0
        if kind == 1 and len(want) < width * height - 40:
            number = int(rng.choice([1, 2, 3, 4, 9, 14, 121, 130, 160]))
            d = webp._distance(number, width)
            if d > len(want):
                continue
            n = int(rng.choice([1, 2, 4, 5, 17, 33]))
            for value, table, sizes in ((n, codes[0][256:], codes[1][256:]), (number, codes[3], codes[4])):
                s, e, k = webp.prefix_symbol(value)
                out.put(int(table[s]), int(sizes[s]))
                out.put(e, k)
            for _ in range(n):
                put(want[-d])
        elif kind == 2 and cache_bits:
            k = int(rng.choice(list(cache)))
            out.put(int(codes[0][280 + k]), int(codes[1][280 + k]))
            put(cache[k])
        else:
            p = tuple(int(v) for v in rng.integers(0, 256, 4))
            literal(out, codes, p)
            put(p)
    assert webp.decode_image(out.bytes()).reshape(-1, 4).tolist() == [list(p) for p in want]


def test_several_code_groups():
    im = noise(8, 8, 9)
    which = np.zeros((2, 2, 4), np.uint8)
    which[..., 1] = [[0, 1], [1, 0]]
    out = webp.Out()
    head(out, 8, 8)
    out.put(0, 1)
    out.put(0, 1)
    out.put(1, 1)
    out.put(0, 3)
    sub_image(out, which)
    groups = [flat_codes(out), flat_codes(out, 0, (0, 1))]
    for y in range(8):
        for x in range(8):
            literal(out, groups[which[y // 4, x // 4, 1]], im[y, x])
    assert (webp.decode_image(out.bytes()) == im).all()


def test_damage_is_an_error():
    good = webp.encode(padded(b"some text that is long enough to be cut" * 30))
    for bad in (good[:-20], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)


def test_media_columns(spark, docs, edge, none):
    for d in (docs.limit(60), edge):
        got = d.select("text", media.stored(F.col("text")).alias("s")).select("text", "s.*", media.loaded(F.col("s.media")).alias("q")).collect()
        for r in got:
            raw = (r["text"] or "").encode()
            assert r["n_bytes"] == len(raw) and bytes(r["q"]["grey"]) == padded(raw)
            assert r["q"]["width"] == 64 and len(r["q"]["pixels"]) == 4 * len(r["q"]["grey"])
        by_text = {}
        for r in got:
            by_text.setdefault(r["text"] or "", set()).add((hashlib.sha256(r["media"]).hexdigest(), r["q"]["feature"], zlib.crc32(r["q"]["grey"])))
        assert all(len(v) == 1 for v in by_text.values())
    assert none.select(media.stored(F.col("text")).alias("s")).count() == 0
    assert spark.sql("select cast(null as binary) as m").select(media.loaded(F.col("m")).alias("q")).first()["q"] is None
