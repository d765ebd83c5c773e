"""Lossless WebP in numpy: payloads as grey images, and a decoder for the whole format.

``encode`` stores bytes as the green samples of images 64 pixels wide, at most
``PIECE`` bytes each, one WebP file after the other.  Few distinct values are
stored through a palette with several pixels in one sample; runs of a value
become back-references.

``decode`` reads any lossless file: simple and normal prefix codes, several code
groups, back-references, colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms.  Where an image has one code group and no
cache, the literals are decoded with vector operations: the pixel that would
begin at every bit is looked up, and the places where pixels do begin are found
by doubling the steps.  All other pixels are decoded one by one.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

WIDTH = 64
PIECE = 1 << 18
RUN = 16  # so many equal samples after a first one make a back-reference

# Fixed values of the format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


# ---- bits and prefix codes


class Bits:
    """Reads bits, lowest first; reading past the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return (int.from_bytes(self.data[a : a + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends too early")
        return got


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """The numbers below ``2 ** n`` with their bits in reverse order."""
    out, x = np.zeros(1 << n, np.int64), np.arange(1 << n)
    for _ in range(n):
        out, x = (out << 1) | (x & 1), x >> 1
    return out


class Code:
    """A canonical prefix code as a table over the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, lengths = np.array([0]), np.array([0])
        order = used[np.lexsort((used, lengths[used]))]
        self.bits = 0 if len(order) == 1 else int(lengths[order].max())
        own = np.zeros(1, int) if len(order) == 1 else lengths[order]
        share = 1 << (self.bits - own)
        if share.sum() != 1 << self.bits:
            raise ValueError("not a complete prefix code")
        back = _reversed(self.bits)
        self.symbol = np.repeat(order, share)[back]
        self.length = np.repeat(own, share)[back]

    def read(self, src: Bits) -> int:
        if not self.bits:
            return int(self.symbol[0])
        at = src.peek(self.bits)
        src.read(int(self.length[at]))
        return int(self.symbol[at])


def _read_code(src: Bits, size: int) -> Code:
    lengths = np.zeros(size, dtype=np.int64)
    if src.read(1):
        two, wide = src.read(1), src.read(1)
        symbols = [src.read(8 if wide else 1)] + ([src.read(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("a symbol is out of range")
        lengths[symbols] = 1
        return Code(lengths)
    first = np.zeros(19, dtype=np.int64)
    for k in LENGTH_ORDER[: 4 + src.read(4)]:
        first[k] = src.read(3)
    code = Code(first)
    left = 2 + src.read(2 + 2 * src.read(3)) if src.read(1) else size
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(src)
        if s < 16:
            lengths[at] = s
            previous = s or previous
            at += 1
            continue
        n = {16: lambda: 3 + src.read(2), 17: lambda: 3 + src.read(3), 18: lambda: 11 + src.read(7)}[s]()
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = previous if s == 16 else 0
        at += n
    return Code(lengths)


def _number(src: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + src.read(extra) + 1


def _distance(number: int, width: int) -> int:
    if number > len(NEAR):
        return number - len(NEAR)
    x, y = NEAR[number - 1]
    return max(1, x + y * width)


# ---- pixels


def _literal_runs(src: Bits, codes: list[Code]):
    """For every bit: the pixel beginning there, the bit after it, and whether it is no literal."""
    data = np.frombuffer(src.data[src.at >> 3 :] + bytes(12), dtype=np.uint8).astype(np.uint32)
    word = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    places = 8 * (len(word) - 8)
    window = (word[:-8, None] >> np.arange(8, dtype=np.uint32)).ravel()
    green, red, blue, alpha = codes[:4]
    at = window & np.uint32((1 << green.bits) - 1)
    g, step = green.symbol.astype(np.int32)[at], green.length.astype(np.int32)[at]
    pixel = (g & 255).astype(np.uint32) << 8
    for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
        if code.bits:
            at = window[np.minimum(np.arange(places, dtype=np.int32) + step, places - 1)] & np.uint32((1 << code.bits) - 1)
            pixel |= code.symbol.astype(np.uint32)[at] << np.uint32(shift)
            step = step + code.length.astype(np.int32)[at]
        else:
            pixel |= np.uint32(int(code.symbol[0]) << shift)
    other = g >= LITERALS
    step[other] = 0
    jump = np.minimum(np.arange(places, dtype=np.int32) + step, places - 1)
    return pixel, jump, other, g


def _pixels_by_runs(src: Bits, width: int, count: int, codes: list[Code]) -> np.ndarray:
    out = np.zeros(count, dtype=np.uint32)
    if not any(c.bits for c in codes[:4]) and codes[0].symbol[0] < LITERALS:
        out[:] = int(codes[3].symbol[0]) << 24 | int(codes[1].symbol[0]) << 16 | int(codes[0].symbol[0]) << 8 | int(codes[2].symbol[0])
        return out
    base = src.at & ~7
    pixel, jump, other, green = _literal_runs(src, codes)
    jumps = [jump]
    for _ in range(4):
        jumps.append(jumps[-1][jumps[-1]])
    far = memoryview(jumps[4])
    done = 0
    while done < count:
        # every sixteenth place, then those between
        places, p = [], src.at - base
        while 16 * len(places) < count - done:
            places.append(p)
            if far[p] == p:
                break
            p = far[p]
        run = np.array(places, dtype=np.int64)
        for j in (jumps[3], jumps[2], jumps[1], jumps[0]):
            run = np.stack((run, j[run]), axis=1).ravel()
        run = run[: count - done]
        stop = np.flatnonzero(other[run])
        n = int(stop[0]) if len(stop) else len(run)
        out[done : done + n] = pixel[run[:n]]
        done += n
        if len(stop):
            place = int(run[n])
            src.at = base + place
            codes[0].read(src)
            length = _number(src, int(green[place]) - LITERALS)
            d = _distance(_number(src, codes[4].read(src)), width)
            if d > done or length > count - done:
                raise ValueError("a back-reference leaves the image")
            for a in range(done, done + length, d):
                m = min(d, done + length - a)
                out[a : a + m] = out[a - d : a - d + m]
            done += length
        elif n:
            src.at = base + int(jump[run[n - 1]])
        else:
            raise ValueError("the image ends too early")
    if src.at > src.end:
        raise ValueError("the image ends too early")
    return out


def _pixels_one_by_one(src: Bits, width: int, count: int, groups: list[list[Code]], group_of, cache_bits: int) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []

    def put(p: int) -> None:
        out.append(p)
        if cache:
            cache[(CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < count:
        codes = groups[group_of(len(out))]
        s = codes[0].read(src)
        if s < LITERALS:
            red, blue, alpha = (c.read(src) for c in codes[1:4])
            put(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            length = _number(src, s - LITERALS)
            d = _distance(_number(src, codes[4].read(src)), width)
            if d > len(out) or length > count - len(out):
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                put(out[-d])
        else:
            put(cache[s - LITERALS - LENGTHS])
    return np.array(out, dtype=np.uint32)


def _image(src: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = src.read(4) if src.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    which = None
    if main and src.read(1):
        tile = src.read(3) + 2
        across = -(-width >> tile)
        which = (_image(src, across, -(-height >> tile), False) >> 8) & 0xFFFF
    n = 1 if which is None else int(which.max()) + 1
    size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    groups = [[_read_code(src, k) for k in (size, 256, 256, 256, DISTANCES)] for _ in range(n)]
    if n == 1 and not cache_bits:
        return _pixels_by_runs(src, width, width * height, groups[0])
    of = (lambda i: 0) if which is None else (lambda i: int(which[(i // width >> tile) * across + (i % width >> tile)]))
    return _pixels_one_by_one(src, width, width * height, groups, of, cache_bits)


# ---- inverse transforms; channels are the last axis: blue, green, red, alpha


def _channels(argb: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(argb.astype("<u4")).view(np.uint8).reshape(-1, width, 4)


def _mean(a, b):
    return (a + b) >> 1


def _predicted(mode: int, left, top, right, corner):
    """Prediction from the pixels left, above, above right and above left."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = _mean(left, top)
        return np.clip(m + np.fix((m - corner) / 2).astype(np.int64), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner,
        5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner), 7: lambda: _mean(left, top),
        8: lambda: _mean(corner, top), 9: lambda: _mean(top, right), 10: lambda: _mean(_mean(left, corner), _mean(top, right)),
    }[mode]()


def _undo_predictor(image: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width, _ = image.shape
    out = image.astype(np.int64)
    out[0, 0] = (out[0, 0] + (0, 0, 0, 255)) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        out[y, 0] = (out[y, 0] + out[y - 1, 0]) & 255
        above = np.concatenate((out[y - 1], out[y, :1]))
        for a in range(0, width, 1 << tile):
            x0, x1 = max(a, 1), min(a + (1 << tile), width)
            mode = int(modes[y >> tile, a >> tile])
            if mode in (2, 3, 4, 8, 9) or mode == 0 or mode > 13:  # nothing to the left is needed
                out[y, x0:x1] = (out[y, x0:x1] + _predicted(mode, None, above[x0:x1], above[x0 + 1 : x1 + 1], above[x0 - 1 : x1 - 1])) & 255
            elif mode == 1:
                out[y, x0 - 1 : x1] = np.cumsum(out[y, x0 - 1 : x1], axis=0) & 255
            else:
                for x in range(x0, x1):
                    out[y, x] = (out[y, x] + _predicted(mode, out[y, x - 1], above[x], above[x + 1], above[x - 1])) & 255
    return out.astype(np.uint8)


def _undo_cross_colour(image: np.ndarray, elements: np.ndarray, tile: int) -> np.ndarray:
    height, width, _ = image.shape
    e = np.repeat(np.repeat(elements, 1 << tile, axis=0)[:height], 1 << tile, axis=1)[:, :width].view(np.int8).astype(np.int64)
    delta = lambda t, c: (t * c.astype(np.uint8).view(np.int8).astype(np.int64)) >> 5
    out = image.astype(np.int64)
    green = image[..., 1]
    out[..., 2] = (out[..., 2] + delta(e[..., 0], green)) & 255
    out[..., 0] = (out[..., 0] + delta(e[..., 1], green) + delta(e[..., 2], out[..., 2])) & 255
    return out.astype(np.uint8)


def _undo_palette(image: np.ndarray, colours: np.ndarray, width: int, pack: int) -> np.ndarray:
    bits = 8 >> pack
    places = np.arange(1 << pack) * bits
    index = ((image[..., 1][..., None].astype(np.int64) >> places) & ((1 << bits) - 1)).reshape(image.shape[0], -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)
    table[: len(colours)] = colours
    return table[index]


def _pack(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode_image(data: bytes) -> np.ndarray:
    """height x width x 4 samples (blue, green, red, alpha) of one bitstream."""
    src = Bits(data)
    if src.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = src.read(14) + 1, src.read(14) + 1
    src.read(1)
    if src.read(3):
        raise ValueError("unknown version")
    undo, now, seen = [], width, set()
    while src.read(1):
        kind = src.read(2)
        if kind in seen:
            raise ValueError("a transform is given twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = src.read(3) + 2
            across = -(-now >> tile)
            undo.append((kind, _channels(_image(src, across, -(-height >> tile), False), across), tile))
        elif kind == PALETTE:
            n = src.read(8) + 1
            colours = np.cumsum(_channels(_image(src, n, 1, False), n)[0], axis=0, dtype=np.int64).astype(np.uint8)
            undo.append((kind, colours, now))
            now = -(-now >> _pack(n))
        else:
            undo.append((kind, None, None))
    image = _channels(_image(src, now, height, True), now)
    for kind, table, k in reversed(undo):
        if kind == PREDICTOR:
            image = _undo_predictor(image, table[..., 1] & 15, k)
        elif kind == CROSS_COLOUR:
            image = _undo_cross_colour(image, table, k)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
        else:
            image = _undo_palette(image, table, k, _pack(len(table)))
    return image


# ---- storing payloads


class Out:
    """Collects (value, bits) pairs and joins them at the end."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, bits: int) -> None:
        self.many(np.array([value]), np.array([bits]))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        return np.packbits(((np.repeat(values, sizes) >> place) & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, most: int = 13) -> np.ndarray:
    """Lengths of a prefix code for the counted symbols, none longer than ``most``."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts).tolist()
    weight = counts.tolist()
    while True:
        heap = [(weight[s], s, (s,)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(used, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values(), default=0) <= most:
            break
        weight = [(w + 1) >> 1 for w in weight]
    lengths[used] = [max(1, d) for d in depth.values()]
    return lengths


def code_words(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, lowest bit first."""
    out = np.zeros(len(lengths), dtype=np.int64)
    code = before = 0
    for s in sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s)):
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        out[s] = _reversed(before)[code]
        code += 1
    return out


_PLAIN = np.array([4] * 13 + [5] * 6)  # a complete code for the nineteen length symbols
_PLAIN_WORDS = code_words(_PLAIN)


def write_code(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    out.put(0, 1)
    out.put(15, 4)
    out.many(_PLAIN[list(LENGTH_ORDER)], np.full(19, 3))
    out.put(0, 1)
    edge = np.concatenate(([0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]))
    values, sizes = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        s, n = int(lengths[a]), b - a
        while s == 0 and n >= 3:
            m = min(n, 138)
            k, extra, least = (18, 7, 11) if m >= 11 else (17, 3, 3)
            values += [int(_PLAIN_WORDS[k]), m - least]
            sizes += [int(_PLAIN[k]), extra]
            n -= m
        values += [int(_PLAIN_WORDS[s])] * n
        sizes += [int(_PLAIN[s])] * n
    out.many(np.array(values), np.array(sizes))


def prefix_symbol(number: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number for a length or distance."""
    if number <= 4:
        return number - 1, 0, 0
    v = number - 1
    n = v.bit_length() - 1
    return 2 * n + (v >> (n - 1) & 1), v & ((1 << (n - 1)) - 1), n - 1


def _write_samples(out: Out, green: np.ndarray, alpha: int, head: bytes = b"") -> None:
    """An image of one code group: green samples, the other channels constant, runs as back-references."""
    same = np.concatenate(([False], green[1:] == green[:-1]))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= RUN]
    symbols, extras, sizes, at = [], [], [], 0
    for a, b in runs:
        symbols.append(green[at:a].astype(np.int64))
        extras.append(np.zeros(a - at, np.int64))
        sizes.append(np.zeros(a - at, np.int64))
        for c in range(a, b, 4096):
            s, e, n = prefix_symbol(min(4096, b - c))
            symbols.append(np.array([LITERALS + s]))
            extras.append(np.array([e]))
            sizes.append(np.array([n]))
        at = b
    symbols.append(green[at:].astype(np.int64))
    extras.append(np.zeros(len(green) - at, np.int64))
    sizes.append(np.zeros(len(green) - at, np.int64))
    s, e, n = np.concatenate(symbols), np.concatenate(extras), np.concatenate(sizes)
    lengths = code_lengths(np.bincount(s, minlength=LITERALS + LENGTHS))
    write_code(out, lengths)
    for value in (0, 0, alpha):
        write_code(out, np.eye(1, 256, value, dtype=np.int64)[0])
    write_code(out, np.eye(1, DISTANCES, 1, dtype=np.int64)[0])  # the only distance: one to the left
    words = code_words(lengths)
    own = np.where(np.count_nonzero(lengths) > 1, lengths[s], 0)
    out.many(np.stack((words[s], e), axis=1).ravel(), np.stack((own, n), axis=1).ravel())


def encode_image(samples: np.ndarray) -> bytes:
    """Bitstream of a grey image: samples, ``WIDTH`` to a row, in the green channel (and in all channels through a palette)."""
    height = len(samples) // WIDTH
    out = Out()
    for value, bits in ((0x2F, 8), (WIDTH - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        out.put(value, bits)
    values = np.unique(samples)
    if len(values) <= 16:
        pack = _pack(len(values))
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(values) - 1, 8)
        out.put(0, 1)
        # colours differ in green only, so alpha is 255 once and then 0
        colours = np.diff(np.concatenate(([0], values.astype(np.int64)))) & 255
        _write_palette(out, colours)
        index = np.searchsorted(values, samples).reshape(height, -1, 1 << pack)
        samples = (index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2).ravel().astype(np.uint8)
    out.put(0, 1)  # no further transform
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one code group
    _write_samples(out, samples, 255)
    return out.bytes()


def _write_palette(out: Out, colours: np.ndarray) -> None:
    green = code_lengths(np.bincount(colours, minlength=LITERALS + LENGTHS))
    alpha = np.zeros(256, np.int64)
    alpha[[255] if len(colours) == 1 else [0, 255]] = 1
    write_code(out, green)
    for code in (np.eye(1, 256, dtype=np.int64)[0], np.eye(1, 256, dtype=np.int64)[0], alpha):
        write_code(out, code)
    write_code(out, np.eye(1, DISTANCES, 0, dtype=np.int64)[0])
    words = code_words(green)
    own = green[colours] if np.count_nonzero(green) > 1 else np.zeros(len(colours), np.int64)
    last = np.zeros(len(colours), np.int64)
    last[0] = 1
    out.many(np.stack((words[colours], last), axis=1).ravel(), np.stack((own, np.full(len(colours), int(len(colours) > 1))), axis=1).ravel())


def file_of(bitstream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(bitstream)) + bitstream + bytes(len(bitstream) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def encode(payload: bytes) -> bytes:
    """WebP files of a payload whose length is a positive multiple of ``WIDTH``."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(file_of(encode_image(samples[a : a + PIECE])) for a in range(0, len(samples), PIECE))


def decode(media: bytes) -> list[np.ndarray]:
    """Pixel arrays of one WebP file after the other."""
    at, out = 0, []
    while at < len(media):
        riff, size, webp = struct.unpack_from("<4sI4s", media, at)
        kind, length = struct.unpack_from("<4sI", media, at + 12)
        if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L") or at + 8 + size > len(media) or 12 + length > size:
            raise ValueError("not a lossless WebP file")
        out.append(decode_image(media[at + 20 : at + 20 + length]))
        at += 8 + size
    return out
