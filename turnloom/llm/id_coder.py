"""Adaptive context-mixing range coder for token ids.

A block of up to ``BLOCK`` ids starts with a fresh model and can be decoded
alone.  Its ids are dealt to lanes of consecutive ids, as many as give at least
``RUN`` ids each and ``LANES`` at most; step i codes the i-th id of every lane
with numpy, and what all lanes met in a step is learned before the next one, by
one model for the whole block.

Model: order 2 (hashed) keeps the likeliest follower of two ids, order 1 the two
likeliest of one id, each with a counted confidence.  First the follower of
order 2 is tried, then the best one of order 1 that differs from it.  The chance
of each try is mixed in the logistic domain from what the orders say: hit rates
counted per order and confidence, and the frequency of the id in order 0.  The
weights of the mix depend on confidence and on whether the orders agree; they
follow the errors of the block, as the hit rates do: in its first ``EAGER`` steps
after every one, then after every ``REST``-th.  What both tries leave goes to order 0: counts
of whole ids, taken over after steps that lie ever farther apart.  An id that is
new to the block by then is an escape, its number is kept plainly.

All chances come from integers, tables of integers and sums of products that
doubles hold exactly, so a decoder anywhere takes the same steps.  Of several
lanes that write one slot in a step the last one counts: numpy assigns in this
order, though it promises none, and the checksum of a block would show another.

Coder: low and range in 64 bits, 32-bit words out, carries passed back into the
words already written; every lane has its own words.
"""

from __future__ import annotations

import math
import struct

import numpy as np

BLOCK, LANES, RUN = 1 << 21, 8192, 256
EAGER, REST = 12, 16
_U = np.uint64
_FULL, _FLOOR, _WORD = _U(2**64 - 1), _U(1 << 32), _U(32)
_ONE = 12  # bits of a chance; with those of order 0 no more than a word
_SLOTS1, _SLOTS2 = 16, 18  # bits of the tables of orders 1 and 2
_TOP = 7  # highest confidence

#: ln(p / (1 - p)) in 1/256 for p in 1/4096, and its inverse in 1/4096, for -2047 to 2047
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], dtype=np.int64).clip(-2047, 2047)
_SQUASH = np.array([round(4096 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], dtype=np.int64).clip(2, 4064)


class _Try:
    """Chance that a guess is right: weights per state over the inputs, learned from the errors."""

    def __init__(self, states: int, inputs: int):
        self.weight = np.full((inputs, states), 0.9 / inputs)
        self.weight[0] = 0.6

    def learn(self, met: np.ndarray, steps: list[np.ndarray]) -> None:
        """Weights move by the mean of error times input over what a state met, rounded to 2 ** -20."""
        for w, step in zip(self.weight, steps, strict=True):
            w += np.rint(step / (met + 16.0) * 2.0**-7) * 2.0**-20
        np.clip(self.weight, -2.0, 4.0, out=self.weight)


class _Rate:
    """Counted hit rate per confidence, as an input of a mix."""

    def __init__(self, states: int):
        self.seen = np.full(states, 4.0)
        self.hits = np.arange(states) % 8 * 0.4 + 0.2
        self.take_over()

    def take_over(self) -> None:
        self.value = _STRETCH.take((self.hits * 4095 // self.seen).astype(np.int64))

    def learn(self, seen: np.ndarray, hits: np.ndarray) -> None:
        self.hits += hits
        self.seen += seen
        old = self.seen > 60_000
        self.seen[old] = np.floor(self.seen[old] / 2)
        self.hits[old] = np.floor(self.hits[old] / 2)
        self.take_over()


def _moves() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the slots become, by confidences and hits.

    Order 2, by confidence and hit: what is added.  Order 1, by both confidences, hit of the first and of the other one:
    what is added to the packed pair, whether the other one is replaced, and whether the two change places.
    A first one that hits gains confidence, and loses it where the other one hits; the other one gains by a hit, rests beside a
    right first one, and else loses confidence or is replaced.
    """
    two = np.array([(s >> 1) - s for s in range(8)] + [int(s < _TOP) for s in range(8)], np.int64)
    add, put, swap = np.zeros(256, np.int64), np.zeros(256, bool), np.zeros(256, bool)
    for k in range(256):
        s1, s3, is1, is3 = k & 7, k >> 3 & 7, k >> 6 & 1, k >> 7
        d1 = (s1 < _TOP) if is1 else -((s1 > 0) & is3)
        put[k] = not (is1 or is3 or s3)
        d3 = (s3 < _TOP) if is3 else 0 if is1 or put[k] else -1
        add[k] = int(d1) + (int(d3) << 32)
        swap[k] = (1 if put[k] else s3 + d3) > s1 + d1
    return two, add, put, swap


_ADD2, _ADD, _PUT, _SWAP = _moves()


class _Model:
    def __init__(self, vocabulary: int, inverse: bool):
        self.none = vocabulary  # the guess of an empty slot
        self.total = 17 if vocabulary <= 1 << 16 else 20
        self.slots = None if vocabulary <= 1 << _SLOTS1 else (1 << _SLOTS1) - 1
        self.pair = np.full(1 << _SLOTS1, self.none << 35 | self.none << 3, np.int64)  # the likeliest below, the other one above
        self.two = np.full(1 << _SLOTS2, self.none << 3, np.int64)
        self.rates = [_Rate(8), _Rate(8), _Rate(16)]
        self.tries = [_Try(16, 3), _Try(16, 2)]
        self._mix()
        self.counts = np.zeros(vocabulary, np.int64)
        self.inverse = inverse
        self.start = np.zeros(vocabulary + 1, np.int64)
        self.width = np.zeros(vocabulary + 1, np.int64)  # 0: new to the block
        self.prior = np.full(vocabulary + 1, -2047, np.int64)
        self.next = 1
        self.fresh = self.all = 1
        self._spread()

    def _spread(self) -> None:
        """Deal the places of order 0 by the counts; the last ones are the escape."""
        seen = np.flatnonzero(self.counts)
        places = (1 << self.total) - len(seen) - 1
        escape = places * self.fresh // self.all
        count = self.counts[seen]
        width = count * (places - escape) // max(1, int(count.sum())) + 1
        end = np.cumsum(width)
        self.start[seen], self.width[seen] = end - width, width
        self.escape = int(end[-1]) if len(end) else 0
        self.prior[seen] = _STRETCH.take(width >> (self.total - 12))
        if self.inverse:
            self.place = np.full(1 << self.total, self.none, np.int32)
            self.place[: self.escape] = np.repeat(seen.astype(np.int32), width)

    def count(self, step: int, ids: np.ndarray) -> None:
        """Take over order 0 after ``step`` steps; ``ids`` are those of the steps since the last time."""
        before = self.width[ids] == 0
        self.fresh, self.all = int(before.sum()) // 2 + 1, len(ids) + 2
        self.counts += np.bincount(ids, minlength=len(self.counts))
        self._spread()
        self.next = step + min(32, max(1, step // 4))

    def _mix(self) -> None:
        """Tables of the mixes: of the first try by (agree, confidence of order 1, of order 2), of the second by its state."""
        r2, r1, r = (x.value for x in self.rates)
        w = self.tries[0].weight.reshape(3, 2, 1, 8)
        fixed = w[0] * r2 + w[1] * r1[:, None] * np.arange(2)[:, None, None]
        self.fixed1, self.by1 = fixed.reshape(-1) + 2047, np.repeat(w[2], 8, 1).reshape(-1)
        w = self.tries[1].weight
        self.fixed2, self.by2 = w[0] * r + 2047, w[1]

    def predict(self, a: np.ndarray, b: np.ndarray) -> None:
        """Two guesses and their chances after the last ids ``a`` and those before them ``b``."""
        self.at1 = a if self.slots is None else a & self.slots
        h = a * 0x9E3779B1
        h += b * 0x85EBCA6B
        h *= 0xC2B2AE35
        self.at2 = (h.view(_U) >> _U(64 - _SLOTS2)).view(np.int64)
        self.packed, self.packed2 = self.pair.take(self.at1, mode="clip"), self.two.take(self.at2, mode="clip")
        one, other = self.packed & 0xFFFFFFFF, self.packed >> 32
        self.g1, self.g3, self.first = one >> 3, other >> 3, self.packed2 >> 3
        self.s1, self.s3, self.s2 = one & 7, other & 7, self.packed2 & 7
        agree = -(self.first == self.g1).astype(np.int64)  # all bits
        other ^= one
        other &= agree
        other ^= one  # the one that differs from the first guess
        self.second = other >> 3
        other &= 7
        other += agree & 8
        self.state = other
        agree &= 64
        agree += self.s1 << 3
        agree += self.s2
        self.both_states = agree
        self.prior1, self.prior2 = self.prior.take(self.first, mode="clip"), self.prior.take(self.second, mode="clip")
        dot = self.by1.take(self.both_states, mode="clip")
        dot *= self.prior1
        dot += self.fixed1.take(self.both_states, mode="clip")
        self.f = _SQUASH.take(dot.astype(np.int64), mode="clip")
        dot = self.by2.take(self.state, mode="clip")
        dot *= self.prior2
        dot += self.fixed2.take(self.state, mode="clip")
        self.s = _SQUASH.take(dot.astype(np.int64), mode="clip")
        left = (1 << _ONE) - self.f
        left *= self.s
        left >>= _ONE
        self.both = np.maximum(left, 1, out=left)
        self.both += self.f

    def _learn_chances(self, first: np.ndarray, second: np.ndarray, is1: np.ndarray) -> None:
        r2, r1, r = self.rates
        got = np.bincount((self.both_states << 1) + first, minlength=256).reshape(2, 8, 8, 2).sum(1)  # agree, order 2, hit
        error = ((first.astype(np.int64) << _ONE) - self.f) << 4
        fixed = np.bincount(self.both_states, error, 128).reshape(2, 8, 8)
        by = np.bincount(self.both_states, error * self.prior1, 128).reshape(2, 8, 8).sum(1)
        steps = [fixed.sum(1) * r2.value, (fixed * r1.value[:, None]).sum(1) * np.arange(2)[:, None], by]
        self.tries[0].learn(got.sum(2).reshape(-1), [x.reshape(-1) for x in steps])
        r2.learn(got.sum((0, 2)), got[..., 1].sum(0))
        got = np.bincount((self.s1 << 1) + is1, minlength=16)
        r1.learn(got[::2] + got[1::2], got[1::2])
        missed = np.flatnonzero(~first)
        again, state = second[missed].astype(np.int64), self.state[missed]
        got = np.bincount((state << 1) | again, minlength=32)
        error = ((again << _ONE) - self.s[missed]) << 4
        seen = got[::2] + got[1::2]
        self.tries[1].learn(seen, [np.bincount(state, error, 16) * r.value, np.bincount(state, error * self.prior2[missed], 16)])
        r.learn(seen, got[1::2])
        self._mix()

    def learn(self, ids: np.ndarray, first: np.ndarray, second: np.ndarray, step: int) -> None:
        """What was coded, and whether the first or the second guess was right."""
        is1, is3 = self.g1 == ids, self.g3 == ids
        if step < EAGER or step % REST == 0:
            self._learn_chances(first, second, is1)
        new = ids << 3
        new |= 1
        k = first * np.int64(8)
        k += self.s2
        now = self.packed2
        now += _ADD2.take(k, mode="clip")
        np.putmask(now, k < 2, new)
        self.two[self.at2] = now
        k = self.s3 << 3
        k += self.s1
        k += is1 * np.int64(64)
        k += is3 * np.int64(128)
        now = self.packed
        now += _ADD.take(k, mode="clip")
        new <<= 32
        new |= now & 0xFFFFFFFF
        np.putmask(now, _PUT.take(k, mode="clip"), new)
        np.putmask(now, _SWAP.take(k, mode="clip"), (now >> 32) | (now << 32))
        self.pair[self.at1] = now


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of ``n`` ids; only the last lane may be shorter."""
    steps = -(-n // max(1, min(LANES, n // RUN)))
    return -(-n // steps), steps


def encode_block(ids: np.ndarray, bits: int) -> bytes:
    """Code one block of ids below ``2 ** bits``; ``bits`` is at most 20.

    An empty block gives no bytes.  Bytes: number of new ids, words of each lane, the new ids, then the lanes' words.
    """
    n = len(ids)
    if n == 0:
        return b""
    ids = np.asarray(ids).astype(np.int64)
    if n > BLOCK or bits > 20 or ids.min() < 0 or ids.max() >= 1 << bits:
        raise ValueError("a block is too long or an id out of range")
    lanes, steps = _shape(n)
    grid = np.zeros((steps + 2, lanes), np.int64)
    grid[2:] = np.concatenate((ids, np.zeros(lanes * steps - n, np.int64))).reshape(lanes, steps).T
    tail = n - (lanes - 1) * steps  # ids of the last lane
    model = _Model(1 << bits, False)
    words = np.zeros((steps + 2) * lanes, dtype=np.uint32)
    lane = np.arange(lanes)
    at = lane.copy()  # place of the next word of each lane, one row of lanes after the other
    low, span = np.zeros(lanes, _U), np.full(lanes, _FULL, _U)
    fresh: list[np.ndarray] = []
    since = 0

    def carry(some: np.ndarray) -> None:
        place = at[some] - lanes
        while len(place):
            words[place] += np.uint32(1)
            place = place[words[place] == 0] - lanes

    for i in range(steps):
        m = lanes if i < tail else lanes - 1
        if i == model.next:
            model.count(i, np.concatenate([grid[k + 2, : lanes if k < tail else lanes - 1] for k in range(since, i)]))
            since = i
        now = grid[i + 2, :m]
        model.predict(grid[i + 1, :m], grid[i, :m])
        first, second = model.first == now, model.second == now
        miss = ~(first | second)
        start = model.f * ~first
        end = start.copy()
        gap = model.both - model.f
        start += gap * miss
        np.putmask(end, first, model.f)
        np.putmask(end, second, model.both)
        np.putmask(end, miss, 1 << _ONE)
        end -= start
        own = span[:m]
        own >>= _U(_ONE)
        offset = own * start.view(_U)
        own *= end.view(_U)
        # order 0 for all lanes; it counts where both guesses fail
        start, width = model.start.take(now, mode="clip"), model.width.take(now, mode="clip")
        new = np.flatnonzero((width == 0) & miss)
        if len(new):
            start[new], width[new] = model.escape, (1 << model.total) - model.escape
            fresh.append(now[new])
        part = own >> _U(model.total)
        start = start.view(_U)
        start *= part
        start *= miss
        offset += start
        part *= width.view(_U)
        np.putmask(own, miss, part)
        model.learn(now, first, second, i)
        low[:m] += offset
        carry(np.flatnonzero(low[:m] < offset))
        small = np.flatnonzero(span[:m] < _FLOOR)
        l = low[small]
        words[at[small]] = (l >> _WORD).astype(np.uint32)
        at[small] += lanes
        low[small] = l << _WORD
        span[small] <<= _WORD
    # one more word names a value inside the last range; what is missing after it reads as zero
    end = low + (_FLOOR - _U(1))
    carry(np.flatnonzero(end < low))
    words[at] = (end >> _WORD).astype(np.uint32)
    size = at // lanes + 1
    used = np.arange(size.max())[:, None] < size
    plain = np.concatenate([np.zeros(0, np.int64), *fresh])
    return b"".join((struct.pack("<I", len(plain)), size.astype("<u2").tobytes(), plain.astype("<u2" if bits <= 16 else "<u4").tobytes(),
                     words[: used.size].reshape(used.shape)[used].astype("<u4").tobytes()))


def decode_block(coded: bytes, n: int, bits: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    if n == 0:
        return np.zeros(0, np.int64)
    lanes, steps = _shape(n)
    tail = n - (lanes - 1) * steps
    known = struct.unpack_from("<I", coded)[0]
    size = np.frombuffer(coded, "<u2", lanes, 4).astype(np.int64)
    form = np.dtype("<u2" if bits <= 16 else "<u4")
    plain = np.frombuffer(coded, form, known, 4 + 2 * lanes).astype(np.int64)
    flat = np.frombuffer(coded, "<u4", -1, 4 + 2 * lanes + known * form.itemsize)
    used = np.arange(size.max() + 2)[:, None] < size
    words = np.zeros(used.shape, np.uint32)
    words[used] = flat
    words = words.ravel()
    code = (words[:lanes].astype(_U) << _WORD) | words[lanes : 2 * lanes]
    model = _Model(1 << bits, True)
    grid = np.zeros((steps + 2, lanes), np.int64)
    span = np.full(lanes, _FULL, _U)
    at = np.arange(lanes) + 2 * lanes
    last = len(words) - 1
    since = done = 0
    for i in range(steps):
        m = lanes if i < tail else lanes - 1
        if i == model.next:
            model.count(i, np.concatenate([grid[k + 2, : lanes if k < tail else lanes - 1] for k in range(since, i)]))
            since = i
        model.predict(grid[i + 1, :m], grid[i, :m])
        own, c = span[:m], code[:m]
        part = own >> _U(_ONE)
        end1, end2 = part * model.f.view(_U), part * model.both.view(_U)
        first, miss = c < end1, c >= end2
        now, low = model.second, end1 * ~first
        np.putmask(low, miss, end2)
        part <<= _U(_ONE)
        np.putmask(end2, first, end1)
        np.putmask(end2, miss, part)
        np.putmask(now, first, model.first)
        np.subtract(end2, low, out=own)
        c -= low
        part = own >> _U(model.total)
        v = model.place.take((c // part).view(np.int64), mode="clip").astype(np.int64)
        start, width = model.start.take(v, mode="clip"), model.width.take(v, mode="clip")
        new = np.flatnonzero((v == model.none) & miss)
        if len(new):
            start[new], width[new] = model.escape, (1 << model.total) - model.escape
            v[new] = plain[done : done + len(new)]
            done += len(new)
        start = start.view(_U)
        start *= part
        start *= miss
        c -= start
        part *= width.view(_U)
        np.putmask(own, miss, part)
        np.putmask(now, miss, v)
        model.learn(now, first, ~(first | miss), i)
        grid[i + 2, :m] = now
        small = np.flatnonzero(span[:m] < _FLOOR)
        code[small] = (code[small] << _WORD) | words[np.minimum(at[small], last)]
        at[small] += lanes
        span[small] <<= _WORD
    return grid[2:].T.reshape(-1)[:n]
