"""Streaming forms of cut detection, speech rate, interaction inference and past snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.functions.vectors import block_distance
from turnloom.operators.sequences import character_shares
from turnloom.plans.ordered import with_halo

CUT_BLOCK = 64
RATE_BLOCK = 16  # grid times
EPOCH_MS = 1_704_067_200_000  # 2024-01-01, the zero of all clocks; rows at time 0 itself would be late from the start


def stream_cuts(frames: DataFrame, n_blocks: int, high: float = 0.30, low: float = 0.20, metric: str = "correl", frame_ms: int = 40, delay: str = "1 minute") -> DataFrame:
    """Cuts of a frame stream (video, frame_idx, hist): rows video, block time, and the cut frames of the block.

    A frame goes to its block and, near the edge, to the next one, so each block
    decides alone from at most ``CUT_BLOCK`` + 3 frames: a video of any length
    is spread over its blocks and state ends with the watermark.  Use update
    mode; the last row of a block counts.
    """
    h = with_halo(frames, "frame_idx", back=3, ahead=0, size=CUT_BLOCK)
    h = h.withColumn("block_ts", F.timestamp_millis(F.col("_hb") * CUT_BLOCK * frame_ms + EPOCH_MS)).withWatermark("block_ts", delay)
    g = h.groupBy("video", "block_ts").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "hist", "_own"))).alias("fr"))
    n = F.size("fr")
    d = F.transform(
        F.sequence(F.lit(2), F.greatest(n, F.lit(2))),
        lambda k: F.when(k <= n, block_distance(F.get("fr", k - 1)["hist"], F.get("fr", k - 2)["hist"], n_blocks, metric)),
    )
    g = g.withColumn("d", d)
    # d[k] is the distance of frame k + 1 from frame k (0-based positions in the block).
    at = F.filter(
        F.sequence(F.lit(2), F.greatest(F.size("d") - 1, F.lit(2))),
        lambda k: (F.get("d", k - 2) <= low) & (F.get("d", k - 1) >= high) & (F.get("d", k) <= low) & F.get("fr", k + 1)["_own"],
    )
    return g.select("video", "block_ts", F.transform(at, lambda k: F.get("fr", k)["frame_idx"]).alias("cuts"))


def stream_speech_rate(segs: DataFrame, key: str = "unit", delay: str = "10 minutes", step: int = 500, width: int = 1500) -> DataFrame:
    """Characters per second around each grid time, without the global maximum.

    Rows ``key``, block time and ``rates``, the (t, rate) of the block's grid
    times in order; those at which nobody speaks are left out.  State is a row
    of ``RATE_BLOCK`` sums per block, not a row per grid time.  The watermark
    waits a block longer than ``delay``, so nothing within it is late.  Use
    update mode; the last row of a block counts.
    """
    size = RATE_BLOCK * step
    block = F.floor(F.col("t") / F.lit(size)) * size
    g = character_shares(segs, [key], step, width).withColumn("block_ts", F.timestamp_millis(block + EPOCH_MS))
    g = g.withColumn("slot", F.floor(F.col("t") / F.lit(step)) % RATE_BLOCK).withWatermark("block_ts", f"{delay} {size} milliseconds")
    g = g.groupBy(key, "block_ts").agg(*[F.sum(F.when(F.col("slot") == i, F.col("c"))).alias(f"c{i}") for i in range(RATE_BLOCK)])
    start = F.unix_millis("block_ts") - EPOCH_MS
    each = [F.when(F.col(f"c{i}").isNotNull(), F.struct((start + i * step).alias("t"), (F.col(f"c{i}") * 1000.0 / width).alias("rate"))) for i in range(RATE_BLOCK)]
    return g.select(key, "block_ts", F.array_compact(F.array(*each)).alias("rates"))


# ---- interactions ----------------------------------------------------------

_INTER_OUT = "unit long, speaker string, other string, ms long"
_INTER_STATE = "spk array<string>, start array<long>, stop array<long>, idx array<long>, dropped long, done long, settled int"
DAY = 86_400_000


def _decide(turns: list, j: int, offset: int, gap: int) -> Iterator[tuple[str, str, int]]:
    """Interactions (speaker, other, ms) of turn ``j``; a turn is (speaker, [(start, end), ..])."""
    spk, segs = turns[j]
    first = offset + j == 0
    prev = turns[j - 1] if j > 0 else None
    nxt = turns[j + 1] if j + 1 < len(turns) else None
    if prev is None and nxt is None:
        return
    near_p = prev is not None and segs[0][0] - prev[1][-1][1] <= gap
    near_n = nxt is not None and nxt[1][0][0] - segs[-1][1] <= gap
    to = None
    if first:
        to = nxt[0] if near_n else None
    elif nxt is None:
        to = prev[0] if near_p else None
    elif prev[0] == nxt[0]:
        to = prev[0] if near_p or near_n else None
    else:
        back = j >= 2 and turns[j - 2][0] == spk
        ahead = j + 2 < len(turns) and turns[j + 2][0] == spk
        if back and not ahead and near_p:
            to = prev[0]
        elif ahead and not back and near_n:
            to = nxt[0]
        else:
            middle = (nxt[1][0][0] + prev[1][-1][1]) // 2
            for a, b in segs:
                left = (a + b) // 2 <= middle
                if left and near_p:
                    yield spk, prev[0], b - a
                elif not left and near_n:
                    yield spk, nxt[0], b - a
            return
    if to is not None:
        for a, b in segs:
            yield spk, to, b - a


def stream_interactions(segs: DataFrame, gap_ms: int, delay: str = "10 minutes", idle_ms: int = 7 * DAY) -> DataFrame:
    """Interactions (unit, speaker, other, ms) as turns become final, that is two turns later or when the unit has ended.

    ``segs``: unit, seg_idx, speaker, start_ms, end_ms and the event time ``ts``
    of the start.  Rows may come in any order within ``delay``: a row waits in
    the state until the watermark has passed it, then rows are taken by start
    and seg_idx, as in the batch form.  A unit has ended when the watermark lies
    ``idle_ms`` behind its last row; give at least the longest pause inside a
    unit.  Rows older than the watermark are late and dropped; append mode.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        unit, now = int(key[0]), state.getCurrentWatermarkMs() - EPOCH_MS
        spk, start, stop, idx, dropped, done, settled = state.get if state.exists else ([], [], [], [], 0, 0, 0)
        rows = [(int(a), int(i), s, int(e)) for s, a, e, i in zip(spk, start, stop, idx)]
        old, waiting = rows[: int(settled)], rows[int(settled) :]
        for b in batches:
            waiting += [(int(a), int(i), s, int(e)) for s, a, e, i in zip(b["speaker"], b["start_ms"], b["end_ms"], b["seg_idx"])]
        waiting.sort()
        passed = sum(r[0] <= now for r in waiting)
        old, waiting = old + waiting[:passed], waiting[passed:]
        closing = not waiting and (not old or old[-1][0] + idle_ms <= now)
        turns: list = []
        for a, i, s, e in old:
            if not turns or turns[-1][0] != s:
                turns.append((s, []))
            turns[-1][1].append((a, e, i))
        plain = [(s, [(a, e) for a, e, _ in seg]) for s, seg in turns]
        upto = len(turns) if closing else len(turns) - 2
        out = []
        for j in range(int(done) - int(dropped), upto):
            out += [(unit, *r) for r in _decide(plain, j, int(dropped), gap_ms)]
        if closing:
            state.remove()
        else:
            done = max(int(done), int(dropped) + upto)
            cut = max(0, done - 2 - int(dropped))
            keep = [(a, i, s, e) for s, seg in turns[cut:] for a, e, i in seg]
            both = keep + waiting
            state.update(([r[2] for r in both], [r[0] for r in both], [r[3] for r in both], [r[1] for r in both], int(dropped) + cut, done, len(keep)))
            wake = waiting[0][0] if waiting else old[-1][0] + idle_ms
            state.setTimeoutTimestamp(max(wake, now) + EPOCH_MS + 1)
        if out:
            yield pd.DataFrame(out, columns=["unit", "speaker", "other", "ms"])

    g = segs.withWatermark("ts", delay).groupBy("unit")
    return g.applyInPandasWithState(step, _INTER_OUT, _INTER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---- past snapshots --------------------------------------------------------

_PAST_OUT = "series int, scene long, src string, dst string, weight double"
_PAST_STATE = "src array<string>, dst array<string>, weight array<double>, at array<long>, scene array<long>, p_src array<string>, p_dst array<string>, p_w array<double>, p_own array<boolean>"


PARTS = 8  # of the relations of a series


def stream_past_snapshots(edges: DataFrame, delay: str = "1 hour", idle_ms: int = 365 * DAY, parts: int = PARTS) -> DataFrame:
    """Stored weight of every relation an end of which is active, scene by scene, looking back only.

    ``edges``: series, scene, src, dst, weight and the event time ``ts`` of the
    scene, the same for all its rows and growing with the scenes.  Rows may come
    in any order within ``delay``: they wait in the state until the watermark
    has passed their scene.  Older rows are late and dropped.  The relations of
    a series are dealt to ``parts`` states by hash, so one long series is kept by
    as many tasks: each sees all edges of a scene, since they tell who is active,
    and keeps and returns the weights of its own relations.  State is given up
    when the watermark lies ``idle_ms`` behind the last scene.  Append mode.
    """

    def settle(book: dict, scene: int, now: dict, mine: set) -> list:
        touched = set()
        for a, b in now:
            touched.update((a, b))
        act: dict = {}
        for (a, b), w in now.items():
            act[a] = act.get(a, 0.0) + w
            act[b] = act.get(b, 0.0) + w
        out = []
        for k in set(book) | mine:
            if k in now:
                book[k] = now[k]
            elif k[0] in touched or k[1] in touched:
                book[k] -= act.get(k[0], 0.0) + act.get(k[1], 0.0)
            else:
                continue
            out.append((scene, k[0], k[1], book[k]))
        return out

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        series, wm = int(key[0]), state.getCurrentWatermarkMs()
        book, waiting, last = {}, [], 0
        if state.exists:
            s, d, w, at, sc, ps, pd_, pw, po = state.get
            book, waiting = dict(zip(zip(s, d), w)), list(zip(at[1:], sc, ps, pd_, pw, po))
            last = int(at[0])
        for b in batches:
            waiting += list(zip(b["at"], b["scene"], b["src"], b["dst"], b["weight"], b["own"]))
        waiting.sort(key=lambda r: (r[0], r[1], r[2], r[3]))
        passed = sum(r[0] <= wm for r in waiting)
        out, i = [], 0
        while i < passed:
            at, scene, now, mine = int(waiting[i][0]), int(waiting[i][1]), {}, set()
            while i < passed and int(waiting[i][1]) == scene:
                pair = waiting[i][2:4]
                now[pair] = now.get(pair, 0.0) + float(waiting[i][4])
                if waiting[i][5]:
                    mine.add(pair)
                i += 1
            out += settle(book, scene, now, mine)
            last = at
        waiting = waiting[passed:]
        if not waiting and last + idle_ms <= wm:
            state.remove()
        else:
            ks = list(book)
            state.update((
                [k[0] for k in ks], [k[1] for k in ks], [book[k] for k in ks], [last, *[int(r[0]) for r in waiting]],
                [int(r[1]) for r in waiting], [r[2] for r in waiting], [r[3] for r in waiting], [float(r[4]) for r in waiting],
                [bool(r[5]) for r in waiting],
            ))
            state.setTimeoutTimestamp(max(int(waiting[0][0]) if waiting else last + idle_ms, wm) + 1)
        if out:
            yield pd.DataFrame([(series, *r) for r in out], columns=["series", "scene", "src", "dst", "weight"])

    each = edges.withColumn("at", F.unix_millis("ts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = F.pmod(F.hash("src", "dst"), F.lit(parts)) == F.col("part")
    g = each.withColumn("own", own).withWatermark("ts", delay).groupBy("series", "part")
    return g.applyInPandasWithState(step, _PAST_OUT, _PAST_STATE, "append", GroupStateTimeout.EventTimeTimeout)
