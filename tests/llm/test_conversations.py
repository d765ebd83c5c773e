import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from turnloom.llm import conversations as C
from turnloom.llm import spread
from turnloom.llm.queries import QUERIES
from turnloom.session import shared_dir

SF = "/root/testdata/sf0.001"
OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
PATTERN = re.compile(r"(s?(ua)+)?")


def spoil(rows):
    """Rows after damage by conversation, in order of turn."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(C.SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Forwards over whole scripts: the least (cost, audit) of each number of rows done and last initial, with its rows.

    Scripts of one cost that end alike are never beginnings of each other, so the least one stays least.
    """
    bad, queue, done = faults(rows), [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, initials, out = heapq.heappop(queue)
        if (i, initials[-1:]) in done:
            continue
        done.add((i, initials[-1:]))
        if i == len(rows) and PATTERN.fullmatch(initials):
            return cost, audit, out
        ways = [(3, "I", i, (role, "")) for role in ("user", "assistant")]
        if i < len(rows):
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, initials, out))
            if bad[i] not in ("blank", "duplicate"):
                late = 3 * (bad[i] == "truncated")
                ways += [(late, "K", i + 1, rows[i][1:])] + [(3 + late, "R", i + 1, (role, rows[i][2])) for role in ("user", "assistant")]
        for more, letter, at, row in ways:
            now = initials + row[0][:1]
            if row[0] and any(PATTERN.fullmatch(now + end) for end in ("", "a", "ua")):
                heapq.heappush(queue, (cost + more, audit + letter, at, now, (*out, row)))


def expected(rows, search):
    for conv, own in spoil(rows).items():
        bad, turns = faults(own), [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, done = search(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, *[bad.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit,
               hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())


def table(rows):
    return sorted(([r[c] for c in OUT] for r in rows), key=repr)


def frame(spark, rows, parts=3):
    extra = [(*r, "x", 1, "y") for r in rows]
    return spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, sha string, kind int, first string").repartition(parts)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut off", "Why?", "", " \t\n", "Well. ", "e.g", None, "日本.", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(rng.randint(1, 5)):
            row = (conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts))
            rows += [row] * rng.choice([1, 1, 1, 2])
    return rows


def test_against_search(spark, made):
    got = C.repair(C.damage(frame(spark, made)))
    assert got.columns == OUT
    assert table(got.collect()) == sorted(map(list, expected(made, cheapest)), key=repr)


def test_spilled_conversations(spark, made, monkeypatch):
    """Segments of a few rows, read back in order, give the same result."""
    want = table(C.repair(C.damage(frame(spark, made))).collect())
    by_conv = {}
    folder = f"file://{shared_dir(spark)}/spill"
    monkeypatch.setattr(C, "SPILL", 250)
    monkeypatch.setattr(C, "attempt_name", itertools.count().__next__)
    for conv, own in spoil(made).items():
        one = C.Conversation(folder)
        for (turn, role, text), bad in reversed(list(zip(own, faults(own), strict=True))):
            one.add(turn, role, text, ["", "blank", "duplicate", "truncated"].index(bad))
        by_conv[conv] = [conv, *one.result()]
    assert sorted(by_conv.values(), key=repr) == want


def test_query_and_hot_rows(spark, monkeypatch):
    src = spark.read.parquet(f"{SF}/conversations.parquet")
    want = table(QUERIES["op13_conversations"](spark, SF).collect())
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in src.collect()]
    assert {r[0] for r in want} == {r[0] for r in rows}
    short = [r for r in rows if sum(r[0] == x[0] for x in rows) <= 5]
    assert [w for w in want if w[0] in {r[0] for r in short}] == sorted(map(list, expected(short, cheapest)), key=repr)
    monkeypatch.setattr(spread, "HOT", 10**9)
    assert table(QUERIES["op13_conversations"](spark, SF).collect()) == want


def test_one_giant_conversation(spark):
    """Thousands of rows with one text in one conversation: one copy stays; Arrow batches of 100 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rows = spark.range(3000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("Yes.").alias("text"))
        got = C.repair(rows).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got["duplicate"], got["gaps"], got["illegal"], got["cost"]) == (2999, 0, 2999, 4 * 2999 + 3)
    assert got["audit"] == "K" + "D" * 2999 + "I"
    assert got["repaired_sha256"] == hashlib.sha256(b"user:Yes.\nassistant:").hexdigest()


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.repair(C.damage(empty)).collect() == []
    gone = spark.createDataFrame([(1, 2, "user", "x", False)], "conv_id long, turn long, role string, text string, present boolean")
    assert list(C.repair(gone).first()) == [1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
