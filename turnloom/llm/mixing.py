"""Mixing sources to target weights by temperature.

Source weights are the token shares raised to an exponent and normalised.  The
exponent (0: all sources alike, 1: as they are) is bisected to the largest one
whose weights reach a target entropy, a share of that of equal weights; a limit
on how often a source may be repeated raises it again as far as needed.  The
weights are then realised within a token budget: every document of a source
appears once per full pass, and a last partial pass takes whole blocks of
documents in permuted order while they fit, then single documents of the next
block in permuted order.

Blocks are ``BLOCKS`` hash classes of ids, so that running sums pass over small
block totals and only one block per source is ever sorted by row.

Cases: a null source is a source of its own; null ids are one hash class; empty
and null texts have no tokens and appear once per full pass; a source without
tokens gets weight 0 and keeps its documents once.  Repeated rows are counted
as often as they stand.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut

BLOCKS = 4096  # three hexadecimal digits
ENTROPY, REPEATS = 0.95, 4.0
SECTIONS, ROUNDS = 32, 5  # 32 ** 5 = 2 ** 25 steps between exponents 0 and 1


def token_estimate(text: Column) -> Column:
    """Four characters to a token."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def _exponent(totals: DataFrame, all_tokens: int, budget: int, entropy: float, repeats: float) -> float:
    """The exponent in steps of 2 ** -25: each round tries 31 points between the bounds at once."""
    p = F.col("tokens") / F.lit(float(all_tokens))
    power = F.pow(p, F.col("x"))

    def search(reached) -> tuple[float, float]:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            step = (hi - lo) / SECTIONS
            xs = F.explode(F.array(*[F.lit(lo + i * step) for i in range(SECTIONS + 1)])).alias("x")
            at = totals.select("tokens", xs).groupBy("x").agg(
                F.sum(power).alias("z"), F.sum(power * F.ln(p)).alias("s"), F.max(power / p).alias("m"), F.count("*").alias("n"))
            ok = [r["x"] for r in at.where(reached).select("x").collect()]
            top = max(ok, default=lo)
            lo, hi = top, min(hi, top + step)
        return lo, hi

    if totals.limit(2).count() < 2:
        return 1.0
    h = F.ln("z") - F.col("x") * F.col("s") / F.col("z")
    by_entropy = search(h >= F.lit(entropy) * F.ln("n"))[0]
    # repetition falls with the exponent: the last point that still repeats too much, and the next one
    low, high = search(F.col("m") / F.col("z") * F.lit(budget / all_tokens) > F.lit(repeats))
    over = totals.agg((F.max(1 / p) / F.count("*") * F.lit(budget / all_tokens) > F.lit(repeats)).alias("o")).first()["o"]
    return max(by_entropy, high if over else 0.0)


def mixed(docs: DataFrame, keep: list[str], tokens: Column, budget: int | None = None, entropy: float = ENTROPY,
          repeats: float = REPEATS, order: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` as columns ``keep`` with n_tokens, weight (of its source) and copies.

    ``budget``: tokens to hand out, all tokens of the table unless given.
    ``order`` breaks ties between rows of one id.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    src = docs.select(
        row.alias("r"), F.col("source").cast("string").alias("source"), tokens.alias("n"), key.alias("key"),
        F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(["doc_id", *(order or [])])]).alias("o"),
    ).withColumn("block", F.substring("key", 1, 3))
    blocks = cut(src.groupBy("source", "block").agg(F.sum("n").alias("n")))
    totals = cut(blocks.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0"))
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = all_tokens if budget is None else budget
    x = _exponent(totals, all_tokens, budget, entropy, repeats) if all_tokens else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(all_tokens or 1)), F.lit(x))
    z = totals.agg(F.sum(power)).first()[0] or 1.0
    weight = F.round(power / F.lit(z), 9)
    due = F.floor(weight * F.lit(budget)).cast("long")
    plan = totals.select(F.col("source").alias("s"), "tokens", weight.alias("weight"), due.alias("due")).select(
        "s", "weight", F.expr("due div tokens").alias("passes"), (F.col("due") % F.col("tokens")).alias("rest"))
    turn = F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), "block"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    # all of the block fits, or part of it, or nothing
    room = F.coalesce(F.col("rest") - F.col("before"), F.lit(0))
    placed = placed.select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("passes", F.lit(1)).alias("passes"), room.alias("room"), (room >= F.col("n")).alias("whole"))
    rows = src.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    out = [F.col("r.*"), F.col("n").alias("n_tokens"), "weight"]
    rows = rows.withColumn("cut", ~F.col("whole") & (F.col("room") > 0))
    easy = rows.where("not cut").select(*out, (F.col("passes") + F.when(F.col("whole") & (F.col("room") > 0), 1).otherwise(0)).alias("copies"))
    running = F.sum("n").over(Window.partitionBy("s", "b").orderBy("key", "o").rowsBetween(Window.unboundedPreceding, 0))
    hard = rows.where("cut").withColumn("upto", running)
    hard = hard.select(*out, (F.col("passes") + F.when(F.col("upto") <= F.col("room"), 1).otherwise(0)).alias("copies"))
    return easy.unionByName(hard)
