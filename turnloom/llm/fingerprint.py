"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

Terms are the words between white space, weighted by how often they occur.  For
each of ``SAMPLES`` samples a term of weight S has draws that depend on term and
sample alone: r and c from Gamma(2, 1) and b from [0, 1).  They give
``t = floor(ln S / r + b)`` and ``a = c * exp(-r * (t - b + 1))``; the sample is the
(term, t) with the smallest a.  Two texts agree in a sample with the probability
of their generalised Jaccard similarity, sum of smaller over sum of larger
weights.

The draws are made through what sums of exponential numbers share: r (1 - b) and
r b are two such numbers, -ln v and -ln w of even v and w; and c v is one too, e,
while c (1 - v) is another, f.  So with e and f drawn, ``v = e / (e + f)``, and with
``q = v w``, a is ``e * q ** t``, where t is the first number with ``S v q ** t < 1``.
The rank of a is ``1 - exp(-a)``, which is even again: a term that occurs once has
t = 0 and the bits of its hash as rank, without any arithmetic.  Rank and
identity of a sample are packed into one long, so that a fingerprint is a plain
minimum per text in a hash aggregate.  Four hexadecimal digits per sample make
the fingerprint.

``fingerprints`` also edits each text: its last floor(n/2) code points give way
to the first as many (or all) of the next document in descending doc_id order;
the first document follows the last.  Rows are laid out in blocks of
consecutive ids, whose borders are ids of the table; the first row of a block
is copied into the block before it, so a window never spans more than a block.

Cases: null counts as the empty text, whose one term is the empty word, which
also stands between two blanks; null
ids come last in the order; rows of one id are ordered by text.  A table of one
row is followed by itself.  Other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut

SAMPLES = 64
DIGITS = 4
_NO_ID = -(2**63)


def _even(bits: Column, n: int) -> Column:
    """A number between 0 and 1 from the lowest ``n`` bits of a hash."""
    return (bits.bitwiseAND(F.lit((1 << n) - 1)) + 0.5) * F.lit(2.0**-n)


def _sample(h: Column, s: Column, ln_s: Column, name: Column, k: int) -> Column:
    """Rank (31 bits) and identity of sample ``k`` of a term as one long; the smallest wins."""
    bits, more = F.xxhash64(h, F.lit(k)), F.xxhash64(h, F.lit(k + 1000))
    first = F.shiftrightunsigned(bits, 33)
    pack = lambda rank, t: F.shiftleft(rank, 32).bitwiseOR(name).bitwiseOR(t)
    once = pack(first, F.lit(0))
    e = -F.ln(1 - _even(first, 31))
    f = -F.ln(_even(bits, 31))
    v, w = e / (e + f), _even(more, 31)
    q, x = v * w, s * v
    even = lambda a: (-F.expm1(-a) * F.lit(float((1 << 31) - 1))).cast("long")
    t = F.floor((F.ln(w) - ln_s) / F.ln(q))
    often = F.when((s - 1) * e < f, once).when(x * q < 1, pack(even(e * q), F.lit(1))).otherwise(
        pack(even(e * F.exp(F.ln(q) * t)), t.bitwiseAND(F.lit(63))))
    return F.when(s == 1, once).otherwise(often)


def weighted_samples(terms: DataFrame, keys: list[str], term: Column, samples: int = SAMPLES) -> DataFrame:
    """keys, fingerprint from one row per occurrence of a term."""
    weighted = terms.select(*keys, F.xxhash64(term).alias("_h")).groupBy(*keys, "_h").agg(F.count("*").alias("_s"))
    name = F.shiftleft(F.col("_h").bitwiseAND(F.lit((1 << 26) - 1)), 6)
    weighted = weighted.select(*keys, "_h", F.col("_s").cast("double").alias("_s"), F.ln(F.col("_s")).alias("_l"), name.alias("_n"))
    least = weighted.groupBy(*keys).agg(
        *[F.min(_sample(F.col("_h"), F.col("_s"), F.col("_l"), F.col("_n"), k)).alias(f"_{k}") for k in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.hash(F.col(f"_{k}").bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(16**DIGITS - 1)))), DIGITS, "0")
              for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def _blanks(text: Column) -> Column:
    """The text with a blank for each other white space character."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints."""
    place = F.sequence(F.lit(1), F.lit(samples * DIGITS), F.lit(DIGITS))
    same = F.filter(place, lambda i: F.substring(a, i, F.lit(DIGITS)) == F.substring(b, i, F.lit(DIGITS)))
    return F.size(same) / F.lit(float(samples))


def _blocks(docs: DataFrame, count: int) -> tuple[DataFrame, int]:
    """Rows with ``block`` and ``halo``: 1 on the copy of the next block's first row."""
    shares = [i / count for i in range(1, count + 1)]
    found = docs.agg(F.percentile_approx("key", shares, max(10_000, 10 * count)).alias("q")).first()["q"]
    bounds = sorted(set(found or [0]))
    n, width = len(bounds), int(len(bounds) ** 0.5) + 1
    # two steps: the stretch of bounds, then the place in it
    far, near = F.lit(bounds[width - 1 :: width] or [bounds[-1]]), F.lit(bounds)
    stretch = F.size(F.filter(far, lambda x: x < F.col("key"))) * width
    block = F.least(stretch + F.size(F.filter(F.slice(near, stretch + 1, width), lambda x: x < F.col("key"))), F.lit(n - 1))
    own = docs.withColumn("_b", block)
    first = F.col("key") == near.getItem(F.col("_b"))
    place = lambda b, halo: F.struct(b.cast("int").alias("block"), F.lit(halo).alias("halo"))
    spots = F.when(first, F.array(place(F.col("_b"), 0), place((F.col("_b") + 1) % n, 1))).otherwise(F.array(place(F.col("_b"), 0)))
    return own.withColumn("_p", F.explode(spots)).select("key", "text", "_p.block", "_p.halo"), n


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, n = _blocks(src, blocks)
    order = Window.partitionBy("block").orderBy("halo", F.desc("key"), "text")
    rows = rows.repartition(blocks, "block")
    rows = rows.select(
        "block", "halo", "key", "text", F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next"), F.lead("halo").over(order).alias("last")).where("halo = 0")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), F.substring(F.col("next"), F.lit(1), half))
    last = F.col("last") == 1
    meta = rows.select(
        "block", "place", F.when(F.col("key") != _NO_ID, F.col("key")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        F.when(last, (F.col("block") + (n - 1)) % n).otherwise(F.col("block")).alias("next_block"),
        F.when(last, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"))
    # texts of a block are numbered: a document's own text 2 * place, its edited text one more
    both = F.array(F.struct((F.col("place") * 2).alias("no"), F.col("text").alias("t")), F.struct((F.col("place") * 2 + 1).alias("no"), edited.alias("t")))
    texts = rows.select("block", F.explode(both).alias("v"))
    words = texts.select("block", F.col("v.no").alias("no"), F.explode(F.split(_blanks(F.col("v.t")), " ")).alias("w"))
    prints = weighted_samples(words, ["block", "no"], F.col("w"), samples)
    prints = prints.groupBy("block", F.expr("no div 2").cast("int").alias("place")).agg(
        F.max(F.when(F.col("no") % 2 == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("no") % 2 == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    full = cut(meta.join(prints, ["block", "place"]))
    after = full.select(F.col("block").alias("next_block"), F.col("place").alias("next_place"), F.col("fingerprint").alias("_after"))
    return full.join(after, ["next_block", "next_place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_after"), samples).alias("near_next"))
