"""The operators as queries over the whole test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import alignment, conversations, dedup, exact, fingerprint, language, media, mixing, pieces, quality, token_files, toxicity, warc
from turnloom.llm.common import fold, table
from turnloom.llm.registry import ORACLES, QUERIES, query
from turnloom.llm.sql import EXACT_SQL, MINHASH_SQL, MIXING_SQL, REPAIR_SQL, WARC_SQL
from turnloom.session import cut

__all__ = ["ORACLES", "QUERIES"]


@query("op1_minhash", MINHASH_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _held_out(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs.where(fold(F.col("doc_id"), 5) != 0), labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = _held_out(docs).select("doc_id", "held_out", toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(docs.where(fold(F.col("doc_id"), 3) != 1))
    got = docs.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        language.predict(profiles, F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score")


@query("op4_webp")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = cut(docs.select("doc_id", media.stored(F.col("text")).alias("s")).select("doc_id", "s.n_bytes", "s.media"))
    got = kept.select("doc_id", "n_bytes", "media", media.loaded(F.col("media"), pixels=False).alias("p"))
    return got.select(
        "doc_id", "n_bytes", F.length("p.grey").cast("long").alias("payload_bytes"), F.sha2("p.grey", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("p.grey"), -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.col("p.feature").alias("feature"))


@query("op5_id_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_ids(files, with_ids=False).drop("ids")


@query("op6_warc", WARC_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(warc.with_role(table(spark, sf_dir, "pages"), F.col("html"))))


@query("op7_pieces")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = docs.select("doc_id", pieces.encode_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("p"))
    return got.select(
        "doc_id", F.size("p.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("p.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("p.decoded"), 256).alias("decoded_sha256"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = _held_out(docs).select("doc_id", "held_out", quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op9_mixing", MIXING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, ["doc_id", "source"], mixing.token_estimate(F.col("text")))


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_exact", EXACT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op13_conversations", REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
