"""From raw documents to token ids: five stages, each a DataFrame job over all rows the one before kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents.  All but the last return the columns
of the documents they got.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import dedup, language, mixing, pieces, toxicity
from turnloom.llm.common import table
from turnloom.session import cut, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: a text without a letter goes, and one too far from all languages.

    Profiles are learned from all documents of the stage that name a language.
    How far is too far is told per language by all of these
    (``language.loosest_scores``): the share ``language.REJECT`` of their texts
    that lie farthest goes.  Every text is scored once, into a table that both
    the limits and the rows that stay are taken from.  Without any document
    that names a language all stay; null and empty texts go, repeated rows go or
    stay together, and other columns are not touched.
    """
    profiles = language.learn_profiles(docs)
    if not profiles:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    scored = cut(docs.select(row, language.predict(profiles, F.col("text")).alias("_found")))
    low = language.loosest_scores(scored.select(F.xxhash64(F.col("_doc.text").cast("string")).alias("text_hash"), "_doc.lang", "_found.lang_pred", "_found.score"))
    least = F.coalesce(F.create_map(*[F.lit(x) for pair in low.items() for x in pair])[F.col("_found.lang_pred")], F.lit(0.0)) if low else F.lit(0.0)
    return scored.where((F.col("_found.lang_pred") != language.UNKNOWN) & (F.col("_found.score") >= least)).select("_doc.*")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5.

    Null and empty texts score the bias alone, which stays below 0.5 where
    nothing could be learned; repeated rows go or stay together, and other
    columns are not touched.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more.

    The smallest doc_id stays (null ids last); of repeated rows one stays.
    Texts without words are no duplicates of anything and all stay.
    """
    return dedup.one_of_each(docs, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as before, dealt to the sources by temperature; a document drawn several times is repeated.

    Null sources are a source of their own; null and empty texts have no tokens
    and stay; ties of id are dealt by text.  An empty table stays empty.
    """
    got = mixing.mixed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", "text"),
                       ["doc"], mixing.token_estimate(F.col("text")), order=["text"])
    return got.where("copies > 0").select("doc", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("pass")).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their number and the hash of what decoding gives back.

    A null text counts as empty and has no ids; repeated rows each give one.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = docs.select("doc_id", pieces.encode_decode(F.col("text"), path).alias("p"))
    return got.select("doc_id", F.col("p.ids").alias("ids"), F.size("p.ids").cast("long").alias("n_tokens"),
                      F.sha2(F.col("p.decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("minhash_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the learned filters nor the vocabulary; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/corpus_pipeline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
