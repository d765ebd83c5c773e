import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from test_dedup import near_copies, plain_components

SF = "/root/testdata/sf0.001"


def write(spark, tmp_path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


def test_language_stage(spark, docs, edge):
    kept = cp.language_id(spark, edge, SF)
    assert kept.columns == edge.columns
    want = [r["doc_id"] for r in edge.collect() if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, want))
    assert cp.language_id(spark, docs, SF).count() == docs.count()


def test_language_stage_rejects_what_is_far_from_all_languages(spark, docs):
    rows = docs.where("length(text) > 300").select("doc_id", "text", "lang")
    far = [(-1, "жщ ъыь эюя " * 40, None), (-2, "zqxj wvkq xzjq qqzx " * 40, None), (-3, rows.where("lang = 'en'").first()["text"], None)]
    mixed = rows.unionByName(spark.createDataFrame(far, "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in cp.language_id(spark, mixed, SF).collect()}
    assert kept == {r["doc_id"] for r in mixed.collect()} - {-1, -2}
    nameless = mixed.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language_id(spark, nameless, SF).count() == nameless.count()


def test_toxicity_stage(spark, tmp_path):
    rows = [(i, f"w{i % 17} v{i % 13} u{i} end" + (" zork zork" if i % 10 == 0 else ""), "en", "a", 9) for i in range(600)]
    docs, sf_dir = write(spark, tmp_path, rows, [(i, 1, int(i % 10 == 0)) for i in range(0, 400)])
    kept = cp.toxicity_filter(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(600) if i % 10]


def test_dedup_stage(spark):
    rows = near_copies(60, 9)
    kept = cp.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = {c if c != "None" else d for d, n, c in plain_components(rows, 5)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(map(int, want))


def test_mixing_stage(spark, edge, none):
    out = cp.mix_sources(spark, edge, SF)
    assert out.columns == edge.columns and out.schema.simpleString() == edge.schema.simpleString()
    rows = {tuple(r) for r in edge.collect()}
    assert {tuple(r) for r in out.collect()} <= rows
    assert cp.mix_sources(spark, none, SF).count() == 0


def test_last_stage(spark, edge):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted((str(r["doc_id"]), r["ids"], r["n_tokens"]) for r in cp.token_ids(spark, edge, SF).collect())
    want = [(str(r["doc_id"]), sp.encode(r["text"] or "")) for r in edge.collect()]
    assert got == sorted((d, ids, len(ids)) for d, ids in want)


def test_empty_tables_pass_every_stage(spark, none):
    docs = none
    for name, stage in cp.STAGES:
        docs = stage(spark, none, SF)
        assert docs.count() == 0, name


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and 0 < out.count() < 260


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_like_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    cur = con.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    norm = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == names
    assert sorted(tuple(norm(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name,held,least", [("op3_language", "lang_pred", 0.97)])
def test_held_out_accuracy(spark, name, held, least):
    sf_dir = "/root/testdata/sf0.01"
    got = entry.queries()[name](spark, sf_dir).where("held_out")
    both = got.join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col(held) == F.col("lang")).cast("double"))).first()[0] >= least


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = entry.queries()["op8_quality"](spark, sf_dir).where("held_out")
    both = got.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    assert both.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] >= 0.9
