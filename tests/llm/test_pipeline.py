"""The pipeline's stages on a small corpus, against what plain Python keeps."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() == docs.count()  # every document of the table has letters
    odd = docs.limit(3).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit("12 --")))
    assert corpus_pipeline.language(spark, docs.union(odd), sf_dir).count() == docs.count()
    from vitalspark.llm import decontaminate, minhash_dedup, secret_scan

    second = corpus_pipeline.near_dups(spark, docs, sf_dir)
    kept = {r["doc_id"] for r in minhash_dedup.op1_minhash_dedup(docs).where("kept").collect()}
    assert {r["doc_id"] for r in second.collect()} == kept and second.columns == docs.columns
    third = corpus_pipeline.benchmarks(spark, docs, sf_dir)
    hit = {
        r["doc_id"]
        for r in decontaminate.op10_decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").collect()
    }
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, third))
    assert all((before[i] != after.get(i)) == (i in hit) for i in before)
    fourth = corpus_pipeline.secrets(spark, docs, sf_dir)
    after = {r["doc_id"]: r["text"] for r in fourth.collect()}
    assert all((secret_scan.base_spans(before[i]) == []) or "[SECRET]" in after[i] for i in before)


def test_documents_without_ids_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    texts = docs.where("text is not null and doc_id is not null").orderBy(F.desc("n_chars")).limit(2)
    loose = texts.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)).withColumn(
        "text", F.concat(F.lit(passage + " "), F.col("text"), F.lit(" password=hunter22zz"))
    )
    loose = spark.createDataFrame(loose.collect() * 2, docs.schema)  # each twice
    both = docs.where("doc_id % 10 = 0").union(loose)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, both, sf_dir)
        mine = [r.asDict() for r in out.where("doc_id is null").collect()]
        assert len(mine) == 4, name
        if name == "benchmarks":
            assert all(passage not in r["text"] for r in mine)
        if name == "secrets":
            assert all("hunter22zz" not in r["text"] for r in mine)


def test_texts_of_many_languages_stay(spark):
    from vitalspark.llm import language_id

    words = {"en": "the house and water with people ", "de": "das haus und wasser mit leuten ", "fr": "la maison et cette eau avec nous "}
    rows = [(i, w * 8, k) for i, (k, w) in enumerate(words.items())]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(9, "".join(w * 8 for w in words.values()), None), (10, "12", None)], train.schema)
    assert [r["doc_id"] for r in language_id.keep_identified(mixed, language_id.learn(train.select("text", "lang"))).collect()] == [9]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert out and all(r["round_trip"] for r in out) and len({r["doc_id"] for r in out}) == len(out)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "near_dups", "benchmarks", "secrets", "pieces"
    ]
    assert hashlib.sha256(b"").hexdigest() != out[0]["decoded_sha256"]
