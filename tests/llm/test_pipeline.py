"""The pipeline's stages on a small table, each against what it must do to its own input."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import minhash, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

here = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, gone string"
LINE = "a line of some eight words that comes again and again"


def through(spark, rows, labels, folder):
    """What each stage keeps of rows, which have two columns too many."""
    docs, kept = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], SCHEMA), {}
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs
        if name not in ("toxicity", "packing"):
            assert docs.columns == COLUMNS
    return kept


def test_odd_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, "no id here"), (1, None), (2, ""), (3, " \n\t"), (4, f"{LINE}\nand something else"), (5, f"{LINE}\nand more of it"), (6, "x"), (6, "x"), (7, long), (8, long + " end")]
    kept = {name: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in df.collect()) for name, df in through(spark, rows, [(None, None, None), (4, None, 0)], tmp_path).items() if name != "packing"}
    assert len(kept["toxicity"]) == len(rows)
    ids = [i for _, i, _ in kept["line_dedup"]]
    assert ids == [0, 4, 5, 6, 6, 7, 8] and (True, 5, "and more of it") in kept["line_dedup"]
    assert [i for _, i, _ in kept["near_dedup"]] == [0, 4, 5, 6, 6, 7] == [i for _, i, _ in kept["suffix_dedup"]]


def test_no_rows(spark, tmp_path):
    kept = through(spark, [], [], tmp_path)
    assert all(df.count() == 0 for df in kept.values())


@here
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == COLUMNS
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["toxicity"]
    bad = {r["doc_id"] for r in toxicity.scored(before, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - bad
    before, after = seen["near_dedup"]
    assert after.count() == before.count() - minhash.near_duplicates(before).where("not kept").count()
    before, after = seen["suffix_dedup"]
    long = before.where(F.octet_length("text") >= 100)
    assert after.agg(F.sum("n_chars")).first()[0] < before.agg(F.sum("n_chars")).first()[0] and long.count() > 0
    _, packs = seen["packing"]
    sums = packs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert sums.where("n > 2048 or n <> end").count() == 0


@here
def test_run(spark):
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(corpus_pipeline.run(spark, SF).columns)
