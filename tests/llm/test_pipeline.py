"""Every stage of the pipeline on its own input, against what its operator says."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from hindcast.llm.jaccard_join import jaccard_components
from hindcast.llm.mixing import mix
from hindcast.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(after.columns == C.COLUMNS for _, _, after in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.filter("quality = 1 AND toxic = 0").select("doc_id").distinct()
    assert after.join(good, "doc_id", "left_semi").count() >= 0.9 * before.join(good, "doc_id", "left_semi").count()
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    assert after.join(bad, "doc_id", "left_semi").count() <= 0.5 * before.join(bad, "doc_id", "left_semi").count()


def test_one_document_of_each_group(stages):
    _, before, after = stages[1]
    want = {r[0] for r in jaccard_components(before, 5, 80).select("component_id").distinct().collect()}
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(want)


def test_no_personal_data_is_left(stages):
    _, before, after = stages[2]
    assert before.count() == after.count()
    assert not [r for r in after.collect() if base_spans(r["text"] or "")]
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_mixing_takes_its_copies(stages):
    _, before, after = stages[3]
    want = {r["doc_id"]: r["copies"] for r in mix(before).filter("copies > 0 AND size > 0").collect()}
    assert collections.Counter(r[0] for r in after.select("doc_id").collect()) == want


def test_packing_places_every_document(stages):
    _, before, after = stages[4]
    assert collections.Counter(r[0] for r in after.filter("piece = 0").select("doc_id").collect()) == collections.Counter(r[0] for r in before.select("doc_id").collect())
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
