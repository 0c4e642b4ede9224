"""Quality classifier: held-out accuracy, shrinkage and odd inputs."""

import pytest
from llm_cases import odd_rows, table, with_clashes

from convolens.llm import quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_accuracy(spark, data):
    docs, labels = data
    learn, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.report(docs.join(test.select("doc_id"), "doc_id", "left_semi"), learn.join(docs.select("doc_id"), "doc_id", "left_semi"))
    assert judged.count()
    model = quality.fit(docs, learn)
    rows = quality.with_evidence(docs.join(test, "doc_id").select("text", "quality", "toxic"), model).collect()
    bad = [r["evidence"] >= 0.5 for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    good = [r["evidence"] < 0.5 for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    toxic = [r["evidence"] >= 0.5 for r in rows if r["toxic"] == 1]
    assert sum(bad) > 0.9 * len(bad) and sum(good) > 0.95 * len(good) and sum(toxic) > 0.9 * len(toxic)


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [("big", "a", 0.9)] * 300 + [("clean", "a", 0.02)] * 300 + [("mixed", p, 0.2) for p in "ab"] * 100 + [("rare", "a", 0.95)]
    rates, overall = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    got = {(r["host"], r["path"]): r["path_rate"] for r in rates.collect()}
    assert got["big", "a"] > 0.85 and got["clean", "a"] < 0.06
    assert abs(got["rare", "a"] - overall) < abs(0.95 - overall)


def test_odd_rows_and_clashing_columns(spark):
    docs = with_clashes(table(spark, odd_rows()))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 1), (5, None, 0), (None, 1, 1), (8, 1, 0), (99, 1, 1)], LABELS)
    kept = quality.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes
    judged = quality.report(docs, labels, host="h", path="missing").collect()
    assert len(judged) == len(odd_rows()) and all(0 <= r["posterior"] <= 1 for r in judged)
    assert {r["host"] for r in judged} == {""} and {r["path"] for r in judged} == {""}


def test_empty_tables(spark):
    empty, labels = table(spark, []), spark.createDataFrame([], LABELS)
    assert quality.report(empty, labels).count() == 0
    assert quality.keep_good(table(spark, odd_rows()), labels).count() == len(odd_rows())


def test_many_paths_are_joined_by_shuffle(spark, monkeypatch):
    docs = table(spark, odd_rows()).selectExpr("*", "cast(doc_id as string) as source", "'x' as lang")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1)], LABELS)
    wanted = sorted((str(r["doc_id"]), r["posterior"]) for r in quality.report(docs, labels).collect())
    monkeypatch.setattr(quality, "MAX_BROADCAST_PATHS", 0)
    assert sorted((str(r["doc_id"]), r["posterior"]) for r in quality.report(docs, labels).collect()) == wanted
