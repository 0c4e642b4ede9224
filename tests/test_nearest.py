"""Batched nearest vectors, by blocked products, against the scan with Spark's own sums."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.operators import nearest, retrieval, vector_index


def scan(vectors, queries, k):
    scored = vectors.crossJoin(queries).select("query_id", "vec_id", retrieval.cosine(F.col("embedding"), F.col("query")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return sorted(map(repr, scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n").collect()))


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Copies, near copies, one very common vector, scaled ones, and rows that have no cosine."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 7))
    rows = [(k, [float(x) for x in base[k % 60] * (1 if k < 300 else k) + (k % 3 == 0) * 1e-9 * rng.normal(size=7)]) for k in range(900)]
    rows += [(1000 + k, rows[5][1]) for k in range(200)] + [(None, rows[5][1]), (7, rows[5][1])]
    rows += [(2000, None), (2001, [0.0] * 7), (2002, [1.0, 2.0]), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0, 1.0]), (2004, [float("nan")] * 7), (2005, [1e-200] * 7), (2006, [1e200] * 7), (2007, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_batch_equals_a_scan(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS", 50)
    asked = odd_vectors.where("vec_id % 50 = 5 or vec_id >= 2000 or vec_id is null or vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = retrieval.cosine_batch(odd_vectors, asked, 5, 3)
    assert sorted(map(repr, got.collect())) == scan(odd_vectors, asked, 5)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()  # no row for each pair


def test_other_kinds_of_ids(spark):
    rows = [(x, [1.0, float(k % 3)]) for k, x in enumerate(("b", "a", None, "ß", "ab", "c", "B"))]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 1.0]), ("r", [0.5, 0.0]), (None, None)], "query_id string, query array<float>")
    assert sorted(map(repr, retrieval.cosine_batch(vectors, asked, 3).collect())) == scan(vectors, asked, 3)
    assert retrieval.cosine_batch(vectors.limit(0), asked, 3).count() == retrieval.cosine_batch(vectors, asked.limit(0), 3).count() == 0


def test_work_of_one_task_is_products():
    """Twenty thousand vectors against a thousand queries: no time for each pair."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(20_000, 16))
    best = nearest.Nearest(vectors[::20], 3)
    best.add(pa.array(np.arange(20_000)), vectors)
    assert (best.ids[:, 0] == np.arange(0, 20_000, 20)).all()
    scores = (vectors[:200:20] @ vectors.T) / np.outer(*(np.linalg.norm(x, axis=1) for x in (vectors[:200:20], vectors)))
    assert np.allclose(best.score[:10], -np.sort(-scores, axis=1)[:, :3])


def test_indexed_batch_equals_a_scan(spark, monkeypatch, tmp_path):
    """Blocks of queries, ties among copies, a crowded cell, rows without length; no row for each pair, no file for each cell."""
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=5)]) for k in range(700)]
    rows += [(1000 + k, rows[k % 9][1]) for k in range(200)] + [(2000 + k, [0.0] * 5) for k in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 15)
    index = vector_index.VectorIndex.build(vectors, str(tmp_path / "index"))
    got = index.batch(asked, 6)
    assert sorted(map(repr, got.collect())) == scan(vectors, asked, 6)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert len(index.vectors.inputFiles()) <= 4 < len(index.cells)
