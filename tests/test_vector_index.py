"""The index of cells against a full scan, and how little of clustered vectors it reads."""

import numpy as np
import pytest

from convolens.operators.vector_index import VectorIndex
from convolens.sources import structured


def scan(vectors, query, k):
    out = []
    for vec_id, v in vectors:
        a, b = np.array(v, float), np.array(query, float)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        out.append((-round(float(a @ b / norm) if norm else 0.0, 9), vec_id))
    return [(vec_id, -s + 0.0) for s, vec_id in sorted(out)[:k]]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6))
    rows = [(k, [float(x) for x in centres[k % 12] * rng.uniform(0.5, 2) + rng.normal(size=6) * 0.05]) for k in range(900)]
    return rows + [(1000, [0.0] * 6), (1001, [0.0] * 6), (1002, None), (1003, rows[0][1])]


def test_searches_equal_a_scan(spark, clustered, tmp_path):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    VectorIndex.build(df, str(tmp_path / "index"))
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    stored = [r for r in clustered if r[1] is not None]
    assert int(index.counts.sum()) == len(stored)
    shown = lambda rows: [(r["vec_id"], round(r["score"], 9) + 0.0) for r in rows]
    for query, k in ((clustered[5][1], 10), ([1.0, -1, 0, 0, 0, 2], 7), ([0.0] * 6, 5), (clustered[0][1], 2000)):
        found, read = index.search(query, k)
        assert shown(found.collect()) == scan(stored, query, k)
        assert read <= len(stored)
    assert index.search(clustered[5][1], 10)[1] < 0.35 * len(stored)
    queries = [(k, clustered[k][1]) for k in (1, 2, 13, 0)] + [(500, [0.0] * 6), (501, [0.3, 0.2, -0.1, 0.0, 1.0, -2.0])]
    got = {}
    for r in index.batch(spark.createDataFrame(queries, "query_id int, query array<double>"), 6).collect():
        got.setdefault(r["query_id"], []).append(r)
    for query_id, query in queries:
        assert shown(sorted(got[query_id], key=lambda r: (-round(r["score"], 9), r["vec_id"]))) == scan(stored, query, 6)


def test_no_vectors(spark):
    index = VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert index.search([1.0, 2.0], 3)[0].count() == 0


def test_structured_files_by_ending(spark, tmp_path):
    files = {"a.json": '{"x": 1}', "b.yaml": "x: [1, two]\nd: 2024-01-02\nn: null\n", "c.yml": "- 1\n", "d.toml": 'x = 1.5\nt = 2024-01-02T03:04:05\n', "e.md": "# text\n", "f.json": "{broken", "g.bin": "?"}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    from pyspark.sql import functions as F

    rows = structured.read_structured(spark, str(tmp_path / "in")).select(F.substring_index("path", "/", -1).alias("f"), F.to_json("doc").alias("j"), "reason").collect()
    got = {r["f"]: (r["j"], (r["reason"] or "").split(":")[0]) for r in rows}
    assert got == {"a.json": ('{"x":1}', ""), "b.yaml": ('{"d":"2024-01-02","n":null,"x":[1,"two"]}', ""), "c.yml": ("[1]", ""), "d.toml": ('{"t":"2024-01-02T03:04:05","x":1.5}', ""), "e.md": ('"# text\\n"', ""), "f.json": (None, "JSONDecodeError"), "g.bin": (None, "ValueError")}


def test_manifest_prunes_files(spark, tmp_path):
    for name in ("m1", "m2", "m3", "A_EXAMPLE_x", ".hidden"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "submission.json").write_text('{"model_name": "%s", "results": {"retail": {"pass_1": 1.0}}}' % name)
    assert {r["model_name"] for r in structured.submissions(spark, str(tmp_path)).collect()} == {"m1", "m2", "m3"}
    (tmp_path / "manifest.json").write_text('{"submissions": ["m1", "gone"], "voice_submissions": ["m3"]}')
    chosen = structured.submissions(spark, str(tmp_path))
    assert {r["model_name"] for r in chosen.collect()} == {"m1", "m3"}
    assert sorted(f.split("/")[-2] for f in chosen.inputFiles()) == ["m1", "m3"]
