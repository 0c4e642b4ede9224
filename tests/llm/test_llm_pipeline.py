"""The pipeline's stages, each on what its predecessor kept, and the registered queries."""

import re

from conftest import DATA
from llm_cases import odd_rows, table, with_clashes
from test_llm_near_dedup import expected as groups

import __spark_entry__
import corpus_pipeline
from convolens.llm import queries


def test_each_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, kinds = [], docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), "test-stage")
        assert docs.dtypes == kinds, name
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    judged, lined, near, clean = kept
    assert 0 < len(judged) < 200 and set(lined) == set(judged) and set(clean) <= set(near) <= set(lined)
    assert set(near) == {d for d, _, _, stays in groups(sorted(lined.items())) if stays}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in pieces} == set(clean)
    fill = {}
    for r in pieces:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) / 2048 * 1.05 + 1


def test_stages_take_nulls_ties_and_repeated_rows(spark):
    """Odd rows with clashing columns go through every stage; an empty table comes out empty."""
    labels = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = with_clashes(labels.limit(60).unionByName(table(spark, odd_rows())))
    for rows in (docs, docs.limit(0)):
        kinds, at = rows.dtypes, rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = corpus_pipeline.materialize(stage(spark, at, DATA), "test-odd")
            assert at.dtypes == kinds, name
        left = at.count()
        pieces = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
        assert pieces.where("piece = 0").count() == left and (left > 0) == (rows is docs)
