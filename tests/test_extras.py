"""Operators whose queries SQL cannot express, and their odd inputs."""

import pytest
from pyspark.sql import functions as F

from convolens.functions import arithmetic, text
from convolens.operators import breakdown, lookups, retrieval, transcripts, voice_events
from convolens.plans import extras


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize(("written", "value"), [("1 + 2*3", 7.0), ("-(2.5)/2", -1.25), ("10/3", 3.33), ("1/0", None), ("2**9", None), ("__import__('os')", None), ("", None), (None, None), ("1 +", None), ("(" * 900, None), ("1_000", None)])
def test_calculator(written, value):
    assert arithmetic.calculate(written) == value


def test_calculator_column(spark):
    df = spark.createDataFrame([("1+1",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(arithmetic.calculated("t")).collect()] == [2.0, None, None]


def test_utterance_groups(spark):
    df = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["b"]), (1, 3, ["c"]), (1, 4, None), (1, 5, ["c"]), (2, 0, []), (None, 0, ["a"]), (None, 1, ["b"])], "simulation_id long, pos int, ids array<string>")
    assert rows(transcripts.utterance_groups(df), "simulation_id", "pos") == [(None, 0, 0), (None, 1, 1), (1, 0, 0), (1, 1, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2), (1, 5, 2), (2, 0, 0)]


def test_slices_cover_the_text(spark):
    df = spark.createDataFrame([("",), ("abcdefghijk",), (None,)], "t string")
    got = [r[0] for r in df.select(transcripts.slices(F.col("t"), [1, 2, 4])).collect()]
    assert got[0] == ["", "", ""] and "".join(got[1]) == "abcdefghijk"
    assert [len(x) for x in got[1]] == transcripts.cut_lengths(11, [1, 2, 4])


def test_results_without_calls(spark):
    calls = spark.createDataFrame([(1, 10, 5, 3)], "simulation_id int, call int, call_id int, at int")
    results = spark.createDataFrame([(1, 20, 5, 4), (1, 21, 9, 4), (1, 22, 5, 2), (2, 23, 5, 9)], "simulation_id int, result int, call_id int, at int")
    assert rows(transcripts.pair_results(calls, results).select("result", "call", "how"), "result") == [(20, 10, "id"), (21, 10, "nearest"), (22, None, None), (23, None, None)]


def test_effects_of_each_kind_are_segments_of_their_own(spark):
    df = spark.createDataFrame([(1, t, e) for t, e in enumerate(["x", "x", "y", "x", None, "x"])], "simulation_id int, tick int, effect string")
    assert rows(voice_events.effect_segments(df, "effect"), "effect", "start_tick") == [(1, "x", 0, 2, 2), (1, "x", 3, 4, 1), (1, "x", 5, 6, 1), (1, "y", 2, 3, 1)]


def test_unknown_costs_make_sums_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", None, None), ("b", 2.0, None), ("b", 3.0, None)], "k string, cost double, tokens int")
    assert rows(breakdown.message_costs(df, ["k"]), "k") == [("a", None, 5), ("b", 5.0, None)]


def test_batches_of_queries_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "vec_id int, embedding array<double>")
    queries = df.selectExpr("vec_id as query_id", "embedding as query")
    assert rows(retrieval.cosine_batch(df, queries, 1), "query_id") == [(1, 1, 1.0), (2, 1, 0.0)]
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 1)
    with pytest.raises(ValueError):
        retrieval.cosine_batch(df, queries, 1)


def test_more_queries_than_one_batch_go_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, [1.0, float(k % 7), float(k % 5)]) for k in range(40)], "vec_id int, embedding array<double>")
    queries = df.selectExpr("vec_id as query_id", "embedding as query")
    wanted = rows(retrieval.cosine_batch(df, queries, 3), "query_id", "vec_id")
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 9)
    assert rows(retrieval.cosine_batches(df, queries, 3), "query_id", "vec_id") == wanted and len(wanted) == 120
    repeated = queries.unionByName(queries.where("query_id < 3")).withColumn("query_id", F.lit(7))
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 50)
    wanted = rows(retrieval.cosine_batch(df, repeated, 5), "vec_id")
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 9)
    assert rows(retrieval.cosine_batches(df, repeated, 5), "vec_id") == wanted
    # the registered query itself, past the bound: it raised before
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 1)
    vectors = spark.createDataFrame([(k * 100, [1.0, float(k)]) for k in range(4)], "vec_id int, embedding array<double>")
    monkeypatch.setattr(extras, "_t", lambda *_: vectors)
    assert extras.cosine_batch(spark, "").count() == 16


def test_titles_come_before_ids(spark):
    docs = spark.createDataFrame([(1, "2"), (2, "x"), (3, "x")], "id int, title string")
    asked = spark.createDataFrame([("2",), ("x",), ("3",), ("none",), (None,)], "request string")
    assert rows(lookups.by_title_then_id(asked, docs), F.asc_nulls_last("request")) == [("2", 1, "title"), ("3", 3, "id"), ("none", None, None), ("x", 2, "title"), (None, None, None)]


def test_fenced_json(spark):
    df = spark.createDataFrame([("a ```json\n{}\n``` b",), (" [1] ",), ("```\n2```",)], "t string")
    assert [r[0] for r in df.select(text.fenced_json(F.col("t"))).collect()] == ["{}", "[1]", "2"]
