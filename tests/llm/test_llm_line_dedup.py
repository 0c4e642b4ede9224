"""Line dedup against brute force and SQL."""

import hashlib

import pytest
from conftest import DATA, compare
from llm_cases import odd_rows, prose, table, with_clashes
from pyspark.sql import functions as F

from convolens.llm import line_dedup
from convolens.llm.queries import ORACLE_SQL, QUERIES

SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(rows):
    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(SPACE))
            if doc is not None and len(key) >= 10:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or first.get(lower(x.strip(SPACE)), doc) >= doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 3), (9, 2)])
def test_against_brute_force(spark, batches, fanout):
    rows = odd_rows() + [(20 + k, "\n".join(prose(k % 7, 30).split("\n")[: k % 9 + 1])) for k in range(60)]
    wanted = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in expected(rows)]
    got = line_dedup.line_report(table(spark, rows), batches=batches, fanout=fanout)
    assert ordered(tuple(r) for r in got.collect()) == ordered(wanted)


def test_rows_and_clashing_columns_stay(spark):
    rows = odd_rows()
    docs = with_clashes(table(spark, rows))
    kept = line_dedup.dedup_lines(docs)
    assert kept.dtypes == docs.dtypes
    wanted = [(d, t if x is None and not t else t) for (d, x), (_, _, _, t) in zip(rows, expected(rows))]
    assert ordered((r["doc_id"], r["text"] or "") for r in kept.collect()) == ordered(wanted)
    assert {r["batch"] for r in kept.collect()} == {7}


def test_empty_table(spark):
    assert line_dedup.line_report(table(spark, [])).count() == 0


def test_a_line_that_all_documents_hold(spark):
    rows = [(k, f"a line that all hold\n{prose(k % 11, 5)}\na line that all hold") for k in range(50)]
    wanted = [(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in expected(rows)]
    got = line_dedup.line_report(table(spark, rows), batches=3)
    assert ordered(tuple(r) for r in got.collect()) == ordered(wanted)


def new_rows(spark, *keys):
    return spark.createDataFrame([(bytes([k]), k) for k in keys], "h binary, first_doc long").repartition(4, "h")


def test_runs_are_compacted(spark):
    runs = line_dedup.SortedRuns(spark, fanout=2)
    for k in range(4):
        assert [r["seen"] for r in runs.add(new_rows(spark, k)).collect()] == [None]
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert sorted(r["first_doc"] for run in runs.runs() for r in run.collect()) == [0, 1, 2, 3]
    assert {r["first_doc"]: r["seen"] for r in runs.add(new_rows(spark, 2, 9)).collect()} == {2: 2, 9: None}


def test_runs_are_merged_as_they_lie(spark):
    runs = line_dedup.SortedRuns(spark, fanout=3)
    for k in range(2):
        runs.add(new_rows(spark, k))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    own = new_rows(spark, 0, 1, 2).groupBy("h").agg(F.min("first_doc").alias("first_doc"))
    plan = runs.find(own)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("Exchange") == 1  # the rows of the test itself
    assert plan.count("Sort [") == 1


def test_query_against_sql(spark, duck):
    compare(QUERIES["op4_line_dedup"](spark, DATA), duck, ORACLE_SQL["op4_line_dedup"])
