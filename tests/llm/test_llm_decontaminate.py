"""Benchmark decontamination against brute force and SQL."""

import hashlib
import re

import pytest
from conftest import DATA, compare
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import decontaminate
from convolens.llm.queries import ORACLE_SQL, QUERIES

ITEMS = "item_id long, text string"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def expected(rows, items, window):
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            theirs = words(passage)
            width = min(window, len(theirs))
            spans = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)} if width else set()
            for i in range(len(own) - width + 1 if width else 0):
                if tuple(own[i : i + width]) in spans:
                    hit.update(range(i, i + width))
                    if item is not None:
                        found.add(str(item))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def cases():
    passage = prose(5, 40)
    items = [(1, passage), (2, "one"), (10, "Same-line of some LENGTH"), (3, None), (4, " .,; "), (5, passage[:60]), (None, "negative id with a"), (2, "two three"), (6, "long long"), (7, prose(1, 12))]
    rows = odd_rows() + [(30, "before " + passage + " after"), (31, passage.upper().replace("\n", " - ")), (32, " ".join(passage.split()[3:9])), (33, passage + passage)]
    return rows, items


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("window", "max_windows"), [(10, 10**6), (3, 10**6), (10, 20)])
def test_against_brute_force(spark, window, max_windows):
    rows, items = cases()
    got = decontaminate.find_contamination(table(spark, rows), table(spark, items, ITEMS), window, max_windows).drop("hits", "items")
    assert ordered(tuple(r) for r in got.collect()) == ordered(expected(rows, items, window))


def test_removal_of_documents_and_of_spans(spark):
    rows, items = cases()
    docs, bench = with_clashes(table(spark, rows)), table(spark, items, ITEMS)
    clean = [r for r, e in zip(rows, expected(rows, items, 10)) if not e[-1]]
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.dtypes == docs.dtypes
    assert ordered((r["doc_id"], r["text"]) for r in kept.collect()) == ordered(clean)
    cut = decontaminate.remove_spans(table(spark, [(1, "Keep A-B, one two! three; keep")]), table(spark, [(1, "one two three"), (2, "a b")], ITEMS), 3)
    assert cut.first()["text"] == "Keep ; keep"
    assert decontaminate.remove_spans(docs, bench).count() == len(rows)


def test_empty_tables(spark):
    rows, items = cases()
    assert decontaminate.find_contamination(table(spark, []), table(spark, items, ITEMS)).count() == 0
    assert not decontaminate.find_contamination(table(spark, rows), table(spark, [], ITEMS)).where("contaminated").count()


def test_query_against_sql(spark, duck):
    compare(QUERIES["op9_decontamination"](spark, DATA), duck, ORACLE_SQL["op9_decontamination"])


def test_an_empty_id_is_listed_and_a_null_one_is_not(spark):
    text = " ".join(f"v{k}" for k in range(12))
    items = spark.createDataFrame([("", text), ("a", text), (None, text)], "item_id string, text string")
    row = decontaminate.find_contamination(table(spark, [(1, text)]), items, max_windows=2).first()
    assert row["n_items"] == 2 and row["items"] == ["", "a"]


def test_many_passes_do_not_stack_and_agree_with_one(spark):
    rows, _ = cases()
    texts = [prose(seed, 60) for seed in range(100, 140)]
    items = [(k, t) for k, t in enumerate(texts)] + [(50, texts[3][:200])]
    rows += [(100 + k, f"start {t} end {texts[(k + 1) % 40]}") for k, t in enumerate(texts[:20])]
    docs, bench = table(spark, rows), table(spark, items, ITEMS)
    one, many = (decontaminate.find_contamination(docs, bench, max_windows=m) for m in (10**6, 700))
    assert len([b for b in decontaminate.item_blocks(bench, 10, 700) if b]) >= 8
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0  # the passes are written
    assert ordered(tuple(r)[:6] for r in many.collect()) == ordered(tuple(r)[:6] for r in one.collect()) == ordered(expected(rows, items, 10))
    cut_one, cut_many = (decontaminate.remove_spans(docs, bench, max_windows=m) for m in (10**6, 700))
    assert ordered(tuple(r) for r in cut_one.collect()) == ordered(tuple(r) for r in cut_many.collect())
