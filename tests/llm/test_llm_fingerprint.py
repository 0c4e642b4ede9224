"""Fingerprints: edited texts, order, equal texts and likeness."""

import hashlib

import numpy as np
import pytest
from conftest import DATA
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import fingerprint


def edits(rows):
    """doc_id, n_chars and edited_sha256 in order of doc_id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_each_row_meets_its_next(spark, parts):
    rows = odd_rows() + [(100 + 3 * k, prose(k, 40 + k)) for k in range(30)]
    got = fingerprint.fingerprints(with_clashes(table(spark, rows)), parts).collect()
    assert ordered((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == ordered(edits(rows))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_doc = {r["doc_id"]: r for r in got}
    assert by_doc[12]["fingerprint"] == by_doc[13]["fingerprint"] and by_doc[12]["near_next"] == 1
    assert by_doc[5]["fingerprint"] == by_doc[6]["fingerprint"] == ""


def test_one_row_and_no_row(spark):
    row = fingerprint.fingerprints(table(spark, [(1, "abcd" * 50)])).first()
    assert row["near_next"] == 1.0
    assert fingerprint.fingerprints(table(spark, [])).count() == 0


def test_near_texts_stand_apart_from_others(spark):
    got = fingerprint.fingerprints(spark.read.parquet(f"{DATA}/documents.parquet")).where("n_chars > 400").collect()
    assert np.mean([r["near_edited"] > r["near_next"] or r["near_next"] > 0.6 for r in got]) > 0.98
    assert np.median([r["near_edited"] for r in got]) > 0.5 and np.median([r["near_next"] for r in got]) < 0.2


def test_levels_equal_the_entropy_of_each_window():
    data = np.frombuffer(prose(3, 300).encode(), np.uint8)
    got = fingerprint.entropy_levels(data)
    for at in range(0, len(got), 37):
        n = np.bincount(data[at : at + fingerprint.WINDOW])
        p = n[n > 0] / fingerprint.WINDOW
        assert abs(got[at] - (-(p * np.log2(p)).sum()) * 255 / 5) <= 0.5001


def test_long_texts_give_the_same_features_in_portions(monkeypatch):
    data = np.frombuffer(prose(3, 4000).encode(), np.uint8)
    ranks = fingerprint.rarity_ranks(list(range(256)))
    whole = fingerprint.features(data, ranks)
    monkeypatch.setattr(fingerprint, "_STEP", 1000)
    assert len(set(whole) & set(fingerprint.features(data, ranks))) > 0.8 * len(whole)


def test_digests_can_be_written_and_read():
    chain = fingerprint.filters(np.arange(1, 300, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = fingerprint.decode(fingerprint.encode(chain))
    assert [n for n, _ in again] == [128, 128, 43] and fingerprint.likeness(chain, again) == 1.0
