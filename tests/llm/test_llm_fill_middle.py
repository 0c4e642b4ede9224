"""Fill in the middle: cuts against tokens listed one by one, forms against the rule, the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import DATA, compare
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import fill_middle
from convolens.llm.queries import ORACLE_SQL, QUERIES
from convolens.llm.wavelet import WaveletMatrix


def expected(doc_id, text):
    """The row that the rule asks for, by plain Python over the listed tokens."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def marked_rows():
    """Texts that hold marks, or parts of marks at their ends."""
    rng = random.Random(3)
    texts = ["a<P>b", "x <S> y", "<M>", "<P", "S><", "a <", ">b<", "<S <P <M", "\0\0a\0", "Ω≈ç√ abc ΩZ", "a" * 70_000, " " * 70_000, "aB1" * 30_000]
    return [(100 + k, t) for k, t in enumerate(texts)] + [(200 + k, "".join(rng.choice("<>PSMab \n\U0001f600é") for _ in range(rng.randrange(40)))) for k in range(300)]


@pytest.mark.parametrize("block", [fill_middle.BLOCK, 50])
def test_rows_follow_the_rule(spark, block):
    rows = odd_rows() + marked_rows()
    got = fill_middle.fill_in_middle(with_clashes(table(spark, rows)), block=block)
    assert got.columns == ["_row", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted((str(r["_row"]["doc_id"]), tuple(r[1:])) for r in got.collect())
    assert found == sorted((str(d), expected(d, t)) for d, t in rows)
    assert len({r[1][1] for r in found}) == 3


def test_texts_are_rebuilt_from_output_and_form(spark):
    rows = odd_rows() + marked_rows()
    got = fill_middle.report(with_clashes(table(spark, rows))).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in got) == sorted((str(d), digest(t)) for d, t in rows)
    assert sorted(r["output_sha256"] for r in got) == sorted(digest(expected(d, t)[-1]) for d, t in rows)


def test_parameters_and_columns(spark):
    docs = with_clashes(table(spark, [(k, prose(k, 30)) for k in range(40)]))
    out = fill_middle.documents_out(docs, plain_from=100, spm_below=100)
    assert out.columns == docs.columns and all(r["text"].startswith("<S>") for r in out.collect())
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, plain_from=0).collect()} == {"plain"}
    assert fill_middle.report(table(spark, [])).count() == 0


def test_ranks_are_counts():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


def test_query_equals_sql(spark, duck):
    compare(QUERIES["op12_fill_in_middle"](spark, DATA), duck, ORACLE_SQL["op12_fill_in_middle"])
