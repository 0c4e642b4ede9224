"""Small inputs that every text operator must handle, and helpers to run them."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string"
#: columns that operators use themselves, here with other meanings
CLASHING = ("h", "batch", "gone", "n_lines", "n_hit", "hits", "items", "_row", "_hits", "_items", "evidence", "host", "path", "kept", "rep", "sig", "component_id", "_gone", "key", "block", "part", "guest")


def table(spark, rows, kind=DOCS):
    return spark.createDataFrame(rows, kind)


def with_clashes(df):
    """``df`` with columns of clashing names and mixed types."""
    from pyspark.sql import functions as F

    values = [F.lit("x"), F.lit(7), F.array(F.lit(1)), F.lit(None).cast("string")]
    return df.withColumns({name: values[k % len(values)] for k, name in enumerate(CLASHING) if name not in df.columns})


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    """Invented words, some in capitals, some lines."""
    rng = random.Random(seed)
    out = []
    for _ in range(words):
        word = f"w{rng.randrange(vocabulary):x}"
        out.append(rng.choice((word, word, word.upper(), word + ",", word + "é")))
        out.append(rng.choice((" ", " ", " ", "\n", "\t")))
    return "".join(out)


def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, a lone surrogate's neighbours, a very long text."""
    return [
        (5, None),
        (6, ""),
        (7, " \t\n\n "),
        (8, "one"),
        (9, "one two three four"),
        (3, "Same line of some length\nother\n  SAME line of some length  \nshort"),
        (4, "same line of some length\nother\nsame line of some length"),
        (4, "same line of some length\nother\nsame line of some length"),
        (None, "same line of some length\nno id"),
        (None, None),
        (10, "naïve ÉCOLE \U0001f600 straße line\x0bwith\x0cfeeds\x1cand more words here"),
        (11, "long " * 60_000),
        (12, prose(1, 3000)),
        (13, prose(1, 3000)),
        (2**40, prose(2, 50)),
        (-3, "NEGATIVE id with a line of its own\r\nand the same line of some length"),
    ]
