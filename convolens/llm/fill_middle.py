"""Fill-in-the-middle documents, cut at token boundaries that a wavelet matrix locates.

A token is a run of A-Z and a-z or one other code point. The code points of many texts lie in one
sequence of four classes: a letter inside a run, a letter that starts one, white space, anything else.
A wavelet matrix over the classes answers how many of each lie before a position; the ranks of the last
three classes add up to the tokens begun before it. Bisection on that count finds both cuts of all texts
at once. Nothing is listed a token, and a text of any length costs two cuts.

Forms: ``plain`` is the text; ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; ``spm`` is ``<S>``
suffix ``<P>`` prefix ``<M>`` middle. The marks do not occur in a text that is cut, and none overlaps
another, so the text can be rebuilt from output and form alone (``restored``).

Defined cases: a null text counts as empty and is plain; a null doc_id draws as the empty text does;
equal rows are cut alike; an empty table gives none; very long texts are cut whole, in a sequence of
their own; columns of any name are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from convolens.llm.common import other_columns, row_columns
from convolens.llm.wavelet import WaveletMatrix, first_reaching

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred draws, those from PLAIN_FROM on stay plain; of another hundred, those below SPM_BELOW are spm.
PLAIN_FROM, SPM_BELOW = 90, 20
SALT = "1:"
#: Code points in one wavelet matrix; a longer text has one of its own.
BLOCK = 1_000_000
INSIDE, START, SPACE, OTHER = range(4)


def _classes() -> np.ndarray:
    """The class of a code point below 128 that follows no letter; all beyond are OTHER."""
    out = np.full(129, OTHER, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[65:91] = out[97:123] = START
    return out


_CLASSES = _classes()


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The classes of texts' code points that lie behind one another, each text from one of ``starts`` on."""
    out = _CLASSES[np.minimum(points, 128)]
    letter = out == START
    inside = letter[1:] & letter[:-1]
    out[1:][inside] = INSIDE
    at = starts[starts < len(out)]
    out[at[letter[at]]] = START
    return out


def cuts(texts: list[str], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, end of prefix, end of middle) of each text, the ends in code points.

    The prefix has the smaller of ``first`` and ``second``, each modulo the number of tokens and one, as its tokens.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    matrix = WaveletMatrix(classes(points, starts), 2)

    def begun(at: np.ndarray) -> np.ndarray:
        return matrix.rank(START, at) + matrix.rank(SPACE, at) + matrix.rank(OTHER, at)

    before = begun(starts)
    tokens = begun(ends) - before
    a, b = first % (tokens + 1), second % (tokens + 1)
    found = []
    for kept in (np.minimum(a, b), np.maximum(a, b)):
        # the place behind the first code point of the next token, less one: where that token starts
        behind = first_reaching(lambda at: begun(at) - before, kept + 1, starts, ends)
        found.append(np.where(kept == tokens, ends, behind - 1) - starts)
    return tokens, found[0], found[1]


def _blocks(lengths: list[int], block: int) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, n in enumerate(lengths):
        if k > at and size + n > block:
            yield at, k
            at, size = k, 0
        size += n
    if lengths:
        yield at, len(lengths)


def _transformed(texts: list[str | None], draws: np.ndarray, plain_from: int, spm_below: int, block: int) -> list[list]:
    texts = [t or "" for t in texts]
    out: list[list] = [[], [], [], [], []]
    for low, high in _blocks([len(t) for t in texts], block):
        own = texts[low:high]
        tokens, prefix, middle = cuts(own, draws[low:high, 0], draws[low:high, 1])
        for text, n, p, m, (_, _, h3, h4) in zip(own, tokens.tolist(), prefix.tolist(), middle.tolist(), draws[low:high].tolist()):
            if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_from:
                row = n, "plain", None, None, text
            elif h4 % 100 < spm_below:
                row = n, "spm", p, m - p, f"{SUFFIX}{text[m:]}{PREFIX}{text[:p]}{MIDDLE}{text[p:m]}"
            else:
                row = n, "psm", p, m - p, f"{PREFIX}{text[:p]}{SUFFIX}{text[m:]}{MIDDLE}{text[p:m]}"
            for column, value in zip(out, row):
                column.append(value)
    return out


def draws(salt: str = SALT) -> Column:
    """The first four groups of eight hex digits of the sha256 of the salt and the decimal doc_id, as numbers."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])


def fill_in_middle(docs: DataFrame, salt: str = SALT, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, block: int = BLOCK) -> DataFrame:
    """(_row, n, form, prefix_chars, middle_chars, output) of every row; ``_row`` has all columns but ``text``."""
    rows = docs.select(other_columns(docs), "text", draws(salt).alias("draws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            drawn = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            for low, high in _blocks([len(t or "") for t in texts], 8 * block):  # what goes back is bounded too
                n, form, prefix, middle, output = _transformed(texts[low:high], drawn[low:high], plain_from, spm_below, block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    names=["_row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kinds = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]
    return rows.mapInArrow(run, StructType([rows.schema["_row"], *(StructField(name, kind) for name, kind in kinds)]))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from what ``fill_in_middle`` put out and its form."""
    middle = F.substring_index(output, MIDDLE, -1)
    body = F.substr(output, F.lit(4), F.char_length(output) - F.char_length(middle) - 6)  # without the first mark, <M> and the middle

    def halves(mark: str) -> tuple[Column, Column]:
        head = F.substring_index(body, mark, 1)
        return head, F.substr(body, F.char_length(head) + 4)

    (prefix, suffix), (late, early) = halves(SUFFIX), halves(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, middle, late)).otherwise(output)


def documents_out(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their columns, ``text`` replaced by the output."""
    return fill_in_middle(docs, **parameters).withColumnRenamed("output", "text").select(*row_columns(docs.columns))


def report(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n, form, the lengths, and digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs.select("doc_id", "text"), **parameters)
    return done.select("_row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
