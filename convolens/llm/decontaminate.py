"""Benchmark decontamination: a broadcast hash set of item n-grams, scanned over word windows.

Every benchmark item becomes its windows of ``WINDOW`` consecutive words (an item of fewer words is
one window). The windows' hashes go to the executors as one sorted array; each document is read
once, as a stream of word numbers, and looks up all of its windows in it. A hash hit counts only
after the words themselves compare equal.

The hash set is broadcast only while it holds at most ``max_windows`` windows. A larger benchmark is
split into blocks by item, and each block is scanned in a pass of its own: a pass is a job that writes
the rows with hits, so that no plan holds two scans and a worker never holds two sets. The written hits
are gathered by row; what a row gathers is bounded by its words and the items found in it.

Defined cases: a null or empty text has no words and is not contaminated. A very long text is scanned
whole. An empty table of documents gives no rows, one of items no hits. An empty id is listed like any other. An item without words
has no window. Repeated items count once per distinct item_id; rows that repeat one item_id form one
item whose windows are the union. Items with a null id still mark words but are not listed. Repeated
document rows each get their own result row. Extra columns are carried along by
``remove_contaminated`` and ignored by ``find_contamination``; they may bear any name.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from convolens.llm.common import materialize, mix64, other_columns, polynomial, row_columns

WINDOW = 10
#: Windows of one broadcast. A window costs about 210 bytes in a worker, and 510 while its set is built.
MAX_WINDOWS = 1_000_000
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text that has no capital A-Z, as UTF-8 bytes
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: columns that a scan adds
HIT_FIELDS = {"n_words": LongType(), "n_hit": LongType(), "hits": ArrayType(IntegerType()), "items": ArrayType(StringType())}


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WindowSet:
    """The windows of a block of items: word numbers, and for each width the sorted hashes."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = words_of(text)
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                windows.setdefault(tuple(words[i : i + width]), set()).add(item)
        by_width: dict[int, list] = {}
        for key, owners in windows.items():
            for word in key:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            by_width.setdefault(len(key), []).append((key, owners))
        self.codes = np.array([0] + [xxhash.xxh3_64_intdigest(w) for w in self.vocabulary], np.uint64)
        self.widths = {}
        for width, entries in by_width.items():
            numbers = np.array([[self.vocabulary[w] for w in key] for key, _ in entries], np.int64)
            hashes = self._hash_rows(numbers)
            order = np.argsort(hashes, kind="stable")
            self.widths[width] = (hashes[order], numbers[order], [sorted(owner for owner in entries[k][1] if owner is not None) for k in order])

    def _hash_rows(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.uint64)
        for k in range(numbers.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.codes[numbers[:, k]]
        return mix64(out)

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur."""
        lookup = self.vocabulary.get
        numbers = np.fromiter((lookup(w, 0) for w in words), np.int64, len(words))
        hit = np.zeros(len(words) + 1, np.int64)
        found: set[str] = set()
        known = np.concatenate(([0], np.cumsum(numbers > 0)))
        for width, (hashes, rows, owners) in self.widths.items():
            if len(words) < width:
                continue
            starts = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(starts):
                continue
            values = polynomial(self.codes[numbers], width)[starts]
            low, high = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
            for start, first, last in zip(starts, low, high):
                for k in range(first, last):
                    if np.array_equal(rows[k], numbers[start : start + width]):
                        hit[start] += 1
                        hit[start + width] -= 1
                        found.update(owners[k])
        return np.cumsum(hit)[:-1] > 0, found


_BUILT: dict[str, WindowSet] = {}


def _window_set(name: str, window: int, shared) -> WindowSet:
    """The windows of a broadcast; a Python worker builds them once and keeps them for its next tasks."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WindowSet(shared.value, window)
    return _BUILT[name]


def _scan(docs: DataFrame, items: list, window: int) -> DataFrame:
    """``docs`` with the four columns of HIT_FIELDS for one block of items."""
    spark = docs.sparkSession
    shared, token = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    schema = StructType(list(docs.schema.fields))
    for name, kind in HIT_FIELDS.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _window_set(token, window, shared)
        for batch in batches:
            n_words, n_hit, hits, found_items = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hit, found = windows.scan(words)
                n_words.append(len(words))
                n_hit.append(int(hit.sum()))
                hits.append(np.flatnonzero(hit).astype(np.int32))
                found_items.append(sorted(found))
            new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *HIT_FIELDS])

    return docs.mapInArrow(run, schema)


def item_blocks(items: DataFrame, window: int, max_windows: int) -> list[list]:
    """The items in blocks of at most about ``max_windows`` windows each, by their size in characters.

    A text of c characters has at most (c + 1) / 2 words and so as many windows. One block at a time
    is held by the driver.
    """
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = sized.agg(F.sum((F.length("text") + 1) / 2).alias("n")).first()["n"] or 0
    n_blocks = int(-(-total // max_windows)) or 1
    if n_blocks == 1:
        return [[tuple(r) for r in sized.collect()]]
    # items without an id are dealt by their text
    block = F.pmod(F.xxhash64("item_id", F.when(F.col("item_id").isNull(), F.col("text"))), F.lit(2 * n_blocks))
    return ([tuple(r) for r in sized.where(block == k).collect()] for k in range(2 * n_blocks))


def scan_all(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` (_row, text) with the columns of HIT_FIELDS for all items."""
    blocks = (block for block in item_blocks(items, window, max_windows) if block)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _scan(docs, first, window)
    numbered = materialize(docs.withColumn("_id", F.monotonically_increasing_id()), "numbered-documents")
    passes: list[DataFrame] = []
    for block in itertools.chain((first, second), blocks):
        scanned = _scan(numbered.select("_id", "text"), block, window).drop("text")
        passes.append(materialize(scanned.where("n_hit > 0") if passes else scanned, "window-hits"))
    distinct = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = reduce(DataFrame.union, passes).groupBy("_id").agg(F.max("n_words").alias("n_words"), distinct("hits"), distinct("items"))
    return numbered.join(found, "_id").select("_row", "text", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``hits`` (positions of hit words) and ``items`` (ids found, sorted as strings) follow.
    """
    found = scan_all(docs.select(F.struct("doc_id").alias("_row"), "text"), items, window, max_windows)
    found = found.select("_row.doc_id", "n_words", "n_hit", "hits", "items")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "hits",
        "items",
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns."""
    kept = scan_all(docs.select(other_columns(docs), F.col("text")), items, window, max_windows).where("n_hit = 0")
    return kept.select(*row_columns(docs.columns))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All documents, the hit words cut out of their texts (from a run's first word to its last)."""
    kept = _cut(scan_all(docs.select(other_columns(docs), F.col("text")), items, window, max_windows))
    return kept.select(*row_columns(docs.columns))


def _cut(scanned: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def cut(text, hits):
        return pd.Series([t if h is None or not len(h) else cut_words(t, h) for t, h in zip(text, hits)], dtype=object)

    return scanned.withColumn("text", cut("text", "hits"))


def cut_words(text: str, hits) -> str:
    """``text`` without its words numbered ``hits``, nor what stands between two neighbouring ones."""
    data = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(data.lower())]
    out, at, k = [], 0, 0
    hits = list(hits)
    while k < len(hits):
        first = k
        while k + 1 < len(hits) and hits[k + 1] == hits[k] + 1:
            k += 1
        out.append(data[at : spans[hits[first]][0]])
        at = spans[hits[k]][1]
        k += 1
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")

