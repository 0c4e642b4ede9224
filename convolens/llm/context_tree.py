"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each in a node: the bits of the byte decided so far. For every node
and every context of the 0 to ``DEPTH`` bytes before, Krichevsky-Trofimov estimates are kept. Context-
tree weighting mixes all depths: a context's weighted probability of what it has seen is half its own
estimate and half the product over its longer contexts, and the posterior weights that follow give the
mixture that predicts. What remains of the weight at the longest context seen in training goes to it.

The corpus work is joins and grouped sums:

1. Documents are dealt into blocks. A block lists its distinct runs of DEPTH + 1 bytes with their counts
   in training documents, and likewise its distinct words.
2. Runs are summed over blocks. Their trees are weighted bottom-up, the three deepest levels by buckets
   of whole depth-3 contexts (a bounded number of runs each), the upper ones by grouped sums of
   contexts of at most two bytes. Top-down weights then give each distinct run its log probability.
3. The values go back to the blocks that asked for them, by join, and the blocks score their documents.

A block asks once for a run however often it occurs, so that what is shuffled follows the distinct runs
of blocks, not the corpus; no table of runs or words is broadcast or held whole.

Texts are scored as lower-cased (A-Z) bytes with an end symbol; the start is five zero bytes of context.
Documents whose crc32(doc_id as text) mod 5 is 1 are held out. Words are known by 64-bit hashes: two of a
billion words share one with a chance of about 3 %, and then pool their counts.

Defined cases: a null text is empty: only its end is scored. A very long text is scored whole, alone
in a portion. A null doc_id is a training document. Rows that repeat a doc_id each count and get a row. Without training documents every byte has probability
1/256 and the base score is 0. An empty table gives no rows. Extra columns of any name are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import discard, materialize, parallelism

DEPTH = 5
#: Bytes of text in a block, and those worked on at a time.
BLOCK_BYTES = 24_000_000
STEP_BYTES = 2_000_000
#: A small table has fewer blocks than cores rather than blocks below this: each block lists its runs anew.
LEAST_BLOCK_BYTES = 4_000_000
#: Values of runs travel as whole numbers of this part of a decimal digit.
PRECISION = 1e-7
#: Distinct runs in a bucket of depth-3 contexts.
BUCKET_RUNS = 200_000
FOLDS, HELD_OUT = 5, 1
END_WORD = 0
_LOG10 = math.log(10)


# --- numbers -----------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma of x > 0, by Stirling's series at x + 7."""
    shift = np.ones_like(x, dtype=np.float64)
    for k in range(7):
        shift = shift * (x + k)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _log_gamma_column(x: Column) -> Column:
    shift = x
    for k in range(1, 7):
        shift = shift * (x + k)
    z = x + 7
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def _log_kt_column(n0: Column, n1: Column) -> Column:
    return _log_gamma_column(n0 + 0.5) + _log_gamma_column(n1 + 0.5) - _log_gamma_column(n0 + n1 + 1.0) - math.log(math.pi)


# --- blocks ------------------------------------------------------------------------------------


def dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, doc_id, held_out, z): documents with their lower-cased bytes, compressed for the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [squeeze((t or "").encode("utf-8", "surrogatepass").lower()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["block", "doc_id", "held_out", "z"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return rows.mapInArrow(run, "block int, doc_id long, held_out boolean, z binary")


def steps(zs: list[bytes], flags: list[bool]) -> Iterator[tuple[list[bytes], list[bool]]]:
    """The documents' bytes in portions of about STEP_BYTES."""
    expand = zstandard.ZstdDecompressor().decompress
    texts, held, size = [], [], 0
    for z, flag in zip(zs, flags):
        text = expand(z)
        texts.append(text)
        held.append(flag)
        size += len(text)
        if size >= STEP_BYTES:
            yield texts, held
            texts, held, size = [], [], 0
    if texts:
        yield texts, held


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(runs, lengths): all runs of DEPTH + 1 bytes of the texts, one for each byte and for the end."""
    pad = bytes(DEPTH)
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    values = np.zeros(len(data) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        values = (values << 8) | data[k : k + len(values)]
    at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(texts)) * DEPTH, lengths)
    return values[at], lengths


def hash_words(words) -> list[int]:
    """64-bit hashes of words, as signed numbers that are not END_WORD."""
    return [(xxhash.xxh3_64_intdigest(w) or 1) - (1 << 63) or 1 for w in words]


def block_counts(table: pa.Table) -> pa.Table:
    """(block, word, key, n): a block's distinct runs and words, with their counts in training documents."""
    block = table.column("block")[0].as_py()
    keys, counts, words = np.empty(0, np.int64), np.empty(0, np.int64), Counter()
    for texts, held in steps(table.column("z").to_pylist(), table.column("held_out").to_pylist()):
        values, lengths = runs_of(texts)
        training = np.repeat(~np.array(held), lengths)
        for part, weight in ((values[training], 1), (values[~training], 0)):
            found, n = np.unique(part, return_counts=True)
            keys, counts = np.concatenate((keys, found)), np.concatenate((counts, n * weight))
        keys, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, counts, len(keys)).astype(np.int64)
        for text, flag in zip(texts, held):
            own = text.split()
            if flag:
                words.update(dict.fromkeys(own, 0))
            else:
                words.update(own)
    hashes, n = hash_words(words), list(words.values())
    trained = sum(not f for f in table.column("held_out").to_pylist())
    return pa.table(
        {
            "block": pa.array(np.full(len(keys) + len(n) + 1, block, np.int32)),
            "word": pa.array(np.arange(len(keys) + len(n) + 1) >= len(keys)),
            "key": pa.array(np.concatenate((keys, np.array([*hashes, END_WORD], np.int64)))),
            "n": pa.array(np.concatenate((counts, np.array([*n, trained], np.int64)))),
        }
    )


# --- trees -------------------------------------------------------------------------------------


def _nodes(contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, n0, n1, place of each run's eight decisions): key = context * 256 + node."""
    bits = np.arange(8)
    node = (1 << bits) | (symbols[:, None] >> (8 - bits))
    bit = (symbols[:, None] >> (7 - bits)) & 1
    keys, place = np.unique(contexts[:, None] * 256 + node, return_inverse=True)
    place = place.reshape(-1, 8)
    weights = np.repeat(n, 8).astype(np.float64)
    ones = np.bincount(place.reshape(-1), weights * bit.reshape(-1), len(keys))
    return keys, np.bincount(place.reshape(-1), weights, len(keys)) - ones, ones, place


class DeepLevels:
    """The levels 3 to DEPTH of whole depth-3 contexts."""

    def __init__(self, runs: np.ndarray, n: np.ndarray):
        self.symbols = runs & 0xFF
        self.levels = []
        for depth in range(DEPTH, 2, -1):
            contexts = (runs >> 8) & ((1 << (8 * depth)) - 1)
            self.levels.append((depth, *_nodes(contexts, self.symbols, n)))
        self.own, self.split = [], []  # log probabilities: of the context itself, of its longer contexts
        weighted = None
        for k, (depth, keys, n0, n1, _) in enumerate(self.levels):
            own = log_kt(n0, n1)
            if weighted is None:
                self.split.append(None)
                weighted = own
            else:
                _, below, _, _, _ = self.levels[k - 1]
                mask = (1 << (8 * (depth + 1))) - 1
                parent = ((below >> 8) & (mask >> 8)) * 256 + (below & 0xFF)
                split = np.bincount(np.searchsorted(keys, parent), weighted, len(keys))
                self.split.append(split)
                weighted = np.logaddexp(own, split) - math.log(2)
            self.own.append(own)
        self.weighted = weighted

    def score(self, top: pd.DataFrame) -> np.ndarray:
        """log10 probability of every run's last byte; ``top`` has the state above depth 3."""
        _, keys, n0, n1, place = self.levels[-1]
        order = np.argsort(top["key"].to_numpy())
        at = order[np.searchsorted(top["key"].to_numpy(), keys, sorter=order)]
        done, left, last = (top[c].to_numpy()[at][place] for c in ("done", "left", "last"))
        for k in range(len(self.levels) - 1, -1, -1):
            _, _, n0, n1, place = self.levels[k]
            seen = (n0 + n1 > 0)[place]
            estimate = ((n1 + 0.5) / (n0 + n1 + 1))[place]
            last = np.where(seen, estimate, last)
            if self.split[k] is not None:
                share = (1 / (1 + np.exp(np.clip(self.split[k] - self.own[k], -700, 700))))[place]
                done = np.where(seen, done + left * share * estimate, done)
                left = np.where(seen, left * (1 - share), left)
        one = np.clip(done + left * last, 1e-12, 1 - 1e-12)
        bit = (self.symbols[:, None] >> (7 - np.arange(8))) & 1
        return np.log10(np.where(bit == 1, one, 1 - one)).sum(axis=1)


def _weigh(level: DataFrame) -> DataFrame:
    """A level's sums with its own and weighted log probabilities."""
    own = _log_kt_column(F.col("n0"), F.col("n1"))
    high, low = F.greatest("own", "split"), F.least("own", "split")
    return level.withColumn("own", own).withColumn("weighted", high + F.log1p(F.exp(low - high)) - math.log(2))


def _upper(level: DataFrame, depth: int) -> DataFrame:
    """The level ``depth`` (contexts of that many bytes) from the one below it."""
    context = F.shiftright("key", 8).bitwiseAND((1 << (8 * depth)) - 1)
    key = (F.shiftleft(context, 8) + F.col("key").bitwiseAND(0xFF)).alias("key")
    return _weigh(level.groupBy(key).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("split")))


def _descend(level: DataFrame, above: DataFrame | None, depth: int) -> DataFrame:
    """(key, done, left, last): the mixture so far, the weight left, and the estimate of the deepest seen context."""
    if above is None:
        state = level.withColumns({"done": F.lit(0.0), "left": F.lit(1.0), "last": F.lit(0.5)})
    else:
        context = F.shiftright("key", 8).bitwiseAND((1 << (8 * (depth - 1))) - 1)
        key = F.shiftleft(context, 8) + F.col("key").bitwiseAND(0xFF)
        state = level.withColumn("up", key).join(above.withColumnRenamed("key", "up"), "up").drop("up")
    seen = F.col("n0") + F.col("n1") > 0
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    share = 1 / (1 + F.exp(F.least(F.col("split") - F.col("own"), F.lit(700.0))))
    return state.select(
        "key",
        F.when(seen, F.col("done") + F.col("left") * share * estimate).otherwise(F.col("done")).alias("done"),
        F.when(seen, F.col("left") * (1 - share)).otherwise(F.col("left")).alias("left"),
        F.when(seen, estimate).otherwise(F.col("last")).alias("last"),
    )


def run_values(runs: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of every distinct run's last byte, of (key, n) rows."""
    buckets = -(-runs.count() // BUCKET_RUNS) or 1
    context3 = F.shiftright("key", 8).bitwiseAND(0xFFFFFF)
    placed = runs.withColumn("bucket", F.pmod(F.xxhash64(context3), F.lit(buckets)).cast("int"))

    def weigh(frame: pd.DataFrame) -> pd.DataFrame:
        deep = DeepLevels(frame["key"].to_numpy(), frame["n"].to_numpy())
        _, keys, n0, n1, _ = deep.levels[-1]
        return pd.DataFrame({"bucket": frame["bucket"].iloc[0], "key": keys, "n0": n0, "n1": n1, "weighted": deep.weighted})

    third = materialize(placed.groupBy("bucket").applyInPandas(weigh, "bucket int, key long, n0 double, n1 double, weighted double"), "contexts")
    second = materialize(_upper(third, 2), "contexts")
    first = _upper(second, 1)
    root = _upper(first, 0)
    state = _descend(second, _descend(first, _descend(root, None, 0), 1), 2)
    context2 = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    top = third.select("bucket", "key", (F.shiftleft(context2, 8) + F.col("key").bitwiseAND(0xFF)).alias("up")).join(state.withColumnRenamed("key", "up"), "up").drop("up")

    def score(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        keys = frame["key"].to_numpy()
        return pd.DataFrame({"key": keys, "value": DeepLevels(keys, frame["n"].to_numpy()).score(above)})

    values = materialize(placed.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInPandas(score, "key long, value double"), "run-values")
    discard(third)
    discard(second)
    return values


# --- scores ------------------------------------------------------------------------------------


def block_scores(docs: pa.Table, values: pa.Table, train_tokens: int, vocabulary: int) -> pa.Table:
    """The documents of a block, scored with the block's values."""
    word = values.column("word").to_numpy()
    keys, numbers = values.column("key").to_numpy(), values.column("value").to_numpy()
    order = np.argsort(keys[~word])
    runs, run_value = keys[~word][order], numbers[~word][order] * PRECISION
    known = dict(zip(keys[word].tolist(), numbers[word].tolist()))
    base = math.log10(train_tokens + 0.5 * (vocabulary + 1))
    rows, cache = [], {}
    ids = iter(zip(docs.column("doc_id").to_pylist(), docs.column("held_out").to_pylist()))
    for texts, _ in steps(docs.column("z").to_pylist(), docs.column("held_out").to_pylist()):
        found, lengths = runs_of(texts)
        each = run_value[np.searchsorted(runs, found)]
        totals = np.add.reduceat(each, np.concatenate(([0], np.cumsum(lengths)[:-1])))
        for text, score in zip(texts, totals.tolist()):
            own = text.split()
            fresh = list(set(own).difference(cache))
            cache.update(zip(fresh, (known.get(h, 0.0) for h in hash_words(fresh))))
            counts = np.array([*map(cache.__getitem__, own), known.get(END_WORD, 0.0)])
            doc, held = next(ids)
            rows.append((doc, held, len(counts), int((counts > 0).sum()), train_tokens, float((np.log10(counts + 0.5) - base).sum()), score))
    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[name for name, _ in kinds])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row with the columns of SCORES."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(parallelism(spark), size // LEAST_BLOCK_BYTES), -(-size // block_bytes))
    rows = dealt(docs, blocks)
    counts = materialize(rows.groupBy("block").applyInArrow(block_counts, "block int, word boolean, key long, n long"), "block-counts")
    words = counts.where("word").groupBy("key").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    train_tokens, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    runs = materialize(counts.where("not word").groupBy("key").agg(F.sum("n").alias("n")), "runs")
    run_value = run_values(runs)
    discard(runs)
    asked = counts.select("block", "word", "key")
    values = (
        asked.where("not word").join(run_value.hint("merge"), "key").select("block", "word", "key", F.round(F.col("value") / PRECISION).cast("long").alias("value"))
        .unionByName(asked.where("word").join(words.select("key", F.col("n").alias("value")).hint("merge"), "key").select("block", "word", "key", "value"))
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_scores(left, right, train_tokens, vocabulary)

    scores = materialize(rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, SCORES), "scores")
    for done in (counts, words, run_value):
        discard(done)
    return scores
