"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by bit overlap.

Every window of ``WINDOW`` bytes has an entropy. How often each entropy level occurs in the whole
corpus gives its rarity: windows are ranked by the level's count, rarest first. A window that is the
most improbable one of many of the ``NEIGHBOURS``-long runs of windows that hold it is a feature.
Features go in text order into Bloom filters of ``BITS`` bits, ``FEATURES`` to a filter; a full filter
is followed by the next. Windows of very low entropy (runs of a few bytes) are never features.

The likeness of two digests is the average, over the filters of the one with fewer features and
weighted by their features, of the best overlap with any filter of the other: the common set bits
above the number that chance gives, divided by the most that are possible above it.

Defined cases: a null text is the empty text, whose fingerprint is empty and like nothing but another
empty one. Texts too short for windows, or without a feature, use all their windows of ``SHORT_WINDOW``
bytes, or their whole bytes if shorter still. Rows that repeat a doc_id follow one another in the order
of their texts. Rows with a null doc_id come first. A single row is its own next document. Extra
columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.common import mix64, parallelism, polynomial

WINDOW = 32
SHORT_WINDOW = 8
NEIGHBOURS = 32
#: A feature is the most improbable window of at least this many runs.
POPULAR = 8
BITS = 2048
FEATURES = 128
HASHES = 5
LEVELS = 256
#: Windows below so many bits of entropy a byte are no features.
LEAST_ENTROPY = 1.5
_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_TERM = np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0.0)
#: Bytes of text worked on at a time, so that the tables of a very long text stay small.
_STEP = 1 << 18


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy of every window, in LEVELS steps from 0 to log2(WINDOW) bits."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):  # equal bytes at most WINDOW - 1 places before and after each byte
        same = (data[k:] == data[:-k]).view(np.uint8)
        before[k:] += same
        after[:-k] += same
    # The sum of c log2 c over a window's counts changes by the byte that leaves and the one that enters.
    # ``after`` counts the leaving byte within the old window; ``before`` the entering one within the new.
    first = float(_TERM[np.bincount(data[:WINDOW], minlength=256)].sum())
    leaves = _TERM[after[: n - 1] + 1] - _TERM[after[: n - 1]]
    enters = _TERM[before[WINDOW:] + 1] - _TERM[before[WINDOW:]]
    total = np.concatenate(([first], first + np.cumsum(enters - leaves)))
    entropy = np.log2(WINDOW) - total / WINDOW
    return np.clip(np.rint(entropy * ((LEVELS - 1) / np.log2(WINDOW))), 0, LEVELS - 1).astype(np.int64)


_WEAK = int(LEAST_ENTROPY * (LEVELS - 1) / np.log2(WINDOW))


def level_counts(docs: DataFrame) -> list[int]:
    """How many windows of the corpus have each entropy level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
                for at in range(0, len(data), _STEP):
                    counts += np.bincount(entropy_levels(data[at : at + _STEP + WINDOW - 1]), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], names=["level", "n"])

    found = docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = [0] * LEVELS
    for row in found:
        counts[row["level"]] = row["n"]
    return counts


def rarity_ranks(counts: list[int]) -> np.ndarray:
    """The rank of every level, 0 for the rarest; weak levels rank behind all others."""
    order = sorted(range(LEVELS), key=lambda level: (level < _WEAK, counts[level], -level))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def _part_features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Places of the features among the windows of ``data``."""
    levels = entropy_levels(data)
    if len(levels) < NEIGHBOURS:
        return np.empty(0, np.int64)
    least = (ranks[levels] << 32) | np.arange(len(levels))
    span = 1
    while span < NEIGHBOURS:  # the least of each run of NEIGHBOURS windows, by doubling
        step = min(span, NEIGHBOURS - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    votes = np.bincount(least & 0xFFFFFFFF, minlength=len(levels))
    return np.flatnonzero((votes >= POPULAR) & (levels >= _WEAK))


def features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the features of a text's bytes, in text order."""
    out = []
    powers = np.array([pow(0x9E3779B97F4A7C15, WINDOW - 1 - k, 2**64) for k in range(WINDOW)], np.uint64)
    overlap = WINDOW + NEIGHBOURS - 2
    for at in range(0, max(1, len(data) - overlap), _STEP):
        places = _part_features(data[at : at + _STEP + overlap], ranks) + at
        if len(places):
            windows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[places].astype(np.uint64)
            out.append(mix64((windows * powers).sum(axis=1, dtype=np.uint64)))
    found = np.concatenate(out) if out else np.empty(0, np.uint64)
    if not len(found) and len(data):
        found = polynomial(data.astype(np.uint64), min(SHORT_WINDOW, len(data)))
    return found[np.sort(np.unique(found, return_index=True)[1])]


def filters(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The chained filters: (number of features, BITS bits as bytes of 0 and 1)."""
    out = []
    for at in range(0, len(hashes), FEATURES):
        part = hashes[at : at + FEATURES]
        bits = np.zeros(BITS, np.uint8)
        for k in range(HASHES):
            bits[(part >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
        out.append((len(part), bits))
    return out


def encode(chain: list[tuple[int, np.ndarray]]) -> str:
    """A fingerprint as text: the filters in order, each its feature count, a colon and its bits."""
    return ".".join(f"{n}:{base64.b64encode(np.packbits(bits).tobytes()).decode()}" for n, bits in chain)


def decode(text: str) -> list[tuple[int, np.ndarray]]:
    """The filters of a fingerprint."""
    parts = [part.split(":", 1) for part in text.split(".")] if text else []
    return [(int(n), np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8))) for n, bits in parts]


def likeness(one: list, two: list) -> float:
    """Normalised bit overlap of two chains, from 0 to 1."""
    if not one or not two:
        return 1.0 if not one and not two else 0.0
    if sum(n for n, _ in one) > sum(n for n, _ in two):
        one, two = two, one
    left, right = (np.array([bits for _, bits in chain], np.float32) for chain in (one, two))
    own, other = left.sum(axis=1)[:, None], right.sum(axis=1)[None, :]
    chance, most = own * other / BITS, np.minimum(own, other)
    score = np.where(most > chance, (left @ right.T - chance) / np.maximum(most - chance, 1e-9), left @ right.T >= most)
    weights = np.array([n for n, _ in one], float)
    return float(np.clip(score, 0, 1).max(axis=1) @ weights / weights.sum())


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _parts(docs: DataFrame, parts: int) -> DataFrame:
    """Every row with the part of the doc_id order it belongs to, and each part's end with its guest.

    Parts begin at doc_ids that exist. The rows of a part's first id are also given to the part
    before as guests (and those of the least id to the last part), so that every row's next document
    is in its own part. Only the bounds, one number for each part, come to the driver.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    row = ids.agg(F.percentile_approx("doc_id", at, F.lit(10_000)).alias("at") if parts > 1 else F.lit(None).alias("at"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    starts = sorted(set(row["at"] or []) - {row["least"]})
    least = None if row["known"] < row["n"] else row["least"]  # the first document has a null id if any has
    last = len(starts)
    own = F.lit(0)
    if starts:
        bounds = F.array(*map(F.lit, starts))
        own = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0))
    guest_of = F.when(F.col("doc_id").eqNullSafe(F.lit(least)), F.lit(last))
    if starts:
        guest_of = guest_of.when(F.array_contains(bounds, F.col("doc_id")), own - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = F.array_compact(F.array(F.struct(own.alias("part"), F.lit(False).alias("guest")), F.when(guest_of.isNotNull(), F.struct(guest_of.alias("part"), F.lit(True).alias("guest")))))
    return rows.withColumn("_p", F.explode(both)).select("_p.part", "_p.guest", "doc_id", "text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    ranks = rarity_ranks(level_counts(docs))
    parts = parts or parallelism(spark)

    def digest(text: str) -> list:
        return filters(features(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, guest_seen = None, None, False
        for batch in batches:
            rows = []
            for number, guest, doc, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if number != part:
                    part, held, guest_seen = number, None, False
                if guest and guest_seen:
                    continue  # only the first guest is a next document
                guest_seen = guest
                chain = digest(text)
                if held is not None:
                    before, own, own_chain = held
                    changed = edited(own, text)
                    other = digest(changed)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((before, len(own), sha, encode(own_chain), encode(other), likeness(own_chain, other), likeness(own_chain, chain)))
                held = None if guest else (doc, text, chain)
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    dealt = _parts(docs, parts).repartition(parts, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
