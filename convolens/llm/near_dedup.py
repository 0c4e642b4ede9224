"""MinHash near-dedup by a signature-coordinate inverted join.

Equal shingle sets are one class with one representative, its smallest doc_id, so that copies never
meet as pairs. A class has a signature of ``K`` minima. Links are found in four steps; each leaves out
pairs that are already in one component, so that a large group costs no squares:

1. Stars: classes are posted under runs of BAND coordinates and meet the centres of their lists. That
   joins large groups, in proportion to their size.
2. Short lists: classes are posted under each coordinate-value pair, and lists of one entry or of one
   component are dropped. A list of up to ``SHORT`` entries gives its pairs of different components.
   Longer lists are skipped: a pair that shares no short list has all its collisions in long lists, so
   that both its entries have at least ``MATCHES`` coordinates there.
3. Rare shingles: among those entries, pairs that share a shingle of at most ``RARE`` of them. Linked sets
   that share none have three quarters of their shingles among the common ones.
4. Blocks: those meet under runs of BLOCK coordinates and are compared exactly, in blocks of two chunks that
   return only a spanning forest of their links. This step alone grows with the square of a
   crowd: of texts that are made of the same common passages and are yet no near copies.

The collisions of the pairs of steps 1 to 3 are counted over whole signatures; at least ``MATCHES`` must agree,
and those that do are confirmed on full shingle sets. So every link is exact, and what can be lost is a pair
of similarity 0.75 with fewer than 32 of 64 collisions (three in a million) or, in step 4, with no equal run
of three coordinates (one in a hundred thousand). No list is cut short.

Shingles: distinct runs of five words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words are one
shingle. Defined cases: a null or empty text, or one of white space, has no shingle and is alone. A
row with a null doc_id is linked with nothing, has a null component and counts as kept by
``keep_one``. Rows that repeat a doc_id are one node of the graph, each with its own shingle count.
A very long text is hashed whole, its signature in portions; an empty table gives no rows. Extra columns
of any name are carried along by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convolens.llm import tokens
from convolens.llm.common import materialize, mix64, other_columns, polynomial, row_columns
from convolens.llm.graph import connected_components

SHINGLE = 5
K = 64
MATCHES = 32
#: Longest list of a coordinate that gives all its pairs, and most sets that hold a rare shingle.
SHORT, RARE = 32, 16
#: Consecutive coordinates under which entries meet the centres of their lists, and the last entries in blocks.
BAND, BLOCK = 4, 3
#: Entries of a chunk; two make a block.
CHUNK = 1_000
SIMILARITY = 75
_SEEDS = mix64(np.arange(1, K + 1, dtype=np.uint64))
_ODD = mix64(np.arange(1001, K + 1001, dtype=np.uint64)) | np.uint64(1)
_CACHED_WORDS = 400_000


class Shingler:
    """Distinct shingle hashes (sorted) of texts; word hashes are kept between texts, up to a bound."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > _CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.unique(polynomial(codes, min(self.width, len(codes))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """K minima of the shingles under K scramblings, 32 bits each."""
    out = np.full(K, np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 4096):  # a bounded table for very long texts
        block = (shingles[at : at + 4096, None] ^ _SEEDS) * _ODD
        np.minimum(out, (block ^ (block >> np.uint64(29))).min(axis=0), out)
    return (mix64(out) >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits that name the shingle set) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        shingles = Shingler()
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingles(text)
                counts.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sigs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")

def _keys(sigs: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit key for each run of ``width`` coordinates; it names the place of the run and its values."""
    runs = K // width
    value = np.broadcast_to(np.arange(1, runs + 1, dtype=np.uint64), (len(sigs), runs))
    for k in range(width):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + sigs[:, k : runs * width : width])
    return value.view(np.int64)


def _postings(entries: DataFrame, width: int) -> DataFrame:
    """(key, other columns) of ``entries`` with a column sig: a row for each run of ``width`` coordinates."""
    others = [f for f in entries.schema.fields if f.name != "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(-1, K).astype(np.uint64)
            keys = _keys(sigs, width)
            index = pa.array(np.repeat(np.arange(len(sigs)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), *(c.take(index) for c in batch.columns[1:])], names=["key", *batch.schema.names[1:]])

    return entries.select("sig", *(f.name for f in others)).mapInArrow(run, StructType([StructField("key", LongType()), *others]))


def stars(classes: DataFrame) -> DataFrame:
    """Pairs (a < b) of every class with the centres of its lists under BAND coordinates.

    A list's centres are its least entry (an original stands before its copies) and its entry of the
    least hash. They only join large groups early: what they miss is found by ``candidates``.
    """
    postings = _postings(classes.select("rep", "sig"), BAND)
    centre = F.array(F.min("rep"), F.min_by("rep", F.xxhash64("rep"))).alias("centres")
    lists = postings.groupBy("key").agg(F.count("*").alias("n"), centre).where("n > 1").drop("n")
    met = postings.join(lists.hint("merge"), "key").select("rep", F.explode("centres").alias("c")).where("rep != c")
    return met.select(F.least("rep", "c").alias("a"), F.greatest("rep", "c").alias("b")).distinct()


def candidates(entries: DataFrame, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components from short lists, and the (rep) of entries that may have others.

    Of (rep, component, sig). A pair that no short list holds has its collisions in long lists alone, so
    that both its entries have at least MATCHES coordinates there.
    """
    postings = _postings(entries, 1)
    several = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(postings.join(several.hint("merge"), "key"), "postings")
    mixed = shared.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    lists = shared.join(mixed.select("key").hint("merge"), "key")
    pairs = across(lists.where(F.col("n") <= short))
    long = lists.where(F.col("n") > short).groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") >= MATCHES)
    return pairs, long.select("rep")


def across(lists: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of entries of a list (key, rep, component) that are of different components."""
    gathered = lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "component"))).alias("m"))
    two = "explode(flatten(transform(sequence(0, size(m) - 2), i -> transform(filter(slice(m, i + 2, size(m)), e -> e.component != m[i].component), e -> named_struct('a', m[i].rep, 'b', e.rep)))))"
    return gathered.where(F.size("m") > 1).select(F.expr(two).alias("p")).select("p.a", "p.b").where("a < b").distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(rep, component, n, row, words) of (rep, component, text): the sorted shingle hashes as bytes; ``row`` names the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            rows = [xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for s in sets]
            arrays = [*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "component", "n", "row", "words"])

    return texts.select("rep", "component", "text").mapInArrow(run, "rep long, component long, n long, row long, words binary").dropDuplicates(["rep", "row"])


def rare_pairs(sets: DataFrame, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different components that share a rare shingle, and the sets that may be linked without one.

    A shingle is rare if at most ``rare`` of the sets hold it. Linked sets of a and b shingles share at
    least 3/7 (a + b), which is at least 3/4 of the larger and 6/7 of the smaller: sets that share no rare
    shingle can only be linked if so much of them is not rare. ``full`` tells the sets of which 6/7 are not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.frombuffer(w, np.int64) for w in part.column(3).to_pylist()]
                index = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                keys = np.concatenate([np.empty(0, np.int64), *sets])
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(c.take(index) for c in part.columns[:3])], names=["key", "rep", "component", "row"])

    rows = sets.select("rep", "component", "row", "words").mapInArrow(run, "key long, rep long, component long, row long")
    held = rows.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") <= rare)
    low = materialize(rows.join(held.hint("merge"), "key"), "rare-shingles")
    counted = low.groupBy("rep", "row").agg(F.count("*").alias("low"))
    common = sets.join(counted.hint("merge"), ["rep", "row"], "left").withColumn("common", F.col("n") - F.coalesce("low", F.lit(0)))
    return across(low.where("held > 1")), common.where("4 * common >= 3 * n").withColumn("full", F.expr("7 * common >= 6 * n")).drop("low", "common")


def links_of_block(sets: list[np.ndarray], components: np.ndarray, first: np.ndarray | None, similarity: int = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest (row, row) of the links between different components of a block.

    ``first`` tells the two sides of a block apart, of which only links from one to the other are sought.
    Intersections are counted exactly, by products of 0/1 matrices over the shingles that two rows share.
    """
    sizes = np.array([len(s) for s in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 2048):
        low, high = np.searchsorted(columns, (at, at + 2048))
        part = np.zeros((len(sets), 2048), np.float32)
        part[rows[low:high], columns[low:high] - at] = 1
        both += part @ part.T
    linked = 100 * both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    linked &= components[:, None] != components[None, :]
    if first is not None:
        linked &= first[:, None] != first[None, :]
    out, waiting = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        frontier = [root] if waiting[root] else []
        waiting[root] = False
        while frontier:
            at = frontier.pop()
            fresh = np.flatnonzero(linked[at] & waiting)
            waiting[fresh] = False
            out.extend((at, k) for k in fresh.tolist())
            frontier.extend(fresh.tolist())
    return out


def block_links(sets: DataFrame, signatures: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The links (a, b) between different components among ``sets``, found in blocks of at most about two chunks.

    Entries meet under BLOCK consecutive coordinates, if any of them is full (see ``rare_pairs``); the entries of
    such a key are dealt into chunks, a component of more than ``chunk`` entries into chunks of its own, and
    every two chunks that can hold different components are a block. A block returns a spanning forest, never
    its pairs.
    """
    marked = sets.groupBy("rep", "component").agg(F.max("full").alias("full"))
    keyed = _postings(signatures.select("rep", "sig").join(marked.hint("merge"), "rep"), BLOCK)
    shares = keyed.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("full").alias("full"))
    small = F.sum(F.when(F.col("n") <= chunk, F.col("n")).otherwise(0))
    totals = shares.groupBy("key").agg(F.count("*").alias("several"), small.alias("small"), F.max("full").alias("any")).where("several > 1 and any").drop("any")
    large = F.col("n") > chunk
    n_chunks = F.greatest(F.lit(1), F.ceil(F.when(large, F.col("n")).otherwise(F.col("small")) / chunk)).cast("int")
    sized = materialize(shares.join(totals.hint("merge"), "key").select("key", "component", F.when(large, F.col("component")).alias("owner"), n_chunks.alias("n_chunks")), "block-sizes")
    number = lambda x: F.pmod(F.xxhash64(x), "n_chunks").cast("int")
    name = lambda part: F.xxhash64(F.col("owner").isNull(), "owner", part)
    part = F.explode(F.when(F.col("owner").isNotNull(), F.sequence(F.lit(0), F.col("n_chunks") - 1)).otherwise(F.array(number("component"))))
    chunks = sized.select("key", "owner", "n_chunks", "component", part.alias("part")).select("key", "owner", name("part").alias("chunk")).distinct()
    both = chunks.toDF("key", "owner", "i").hint("merge").join(chunks.toDF("key", "other", "j"), "key")
    blocks = both.where("i <= j and not (owner is not null and owner <=> other)")
    sides = blocks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    placed = keyed.join(sized.hint("merge"), ["key", "component"]).withColumn("part", F.when(F.col("owner").isNotNull(), number("rep")).otherwise(number("component")))
    met = placed.withColumn("chunk", name("part")).join(sides.hint("merge"), ["key", "chunk"]).select("key", "i", "j", "chunk", "rep", "component")
    filled = met.join(sets.select("rep", "words").hint("merge"), "rep")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        reps, found = frame["rep"].to_numpy(), [np.frombuffer(w, np.int64) for w in frame["words"]]
        first = (frame["chunk"] == frame["i"]).to_numpy() if frame["i"].iloc[0] != frame["j"].iloc[0] else None
        links = np.array(links_of_block(found, frame["component"].to_numpy(), first), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": reps[links[:, 0]], "b": reps[links[:, 1]]})

    return filled.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def count_matches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in at least MATCHES coordinates."""
    sigs = classes.select("rep", "sig")
    left, right = sigs.toDF("a", "sig_a"), sigs.toDF("b", "sig_b")
    both = pairs.select("a", "b").hint("merge").join(left, "a").join(right.hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(-1, K) for k in (2, 3))
            keep = pa.array((left == right).sum(axis=1) >= MATCHES)
            yield batch.select([0, 1]).filter(keep)

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs with 100 * intersection >= similarity * union of their full shingle sets."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, own = Shingler(), None, None
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, own = a, shingles(a)
                other = shingles(b)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= similarity * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # both sides grow with the data: merge joins at every size, never a broadcast
    joined = pairs.hint("merge").join(left, "a").join(right.hint("merge"), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _joined(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after further links between their nodes or new ones."""
    name = lambda side: components.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    ends = links.join(name("a").hint("merge"), "a", "left").join(name("b").hint("merge"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    # a new name for each old component, and for entries that had none
    old = components.join(joined.select(F.col("node").alias("component"), F.col("component").alias("name")).hint("merge"), "component", "left")
    alone = joined.join(components.select("node").hint("merge"), "node", "left_anti")
    return materialize(old.select("node", F.coalesce("name", "component").alias("component")).unionByName(alone), "components")


def find_groups(docs: DataFrame, short: int = SHORT, rare: int = RARE, chunk: int = CHUNK) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    sigs = materialize(signatures(docs), "signatures")
    usable = sigs.where("doc_id is not null and n_shingles > 0")
    classes = materialize(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    ids = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("doc_id is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        counted = materialize(count_matches(pairs, classes), "candidates")
        wanted = counted.select(F.col("a").alias("rep")).unionByName(counted.select(F.col("b").alias("rep"))).distinct()
        # rows that repeat a doc_id are one node, so that a link of either of their texts is its link
        return confirm(counted, ids.join(wanted.hint("merge"), "rep")).distinct()

    def named(entries: DataFrame) -> DataFrame:
        labels = components.select(F.col("node").alias("rep"), "component").hint("merge")
        return entries.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    member = usable.join(classes.select("set_key", "rep").hint("merge"), "set_key").select("doc_id", "rep")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z")
    same = member.join(several.hint("merge"), "doc_id").select("a", F.col("rep").alias("b"))
    components = connected_components(confirmed(stars(classes)).unionByName(same))
    pairs, crowded = candidates(materialize(named(classes), "entries"), short)
    sets = materialize(shingle_sets(named(ids.join(crowded.hint("merge"), "rep"))), "crowded-sets")
    further, common = rare_pairs(sets, rare)
    links = materialize(confirmed(pairs.unionByName(further).distinct()), "links")
    if not links.isEmpty():
        components = _joined(components, links)
    common = materialize(named(common.drop("component")), "common-sets")
    links = materialize(block_links(common, classes, chunk), "links")
    if not links.isEmpty():
        components = _joined(components, links)
    found = (
        sigs.join(classes.select("set_key", "rep").hint("merge"), "set_key", "left")
        .join(components.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    )
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns."""
    gone = find_groups(docs).where("not kept").select("doc_id").distinct()
    rows = docs.select(other_columns(docs), "text", F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select(*row_columns(docs.columns))
