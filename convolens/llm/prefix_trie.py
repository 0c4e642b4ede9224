"""Prefix trie of conversations by whole-sequence collapse.

1. ``rebuild`` numbers every conversation's turns, puts the first turns of its group's head before its
   own later ones and keeps of each turn a digest and the size of its text.
2. A prefix's key is its depth and the exclusive or of 128-bit hashes of its (place, turn) pairs. It is a
   running sum, so that a long conversation is keyed in blocks whose totals are carried on, not in one task.
3. Conversations of one whole key collapse into a weighted sequence: how many they are, the smallest
   conv_id, and the list of all as a digest that streams over sorted chunks (``end_lists``). Only one copy
   of each sequence goes on.
4. Sequences whose key is also a proper prefix of another go by anti-join; the others are the leaves.
5. Weighted prefixes are summed by key. A node is owned by the sequence of its smallest member. What a
   sequence owns are the last nodes of its path, or none, so one depth a sequence tells them; bytes, children and
   leaves below a node are then sums over the sequences through it, and no ancestor pairs are made.

Groups are summed before they are shuffled: a first turn that all
conversations share, or a thousand copies of one conversation, are a row a task.

Defined cases: rows without a conv_id belong to no conversation and are left out; a null role or text is
empty; turns of one number are ordered by the digest of role and text, and repeated rows are turns of their
own; empty and very long texts count by their bytes; a conversation that is rebuilt to no turns ends at the
root; an empty table has no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convolens.llm.common import materialize, parallelism

#: A conversation's head is that of the first of so many neighbours; of its turns fewer than HEADS are taken.
GROUP, HEADS = 5, 9
#: Turns of one conversation that one task sums; later ones carry the totals on.
BLOCK = 4096
#: Ids in one chunk of an end list.
CHUNK = 512
KEY = ("depth", "k1", "k2")


def digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size) of every row that belongs to a conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def carried(rows: DataFrame, part: str, totals: dict[str, Column]) -> DataFrame:
    """(conv_id, part, totals of all earlier parts) of every part of a conversation that is not its first."""
    each = rows.groupBy("conv_id", part).agg(*[f.alias(name) for name, f in totals.items()])
    before = Window.partitionBy("conv_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    again = {"n": F.sum, "k1": F.bit_xor, "k2": F.bit_xor, "bytes": F.sum}
    return each.select("conv_id", part, *[again[name](name).over(before).alias(f"{name}_before") for name in totals]).where(F.col(f"{next(iter(totals))}_before").isNotNull())


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, size): turns numbered from 0 within their conversation.

    Range parts by (conv_id, turn) split a large conversation; numbers of earlier parts are carried on.
    """
    rows = digests(conversations)
    parted = rows.repartitionByRange(parallelism(rows.sparkSession), "conv_id", "turn", "digest").withColumn("part", F.spark_partition_id())
    parted = materialize(parted, "turns")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    joined = parted.withColumn("own", own).join(carried(parted, "part", {"n": F.count("*")}), ["conv_id", "part"], "left")
    return materialize(joined.select("conv_id", (F.col("own") - 1 + F.coalesce("n_before", F.lit(0))).alias("pos"), "digest", "size"), "positions")


def rebuild(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, size) of every rebuilt conversation's turns, and (conv_id) of every conversation.

    Conversation c gets the first h turns of conversation c - c % group and its own after its first h;
    h is the crc32 of the decimal c, modulo ``heads``.
    """
    turns = positions(conversations)
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    ids = materialize(turns.select("conv_id").distinct(), "conversations")
    first = turns.where(F.col("pos") < heads - 1).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))
    with_head = ids.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(first, "base", "left")
    taken = with_head.select("conv_id", "h", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))).alias("head"))
    before = taken.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.size")
    short = taken.select("conv_id", F.coalesce(F.size("head"), F.lit(0)).alias("m"), "h").where("m < h").select("conv_id", "m")
    rest = turns.withColumn("h", h).where("pos >= h").join(short, "conv_id", "left")
    after = rest.select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("m", "h")).alias("pos"), "digest", "size")
    return materialize(before.union(after), "rebuilt"), ids


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "pos", F.xxhash64(F.lit(1), "pos", "digest").alias("x1"), F.xxhash64(F.lit(2), "digest", "pos").alias("x2"), "size", F.floor(F.col("pos") / BLOCK).alias("part"))


_TOTALS = {"n": F.count, "k1": F.bit_xor, "k2": F.bit_xor, "bytes": F.sum}
_OF = {"n": "*", "k1": "x1", "k2": "x2", "bytes": "size"}


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, before): the keys of every prefix and of its parent, and the bytes of the parent's turns."""
    rows = _hashed(turns)
    window = Window.partitionBy("conv_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("conv_id", "part", "pos", "x1", "x2", "size", F.bit_xor("x1").over(window).alias("l1"), F.bit_xor("x2").over(window).alias("l2"), F.sum("size").over(window).alias("bytes"))
    earlier = carried(rows, "part", {k: _TOTALS[k](_OF[k]) for k in ("k1", "k2", "bytes")})
    joined = local.join(earlier, ["conv_id", "part"], "left")
    k1, k2 = (F.col(f"l{k}").bitwiseXOR(F.coalesce(f"k{k}_before", F.lit(0))) for k in (1, 2))
    return joined.select("conv_id", (F.col("pos") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), (F.coalesce("bytes_before", F.lit(0)) + F.col("bytes") - F.col("size")).alias("before"))


def whole_keys(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, bytes) of every whole conversation; one without turns has the root's key."""
    blocks = _hashed(turns).groupBy("conv_id", "part").agg(*[f(_OF[name]).alias(name) for name, f in _TOTALS.items()])
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("bytes").alias("bytes"))
    return ids.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*KEY, "bytes")])


def end_lists(whole: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): the digest of each key's conv_ids, ascending, joined by commas.

    Ids are dealt by (key, id) ranges, so that a key's list is made in many tasks, as chunks of text; the
    digest streams over a key's sorted chunks and holds one batch of them.
    """
    n = parallelism(whole.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            out = []
            for *own, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (own != key or len(held) == CHUNK):
                    out.append((*key, held[0], ",".join(map(str, held))))
                    held = []
                key = own
                held.append(conv_id)
            yield _chunk_batch(out)
        if held:
            yield _chunk_batch([(*key, held[0], ",".join(map(str, held)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    state, key = hashlib.sha256(ids.encode()), own
                else:
                    state.update(b"," + ids.encode())
            yield _digest_batch(out)
        if state:
            yield _digest_batch([(*key, state.hexdigest())])

    by_id = whole.select(*KEY, "conv_id").repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    listed = by_id.mapInArrow(chunks, "depth long, k1 long, k2 long, first long, ids string")
    return listed.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [pa.int64() if name in (*KEY, "first") else pa.string() for name in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [*KEY, "first", "ids"])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [*KEY, "ends_sha256"])


def collapse(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, depth, k1, k2, weight, bytes, ends_sha256): one weighted row of each distinct whole conversation."""
    whole = materialize(whole_keys(turns, ids), "whole")
    weighted = whole.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.max("bytes").alias("bytes"))
    return materialize(weighted.join(end_lists(whole), list(KEY)), "sequences")


def nodes_of(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes, of (conv_id, pos, digest, size) turns and the (conv_id) of all conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sequences = collapse(turns, ids)
    paths = materialize(prefixes(turns.join(sequences.select(F.col("rep").alias("conv_id")), "conv_id")).withColumnRenamed("conv_id", "rep"), "paths")

    def along(table: DataFrame) -> DataFrame:
        """Every prefix of every sequence, the root among them, beside its sequence's columns."""
        kept = table.select("rep", F.col("depth").alias("length"), *[c for c in table.columns if c not in ("rep", *KEY)])
        zero = F.lit(0).cast("long")
        return paths.join(kept, "rep").unionByName(kept.select("*", *[zero.alias(c) for c in paths.columns if c != "rep"]))

    reached = along(sequences).groupBy(*KEY).agg(F.min("rep").alias("owner"), F.max(F.col("length") > F.col("depth")).alias("longer"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("before").alias("before"))
    reached = materialize(reached, "reached")
    leaves = sequences.join(reached.where("longer").select(*KEY), list(KEY), "left_anti").select("rep", F.lit(1).alias("leaf"))
    owned = reached.groupBy("owner").agg(F.min(F.struct("depth", "p1", "p2", "before")).alias("f")).select(F.col("owner").alias("rep"), F.col("f.depth").alias("first"), F.col("f.before").alias("first_before"), "f.p1", "f.p2")
    above = reached.select((F.col("depth") + 1).alias("first"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("above"))
    owned = owned.join(above, ["first", "p1", "p2"], "left").select("rep", "first", "first_before", "above")
    # a sequence that ends inside another with a smaller member owns nothing
    owns = F.coalesce("first", F.col("depth") + 1).alias("first"), F.coalesce("first_before", "bytes").alias("first_before")
    marked = sequences.join(owned, "rep", "left").join(leaves, "rep", "left")
    marked = materialize(marked.select(*sequences.columns, *owns, "above", "leaf"), "marked")

    depth, first = F.col("depth"), F.col("first")
    saved = F.col("weight") * (F.col("bytes") - F.col("before")) - (F.col("bytes") - F.greatest("before", "first_before"))
    parent = F.when((depth > first) & (depth > 0), F.col("rep")).when((depth == first) & (depth > 0), F.col("above"))
    summed = along(marked).groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"),
        F.max(parent).alias("parent_conv_id"),
        F.sum("weight").alias("n_convs"),
        F.sum(((depth + 1 >= first) & (depth + 1 <= F.col("length"))).cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
        F.coalesce(F.max(F.when(depth == F.col("length"), F.col("ends_sha256"))), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return nodes_of(*rebuild(conversations, group, heads))
