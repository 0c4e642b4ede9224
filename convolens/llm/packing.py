"""Best-fit packing of documents into sequences, improved by swap-based local search.

Documents become token ids plus an end id. Only a document longer than a sequence is cut, into whole
sequences; its first piece holds the remainder. The pieces (without their ids) are dealt by hash into
groups of about ``GROUP`` pieces, so that no group grows with the data or with one source. Each group
is packed on its own: best fit in the order of doc_id, pieces below a quarter sequence last, then local search. The search goes over
the underfull sequences, fullest first, and fills each by moves and by exchanges with emptier ones, one or two pieces for
none, one or two, always so that the sum of squared fills rises, until sequences are empty and nothing helps. A group still
above its lower bound is then perturbed (a few sequences are mixed up) and searched again, ``ROUNDS`` times at most; nothing else
packs it. A group that reaches its bound leaves at most part of one sequence open.

Defined cases: a null or empty text is the end id alone. A very long text is cut into pieces of a sequence. Rows that repeat a doc_id, null included,
are packed as documents of their own under the same id. An empty table gives no pieces. Extra
columns are not carried.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm import tokens
from convolens.llm.common import materialize

LENGTH = 2048
END = 0
GROUP = 20_000
#: How often a group that is above its bound is mixed up and searched again, and how many sequences at a time.
ROUNDS, MIXED = 30, 100

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids."""
    first = total % length or length
    if total <= length:
        return [(0, total)]
    return [(0, first), *((at, length) for at in range(first, total, length))]


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """The pieces of every document, with a checksum of their ids."""
    path = tokenizer or tokens.default_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.column(batch.column(1))):
                ids += end
                for number, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((doc, number, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, in the order given, goes to the fullest bin that it fits."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    free_sizes = 0  # bit f is set if a bin has f free
    for item, need in enumerate(lengths.tolist()):
        fitting = free_sizes >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            where = by_free[free].pop()
            if not by_free[free]:
                free_sizes &= ~(1 << free)
        else:
            free, where = capacity, len(bins)
            bins.append([])
        bins[where].append(item)
        left = free - need
        if left:
            by_free.setdefault(left, []).append(where)
            free_sizes |= 1 << left
    return bins


class LocalSearch:
    """Empties underfull bins by moves and swaps between them that raise the sum of squared fills.

    A bin is filled by the exchange that leaves it the least room: one item, or two of the emptiest bin, come
    from a bin that is no fuller, and none, one or two of its own go there. What fuller bins gain, emptier ones
    lose, so the squares rise with each step, and the free room gathers in the bins that empty. When no exchange
    helps any more, a few bins are mixed up and the search goes on from there, at most ``rounds`` times;
    a packing with more bins than the best so far is taken back.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int, rounds: int = ROUNDS):
        self.n, self.capacity, self.rounds, self.steps = lengths.tolist(), capacity, rounds, 0
        self.least = -(-sum(self.n) // capacity)
        self.bins, self.fill, self.home, self.live = [], [], [0] * len(self.n), 0
        self.open: set[int] = set()
        for k, items in enumerate(bins):
            self._store(k, list(items))

    def _store(self, k: int, items: list[int]) -> None:
        """Bin ``k``, which may be new, holds ``items`` from now on."""
        if k == len(self.bins):
            self.bins.append([])
            self.fill.append(0)
        self.live += bool(items) - bool(self.bins[k])
        self.bins[k], self.fill[k] = items, sum(self.n[i] for i in items)
        for i in items:
            self.home[i] = k
        (self.open.add if 0 < self.fill[k] < self.capacity else self.open.discard)(k)

    def _index(self) -> None:
        """The items of underfull bins by their length."""
        self.by_length: dict[int, set[int]] = {}
        for k in self.open:
            for i in self.bins[k]:
                self.by_length.setdefault(self.n[i], set()).add(i)
        self.lengths = sorted(self.by_length)

    def _put(self, item: int, to: int) -> None:
        at, n = self.home[item], self.n[item]
        self.bins[at].remove(item)
        self.bins[to].append(item)
        self.fill[at] -= n
        self.fill[to] += n
        self.home[item] = to

    def _exchange(self, into: tuple[int, ...], out: tuple[int, ...], to: int) -> None:
        giver = self.home[into[0]]
        for i in into:
            self._put(i, to)
        for i in out:
            self._put(i, giver)
        self.steps += 1
        if not self.fill[giver]:
            self.open.discard(giver)
            self.live -= 1
        if self.fill[to] == self.capacity:  # full bins give and take nothing any more
            self.open.discard(to)
            for i in self.bins[to]:
                same = self.by_length[self.n[i]]
                same.discard(i)
                if not same:
                    del self.by_length[self.n[i]]
                    del self.lengths[bisect_left(self.lengths, self.n[i])]

    def _giver(self, length: int, to: int) -> int | None:
        """An item of a length, in the emptiest bin that is no fuller than ``to``."""
        found = [(self.fill[self.home[i]], i) for i in self.by_length[length] if self.home[i] != to]
        fill, item = min(found, default=(self.capacity, -1))
        return item if fill <= self.fill[to] else None

    def _pairs(self, items: list[int]) -> dict[int, tuple[int, ...]]:
        """The sums of two items, with the items of each; of equal items two are enough."""
        seen: dict[int, int] = {}
        few = []
        for i in items:
            seen[self.n[i]] = seen.get(self.n[i], 0) + 1
            if seen[self.n[i]] <= 2:
                few.append(i)
        out: dict[int, tuple[int, ...]] = {}
        for a, i in enumerate(few):
            for j in few[a + 1 :]:
                out.setdefault(self.n[i] + self.n[j], (i, j))
        return out

    def _improve(self, to: int) -> bool:
        """The exchange that fills a bin the most; False if none fills it more."""
        room, own = self.capacity - self.fill[to], self.bins[to]
        leaving: dict[int, tuple[int, ...]] = {0: (), **{self.n[i]: (i,) for i in own}}
        for total, items in self._pairs(own).items():
            leaving.setdefault(total, items)
        best, found = 0, None
        for total, items in leaving.items():
            at = bisect_right(self.lengths, total + room) - 1
            while at >= 0 and self.lengths[at] - total > best:
                item = self._giver(self.lengths[at], to)
                if item is not None:
                    best, found = self.lengths[at] - total, ((item,), items)
                    break
                at -= 1
            if best == room:
                break
        if best < room:
            if self.donor not in self.open:
                self.donor = min(self.open, key=lambda k: (self.fill[k], k))
            if self.donor != to and self.fill[self.donor] <= self.fill[to]:
                given = self._pairs(self.bins[self.donor])
                sums = sorted(given)
                for total, items in leaving.items():
                    at = bisect_right(sums, total + room) - 1
                    if at >= 0 and sums[at] - total > best:
                        best, found = sums[at] - total, (given[sums[at]], items)
        if found is None:
            return False
        self._exchange(*found, to)
        return True

    def _search(self) -> None:
        """Passes over the underfull bins, the fullest first, until one changes nothing."""
        self._index()
        moved = True
        while moved and self.live > self.least:
            moved, self.donor = False, -1
            for to in sorted(self.open, key=lambda k: (-self.fill[k], k)):
                while to in self.open and self.live > self.least and self._improve(to):
                    moved = True

    def _mix(self, rng: random.Random) -> dict[int, list[int]]:
        """Empty the two emptiest bins and a few others and fill them anew in a random order; what was in all that may change."""
        chosen = {*sorted(self.open, key=lambda k: (self.fill[k], k))[:2], *rng.sample(range(len(self.bins)), min(len(self.bins), MIXED))}
        before = {k: list(self.bins[k]) for k in chosen | self.open}
        items = [i for k in sorted(chosen) for i in self.bins[k]]
        rng.shuffle(items)
        for k in chosen:
            self._store(k, [])
        places = iter([*sorted(chosen), *range(len(self.bins), len(self.bins) + len(items))])
        for fresh in best_fit(np.array([self.n[i] for i in items]), self.capacity):
            self._store(next(places), [items[x] for x in fresh])
        return before

    def run(self) -> list[list[int]]:
        """Bins of item numbers, when the bound is met or mixing up has not helped."""
        rng = random.Random(len(self.n))
        self._search()
        for _ in range(self.rounds):
            if self.live <= self.least:
                break
            best, size = self.live, len(self.bins)
            before = self._mix(rng)
            self._search()
            if self.live > best:
                for k in range(size, len(self.bins)):
                    self._store(k, [])
                for k, items in before.items():
                    self._store(k, items)
        return [b for b in self.bins if b]


def pack_lengths(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers for one group: best fit in the order given, short items last, then the search."""
    order = np.argsort(4 * lengths < capacity, kind="stable")
    return [order[items].tolist() for items in LocalSearch(lengths[order], best_fit(lengths[order], capacity), capacity).run()]


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cuts = materialize(pieces(docs, length, tokenizer), "pieces")
    groups = -(-cuts.count() // group) or 1
    dealt = cuts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = frame["length"].to_numpy()
        sequence, offset = np.empty(len(frame), np.int64), np.empty(len(frame), np.int64)
        for number, items in enumerate(pack_lengths(lengths, length)):
            sequence[items] = number
            offset[items] = np.concatenate(([0], np.cumsum(lengths[items])[:-1]))
        out = frame.drop(columns="_group")
        return out.assign(sequence_id=(int(frame["_group"].iloc[0]) << 32) + sequence, offset=offset)

    return dealt.groupBy("_group").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")
