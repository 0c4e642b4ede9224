"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

What is coded are a chunk's symbols: its distinct ids, and phrases of them (see ``Phrases``): pairs of symbols that stand
side by side often become a symbol of their own, in rounds. Below, "id" stands for a symbol.

An id's probability is mixed from three predictions: the id that followed the last two ids (order 2), the
id that followed the last one (order 1), and an order-0 distribution over all ids. The two context
predictions get the front of the coder's range, each a share whose width follows how often it was
right lately at its confidence (one share, if they agree); order 0 gets the rest. A chunk begins with
what its blocks start from, its ``Prior``: the ids' frequencies in the chunk, and the followers that its ids
and pairs of ids have most often. A block adapts from there, after every ``SEGMENT`` ids: classes of ids by
what came, followers by its own. Each id is one step of a range coder with 64-bit bounds that puts out 32-bit words and carries into them.

Every block starts from the same state, so blocks are coded side by side: a step codes one id
of every block of a chunk, on arrays. A chunk holds whole documents and is self-contained:

    magic, version, block length, number of different symbols, of documents, of ids and of blocks
    doc_ids as int64 (a null is the least int64), document lengths in ids as uint64
    lengths of the packed phrases and prior, the phrases and the prior
    per block: number of 32-bit words, crc32 of its token ids (the last block is filled up by its last symbol)
    the words of all blocks, in order

Numbers are little-endian. A wrong checksum raises ``ValueError`` when read.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CVID"
VERSION = 5
HEADER = struct.Struct("<4sBIIQQQ")
#: Most new phrases of each round, how often their pair stands in a chunk at least, and most symbols in all (two make 32 bits).
PHRASES, LEAST_PAIR, MOST_SYMBOLS = (4000, 8000, 16000), 8, 1 << 16
#: Pairs are known by their hash to so many bits, then compared.
PAIR_BITS = 18
#: Most blocks that are coded side by side, and the least length of a block (the last may be shorter).
LANES = 1024
LEAST_BLOCK = 1024
NULL_ID = -(2**63)
CLASSES = 64
#: Slots of a block's order-1 and order-2 tables.
SLOTS = 1024
#: What a block has learned is put to use after so many of its ids; a divisor of REFRESH.
SEGMENT = 16
#: Order-0 probabilities are recomputed after so many ids, on a scale of 2**25.
REFRESH = 64
SCALE = 1 << 25
#: Heaviest share of a context prediction, against an order-0 total of about SCALE.
HEAVIEST = 1 << 30
#: Added to what a block has learned; above 4 * id + 3 of every id.
LEARNED = 1 << 30
#: What a class counts for at the start of a block, and what an id adds.
CLASS_START, CLASS_STEP = 150, 24
#: Contexts of two ids are known by their hash to so many slots; followers are kept from so many occurrences on.
PAIR_SLOTS = 1 << 13
LEAST_FOLLOWED = 16
#: What is added to a confidence, at twice it and one more for a hit, and whether the follower stays.
_SURER = np.array([-1, 1, -1, 1, -1, 1, -1, 0], np.int32)
_KEPT = np.array([0, 1, 0, 1, 1, 1, 1, 1], bool)
_ONES = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _followers(contexts: np.ndarray, ids: np.ndarray, size: int, vocabulary: int) -> np.ndarray:
    """For every context below ``size``, 4 * id + confidence of the id that follows it most often, or -4."""
    out = np.full(size, -4, np.int32)
    if not len(ids):
        return out
    pairs = np.sort((contexts * vocabulary + ids).astype(np.uint32 if size * vocabulary <= 2**32 else np.int64))
    at = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1], [True])))
    counts, pairs = np.diff(at), pairs[at[:-1]].astype(np.int64)
    often = counts >= LEAST_FOLLOWED
    counts, pairs = counts[often], pairs[often]
    if not len(pairs):
        return out
    context = pairs // vocabulary
    order = np.lexsort((counts, context))
    last = order[np.flatnonzero(np.concatenate((context[order][1:] != context[order][:-1], [True])))]
    share = counts[last] / np.bincount(contexts, minlength=size)[context[last]]
    good = share >= 0.1
    out[context[last][good]] = (pairs[last] % vocabulary * 4 + 1 + (share > 0.35) + (share > 0.7))[good]
    return out


def _pair_slot(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    # only low bits count, so that numbers of 32 bits may overflow
    last, before = last.astype(np.uint32), before.astype(np.uint32)
    return (((last * np.uint32(40503) + before * np.uint32(30011)) >> np.uint32(3)) & np.uint32(PAIR_SLOTS - 1)).astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _pair_hash(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint32(2654435761)) >> np.uint32(32 - PAIR_BITS)).astype(np.intp)


def _join_pairs(symbols: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with the most frequent pairs as symbols from ``first`` on, and those pairs in that order.

    Of pairs that overlap the more frequent one is joined; of pairs with one hash, too.
    """
    keys = symbols[:-1] << np.uint32(16)
    keys |= symbols[1:]
    ordered = np.sort(keys)
    at = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    counts = np.diff(at)
    often = np.flatnonzero(counts >= LEAST_PAIR)
    # rank 1 is the rarest
    pairs = ordered[at[often[np.argsort(counts[often], kind="stable")[-most:]]]]
    ranks = np.arange(1, len(pairs) + 1, dtype=np.uint16)
    rank_at = np.zeros(1 << PAIR_BITS, np.uint16)
    rank_at[_pair_hash(pairs)] = ranks
    pairs = pairs[rank_at[_pair_hash(pairs)] == ranks]
    rank_at[:], key_at = 0, np.zeros(1 << PAIR_BITS, np.uint32)
    rank_at[_pair_hash(pairs)], key_at[_pair_hash(pairs)] = ranks[: len(pairs)], pairs
    at = _pair_hash(keys)
    own = rank_at.take(at)
    own *= key_at.take(at) == keys
    rank = np.zeros(len(symbols) + 1, np.uint16)  # of the pair that begins at each symbol, one place later
    rank[1:-1] = own
    left = rank[1:-1]
    joined = np.zeros(len(symbols) + 1, bool)
    joined[1:-1] = (left > rank[:-2]) & (left >= rank[2:])
    # then those that are not beside joined ones
    left *= ~(joined[:-2] | joined[1:-1] | joined[2:])
    joined[1:-1] |= (left > rank[:-2]) & (left >= rank[2:])
    # numbers follow the pairs' order, which packs well
    order = np.argsort(pairs)
    number = np.empty(len(pairs), np.uint32)
    number[order] = np.arange(first, first + len(pairs), dtype=np.uint32)
    out, at = symbols.copy(), np.flatnonzero(joined[1:-1])
    out[at] = number.take(own.take(at) - 1)
    return out[~joined[:-1]], pairs[order]


class Phrases:
    """A chunk's symbols: first its distinct ids in ascending order, then pairs of symbols that come before them."""

    def __init__(self, own: np.ndarray, pairs: np.ndarray):
        self.own, self.pairs, self.size = own, pairs, len(own) + len(pairs)
        self.ones, self.twos = pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)
        if (np.maximum(self.ones, self.twos) >= np.arange(len(own), self.size)).any():
            raise ValueError("a chunk's phrases are damaged")

    def _waves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs in order, as many at once as are made of symbols that were given before."""
        last, done = np.maximum(self.ones, self.twos), 0
        while done < len(last):
            upto = done + int(np.argmax(np.append(last[done:] >= len(self.own) + done, True)))
            yield self.ones[done:upto], self.twos[done:upto]
            done = upto

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """Every symbol's number of ids."""
        sizes = np.ones(len(self.own), np.int32)
        for ones, twos in self._waves():
            sizes = np.concatenate((sizes, sizes[ones] + sizes[twos]))
        return sizes

    @functools.cached_property
    def pool(self) -> np.ndarray:
        """Every symbol's ids, one after another."""
        pool = self.own
        for ones, twos in self._waves():
            pool = np.concatenate((pool, self._spell(pool, np.stack((ones, twos), axis=1).reshape(-1))))
        return pool

    def _spell(self, pool: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes.take(symbols)
        at = np.repeat((self.starts.take(symbols) - np.cumsum(sizes) + sizes).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        return pool.take(at)

    @functools.cached_property
    def starts(self) -> np.ndarray:
        """Where every symbol's ids begin in ``pool``."""
        return np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[np.ndarray, Phrases]:
        """The symbols of ids, and the phrases."""
        there = np.bincount(ids) > 0
        own = np.flatnonzero(there).astype("<u4")
        symbols = (np.cumsum(there) - 1).astype(np.uint32).take(ids)
        pairs: list[np.ndarray] = [np.empty(0, np.uint32)]
        first = len(own)
        for most in PHRASES:
            most = min(most, MOST_SYMBOLS - first)
            if most > 0 and len(symbols) > 1:
                symbols, new = _join_pairs(symbols, first, most)
                pairs.append(new)
                first += len(new)
        return symbols, cls(own, np.concatenate(pairs))

    def ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and where each symbol's end."""
        return self._spell(self.pool, symbols), np.cumsum(self.sizes.take(symbols))

    def packed(self) -> bytes:
        steps = np.diff(self.own, prepend=np.zeros(1, "<u4"))
        return zlib.compress(struct.pack("<I", len(self.own)) + _planes(steps) + _planes(self.pairs), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Phrases:
        try:
            raw = zlib.decompress(data)
            n = struct.unpack_from("<I", raw)[0]
            steps, pairs = (np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1) for x in (raw[4 : 4 + 4 * n], raw[4 + 4 * n :]))
        except (zlib.error, struct.error, ValueError) as error:
            raise ValueError("a chunk's phrases are damaged") from error
        return cls(np.cumsum(steps, dtype=np.int64).astype("<u4"), pairs.astype(np.uint32))


class Prior:
    """What the blocks of a chunk start from, of plain arrays that a chunk carries."""

    def __init__(self, levels: np.ndarray, follows: np.ndarray, follows_two: np.ndarray):
        self.levels, self.primed = levels, np.maximum(np.concatenate((follows, follows_two)), 0)
        # level b > 0 stands for 2 ** ((b - 1) / 8) occurrences; a quarter of them is weight enough
        self.weight = np.where(levels > 0, np.ceil(2.0 ** ((levels.astype(np.float64) - 1) / 8) / 4), 0).astype(np.int64)
        self.upto = np.concatenate(([0], np.cumsum(self.weight)))
        bounds = np.searchsorted(self.upto, self.upto[-1] * np.arange(1, CLASSES) // CLASSES, "left")
        self.starts = np.concatenate(([0], np.minimum(bounds, len(levels)), [len(levels)]))
        self.class_weight = self.upto[self.starts[1:]] - self.upto[self.starts[:-1]]
        self.class_of = np.repeat(np.arange(CLASSES), np.diff(self.starts))
        self.base = self.upto[self.starts[:-1]]
        self.within = self.upto[:-1] - self.base[self.class_of]
        self.id_at = np.repeat(np.arange(len(levels), dtype=np.int32), self.weight)

    @classmethod
    def of(cls, ids: np.ndarray, vocabulary: int) -> Prior:
        ids = ids.astype(np.int64)
        counts = np.bincount(ids, minlength=vocabulary)
        levels = np.where(counts > 0, np.rint(8 * np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.uint8)
        slots = _pair_slot(ids[:-2], ids[1:-1])
        return cls(levels, _followers(ids[:-1], ids[1:], vocabulary, vocabulary), _followers(slots, ids[2:], PAIR_SLOTS, vocabulary))

    def packed(self) -> bytes:
        return zlib.compress(self.levels.tobytes() + b"".join(map(_planes, np.split(self.primed, [len(self.levels)]))), 6)

    @classmethod
    def unpacked(cls, data: bytes, vocabulary: int) -> Prior:
        try:
            raw = np.frombuffer(zlib.decompress(data), np.uint8)
        except zlib.error as error:
            raise ValueError("a chunk's prior is damaged") from error
        if len(raw) != 5 * vocabulary + 4 * PAIR_SLOTS:
            raise ValueError("a chunk's prior is damaged")
        parts = np.split(raw, (vocabulary, 5 * vocabulary))
        primed = [np.ascontiguousarray(x.reshape(4, -1).T).view("<i4").reshape(-1) for x in parts[1:]]
        if not parts[0].any() or any(x.max() >= 4 * vocabulary for x in primed):
            raise ValueError("a chunk's prior is damaged")
        return cls(parts[0], *primed)


class Model:
    """The predictions for ids of every lane, and their update.

    What is learned changes after every ``SEGMENT`` ids of a lane: inside a segment predictions are read from
    arrays that stand still, so that the encoder makes those of a segment at once and the decoder one by one.
    """

    def __init__(self, lanes: int, prior: Prior):
        self.lanes, self.prior, self.n = np.arange(lanes), prior, lanes
        self.counts, self.came = np.full(CLASSES * lanes, CLASS_START, np.int64), []
        # a slot holds 4 * id + confidence above LEARNED (0: nothing yet), so that the larger of it and of what the prior
        # says is what counts; small tables stay in a core's cache
        self.table = np.zeros(2 * lanes * SLOTS, np.int32)
        self.right = np.tile(np.array([0.0, 8, 16, 32]), 2 * lanes)
        self.wrong = np.tile(np.array([1.0, 16, 8, 2]), 2 * lanes)
        both = np.arange(2 * lanes).reshape(2, lanes)
        self.row, self.sure_row = both * SLOTS, both * 4
        self.class_row, self.eighths = self.lanes * CLASSES, self.lanes * 8
        self.step = 0
        self._refresh()

    def _refresh(self) -> None:
        if self.step % REFRESH == 0:
            if self.came:
                self.counts += CLASS_STEP * np.bincount(np.concatenate(self.came), minlength=len(self.counts))
                self.came = []
            counts, weight = self.counts.reshape(self.n, CLASSES), self.prior.class_weight
            each = np.maximum(1, (counts * (SCALE / counts.sum(axis=1, keepdims=True)) / np.maximum(1, weight)).astype(np.int64))
            mass = each * weight
            upto = np.cumsum(mass, axis=1)
            below = upto - mass
            self.each, self.total = each.reshape(-1), np.ascontiguousarray(upto[:, -1])
            self.below = below.astype(np.uint32).reshape(-1)
            self.coarse, self.fine = np.ascontiguousarray(self.below.reshape(-1, CLASSES)[:, 8::8].T), self.below.reshape(-1, 8)
            self.total_of_state = np.tile(np.repeat(self.total, 4), 2)
        # the same floating-point operations give the same bits when decoding
        self.spikes = np.minimum(self.total_of_state * (self.right / self.wrong), HEAVIEST).astype(np.int64)
        self.spikes[::4] = 0

    def room(self, *shape: int) -> tuple[np.ndarray, ...]:
        """Arrays for what ``predict`` knows."""
        return tuple(np.empty((*shape, 2, self.n), kind) for kind in (np.int64, np.int32, np.int64, np.int64))

    def predict(self, last: np.ndarray, before: np.ndarray, known: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(share of the order-1, of the order-2 prediction); their (place, entry, state, id) are put into ``known``.

        ``last`` and ``before`` are the ids before, rows of lanes by time or one row.
        """
        slots, entry, state, guess = known
        primed = np.empty_like(slots)
        one, two = slots[..., 0, :], slots[..., 1, :]
        np.multiply(last, 40503, out=one)
        np.add(one, before * 30011, out=two)
        primed[..., 0, :] = last
        primed[..., 1, :] = ((two >> 3) & (PAIR_SLOTS - 1)) + len(self.prior.levels)
        slots >>= 5
        slots &= SLOTS - 1
        slots += self.row
        np.maximum(self.table.take(slots), self.prior.primed.take(primed), out=entry)
        np.bitwise_and(entry, LEARNED - 1, out=entry)
        np.bitwise_and(entry, 3, out=state)
        state += self.sure_row
        np.right_shift(entry, 2, out=guess)
        spikes = self.spikes.take(state)
        second = spikes[..., 1, :]
        both = second * (guess[..., 0, :] == guess[..., 1, :])
        return spikes[..., 0, :] + both, second - both

    def interval(self, ids: np.ndarray, known: tuple, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mass, mass below) of ids in the whole range, and the range."""
        prior = self.prior
        place = prior.class_of.take(ids) + self.class_row
        each = self.each.take(place)
        mass, low = each * prior.weight.take(ids), self.below.take(place) + prior.within.take(ids) * each
        front = first + second
        one = (known[3][..., 0, :] == ids) & (first > 0)
        two = (known[3][..., 1, :] == ids) & (second > 0) & ~one
        return np.where(one, first, np.where(two, second, mass)), np.where(one, 0, np.where(two, first, low + front)), self.total + front

    def find(self, v: np.ndarray, known: tuple, first: np.ndarray, second: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, mass, mass below): whose interval holds ``v``."""
        prior = self.prior
        u = np.maximum(v - front, 0)
        small = u.astype(np.uint32)
        eighth = np.add.reduce((self.coarse <= small).view(np.int8), 0, np.int8) + self.eighths
        rows = self.fine.take(eighth, axis=0)
        # bounds rise, so that their comparisons are bytes of one, then of zero
        inner = np.bitwise_count((rows <= small[:, None]).view(np.uint64)[:, 0]) - 1
        place = eighth * 8 + inner
        start = rows.reshape(-1).take(self.eighths + inner)
        each = self.each.take(place)
        base = prior.base.take(place & (CLASSES - 1))
        # exact, as both numbers are far below 2**52
        ids = prior.id_at.take(base + ((small - start) / each).astype(np.int64), mode="clip")
        mass, low = prior.weight.take(ids) * each, prior.within.take(ids) * each
        low += start
        low += front
        # the range begins with the shares of the predictions, the first one's before the second one's
        one, two = v < first, v < front
        for where, guess, share, below in ((two, known[3][1], second, first), (one, known[3][0], first, 0)):
            np.copyto(ids, guess, where=where)
            np.copyto(mass, share, where=where)
            np.copyto(low, below, where=where)
        return ids, mass, low

    def update(self, ids: np.ndarray, known: tuple) -> None:
        """Learn the ids that came in a segment, in rows by time; of a slot met twice the later entry stays."""
        self.came.append((self.prior.class_of.take(ids) + self.class_row).reshape(-1))
        at, entry, state, guess = known
        ids = ids[:, None, :]
        state <<= 1
        state += guess == ids
        told = np.bincount(state.reshape(-1), minlength=2 * len(self.right)).reshape(-1, 2)
        self.wrong += 2 * told[:, 0]
        self.right += 2 * told[:, 1]
        state &= 7
        entry += _SURER.take(state)
        kept = np.where(_KEPT.take(state), entry, ids.astype(np.int32) * 4 + 1)
        kept |= LEARNED
        self.table[at.reshape(-1)] = kept.reshape(-1)
        self.step += len(ids)
        self._refresh()


def _carry(words: np.ndarray, lanes: np.ndarray, at: np.ndarray) -> None:
    """Add one to the words before ``at``, and to those before as long as they overflow."""
    while len(lanes):
        at = at - 1
        words[lanes, at] += np.uint32(1)
        over = words[lanes, at] == 0
        lanes, at = lanes[over], at[over]


def encode_blocks(rows: np.ndarray, prior: Prior) -> list[np.ndarray]:
    """The words of every block; ``rows`` has a block's ids in each row."""
    lanes, length = rows.shape
    model = Model(lanes, prior)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, used = np.zeros((lanes, length + 3), np.uint32), np.zeros(lanes, np.int64)
    flat, row = words.reshape(-1), model.lanes * (length + 3)
    columns = np.zeros((length + 2, lanes), np.int64)
    columns[2:] = rows.T
    for start in range(0, length, SEGMENT):
        end = min(length, start + SEGMENT)
        ids = columns[start + 2 : end + 2]
        known = model.room(end - start)
        first, second = model.predict(columns[start + 1 : end + 1], columns[start:end], known)
        mass, below, total = (x.view(np.uint64) for x in model.interval(ids, known, first, second))
        for t in range(end - start):
            unit = span // total[t]
            step = unit * below[t]
            low += step
            over = (low < step).nonzero()[0]
            if len(over):
                _carry(words, over, used[over])
            span = unit * mass[t]
            out = (span <= _ONES).nonzero()[0]
            top, own = low[out], used[out]
            flat[row[out] + own] = top >> _HALF
            used[out] = own + 1
            low[out] = top << _HALF
            span[out] <<= _HALF
        model.update(ids, known)
    for _ in range(2):
        words[model.lanes, used] = low >> _HALF
        used += 1
        low = low << _HALF
    return [words[k, : used[k]] for k in range(lanes)]


def decode_blocks(words: list[np.ndarray], length: int, prior: Prior) -> np.ndarray:
    """The rows that ``encode_blocks`` was given."""
    lanes = len(words)
    model = Model(lanes, prior)
    table = np.zeros((lanes, max(map(len, words)) + 3), np.uint32)
    for k, own in enumerate(words):
        table[k, : len(own)] = own
    code, span = table[:, 0].astype(np.uint64) << _HALF | table[:, 1], np.full(lanes, 2**64 - 1, np.uint64)
    ends = (model.lanes + 1) * table.shape[1] - 1
    at, table = ends - table.shape[1] + 3, table.reshape(-1)
    out = np.zeros((length + 2, lanes), np.int64)
    for start in range(0, length, SEGMENT):
        end = min(length, start + SEGMENT)
        seen = model.room(end - start)
        for t, known in zip(range(start, end), zip(*seen)):
            first, second = model.predict(out[t + 1], out[t], known)
            front = first + second
            total = model.total + front
            unit = span // total.view(np.uint64)
            v = np.minimum((code // unit).view(np.int64), total - 1)
            ids, mass, below = model.find(v, known, first, second, front)
            code -= unit * below.view(np.uint64)
            span = unit * mass.view(np.uint64)
            put = (span <= _ONES).nonzero()[0]
            own = at[put]
            code[put] = code[put] << _HALF | table[own]
            span[put] <<= _HALF
            at[put] = np.minimum(own + 1, ends[put])
            out[t + 2] = ids
        model.update(out[start + 2 : end + 2], seen)
    return out[2:].T


def pack_chunk(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """A chunk of whole documents; each is its ids as little-endian unsigned 32-bit numbers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    symbols, phrases = Phrases.of(ids) if len(ids) else (ids, None)
    block = max(LEAST_BLOCK, -(-len(symbols) // LANES))
    n_blocks = -(-len(symbols) // block)
    head = HEADER.pack(MAGIC, VERSION, block, phrases.size if phrases else 0, len(doc_ids), len(ids), n_blocks)
    names = np.array([NULL_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    lengths = np.array([len(d) // 4 for d in documents], "<u8").tobytes()
    if phrases is None:
        return head + names + lengths
    padded = np.full(n_blocks * block, symbols[-1], np.uint32)
    padded[: len(symbols)] = symbols
    prior = Prior.of(symbols, phrases.size)
    told, packed = phrases.packed(), prior.packed()
    words = encode_blocks(padded.reshape(n_blocks, block), prior)
    upto = np.cumsum(phrases.sizes.take(padded))
    fill = np.tile(ids[len(ids) - phrases.sizes[symbols[-1]] :], len(padded) - len(symbols))
    index = np.array([(len(w), crc) for w, crc in zip(words, _checksums(np.concatenate((ids, fill)), upto, block))], "<u4").tobytes()
    return b"".join([head, names, lengths, struct.pack("<II", len(told), len(packed)), told, packed, index, *(w.astype("<u4").tobytes() for w in words)])


def _checksums(ids: np.ndarray, upto: np.ndarray, block: int) -> list[int]:
    """crc32 of the ids of every block, from where each symbol's ids end."""
    stops = [0, *upto[block - 1 :: block].tolist()]
    return [zlib.crc32(ids[a:b]) for a, b in zip(stops, stops[1:])]


def unpack_chunk(data: bytes) -> tuple[list[int | None], list[bytes]]:
    """The doc_ids and the documents' ids of a chunk, all blocks checked."""
    magic, version, block, size, n_docs, n_ids, n_blocks = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of this format")
    at = HEADER.size
    names = np.frombuffer(data, "<i8", n_docs, at).tolist()
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    if int(lengths.sum()) != n_ids:
        raise ValueError("a chunk's document lengths do not add up")
    ids = np.empty(0, np.uint32)
    if n_ids:
        told, packed = struct.unpack_from("<II", data, at)
        at += 8
        phrases = Phrases.unpacked(data[at : at + told])
        if phrases.size != size:
            raise ValueError("a chunk's phrases are damaged")
        prior = Prior.unpacked(data[at + told : at + told + packed], size)
        at += told + packed
        index = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(-1, 2)
        at += 8 * n_blocks
        ends = np.cumsum(index[:, 0], dtype=np.int64)
        words = np.frombuffer(data, "<u4", int(ends[-1]), at)
        ids, upto = phrases.ids(decode_blocks(np.split(words, ends[:-1]), block, prior).reshape(-1))
        for k, crc in enumerate(_checksums(ids, upto, block)):
            if crc != index[k, 1]:
                raise ValueError(f"block {k} of a chunk has a wrong checksum")
        if len(ids) < n_ids:
            raise ValueError("a chunk's ids do not add up to its documents")
    ends = np.cumsum(lengths)
    return [None if d == NULL_ID else d for d in names], [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
