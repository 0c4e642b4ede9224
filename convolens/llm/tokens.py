"""Token ids of whole texts, by the tokenizers library with a cache of words.

In this vocabulary no token reaches from a character that is not white space into white space, none reaches
from a letter or digit into ASCII punctuation, and a space before a character that is no white space begins a
token. So a text's ids are those of its words, each with the space before it, and a word's are those of its
letters and of what follows from its first punctuation on. Words repeat much more than texts do: only those not
met before go to the library. A text with a space before white space is cut into white-space-led pieces instead.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: fixed value: the characters with the Unicode property White_Space
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: fixed value: letters and digits that the vocabulary's rule takes for such, then ASCII punctuation
_LED = re.compile(f"([{_SPACE}]*[0-9A-Za-zÀ-ÖØ-öø-ɏ]+)" + r"([!-/:-@\[-`{-~].*)", re.S)
_PUNCTUATION = frozenset(string.punctuation)
_ALPHANUMERIC = frozenset([*string.ascii_letters, *string.digits, *(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))])
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: fixed value: the characters that stand for the bytes of a space and of the second halves of those letters
_SPACE_BYTE = chr(288)
_BYTES = {32: 288, 173: 323} | {byte: byte + 162 for byte in range(128, 161)}
#: Pieces kept between texts (about 250 bytes each), and the longest piece that is kept.
CACHED_PIECES = 450_000
CACHED_LENGTH = 64
#: Bytes of a column that are cut at once (a longer text alone), and words that the model gets in one string.
SLICE_BYTES, JOINED_WORDS = 10_000_000, 100
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Classes of bytes: others, a space, other ASCII white space, ASCII letters and digits, ASCII punctuation, the apostrophe, bytes
#: beyond ASCII, and first bytes of characters of which some are white space; then what follows from two neighbours' classes.
_OTHER, _SPACES, _WHITE, _WORD, _MARK, _APOSTROPHE, _WIDE, _LEAD = range(8)
_CLASS = bytes(
    _SPACES if c == 32 else _WHITE if 9 <= c <= 13 else _LEAD if c in (0xC2, 0xE1, 0xE2, 0xE3) else _WIDE if c >= 128
    else _WORD if chr(c).isalnum() else _APOSTROPHE if c == 39 else _MARK if chr(c) in _PUNCTUATION else _OTHER
    for c in range(256)
)
_NO_CUT, _CUT, _LAST_SPACE, _SINGLE, _LETTER = range(5)


def _between(before: int, own: int) -> int:
    """Whether texts are cut between bytes of two classes, or what decides (see ``_cuts``)."""
    if before in (_SPACES, _WHITE):
        return _LAST_SPACE if own == _SPACES else _SINGLE if before == _WHITE and own != _WHITE else _NO_CUT
    if own in (_SPACES, _WHITE) or before == _WORD and own in (_MARK, _APOSTROPHE) or before == _MARK and own == _WORD:
        return _CUT
    return _LETTER if before in (_WIDE, _LEAD) and own in (_MARK, _APOSTROPHE) else _NO_CUT


_PAIR = bytes(_between(pair >> 3, pair & 7) if pair < 64 else _NO_CUT for pair in range(256))
#: bytes that occur in words of one-byte and two-byte letters, as far as one byte tells; bytes as the characters that stand for them
_IN_WORDS = np.array([chr(c).isalpha() if c < 128 else c < 0xC0 or 0xC3 <= c <= 0xC8 for c in range(256)])
_STANDS = np.array([_BYTES.get(c, 266 if c == 10 else c) for c in range(256)], "<u2")
_NEWLINE = chr(266)


def default_path() -> str:
    """Where the vocabulary file lies."""
    return public_tokenizers.path(DEFAULT_TOKENIZER)


class _Spaced(ValueError):
    """A space stands before white space or the end, so that it may not begin a token."""


class _Words(dict):
    """Ids of words after ``lead``; a word not met before goes to the library, its punctuation to ``tails``."""

    def __init__(self, library, lead: str, tails: dict[str, bytes] | None = None):
        super().__init__()
        self.library, self.lead, self.tails = library, lead, self if tails is None else tails
        plain = library.normalizer is None and isinstance(library.pre_tokenizer, ByteLevel) and not library.pre_tokenizer.add_prefix_space
        self.model = library.model if plain and isinstance(library.model, BPE) else None

    def __missing__(self, word: str) -> bytes:
        if self.lead and (not word or word[0].isspace()):
            raise _Spaced
        if word.isalpha():
            ids = array("I", self.library_ids(self.lead + word)).tobytes()
            if len(word) <= CACHED_LENGTH:
                self[word] = ids
            return ids
        if word[-1] in _PUNCTUATION and word[-2:-1] in _ALPHANUMERIC:  # most of the others: one mark at the end
            led = word[:-1]
            met = led in self
            ids = self[led] + self.tails[word[-1]]
            if met and len(word) <= CACHED_LENGTH:
                self[word] = ids
            return ids
        first, *more = _PIECE.findall(word)
        led = None if more else _LED.fullmatch(word)
        if more:
            ids = self[first] + b"".join(map(self.tails.__getitem__, more))
        elif led:
            met = led[1] in self
            ids = self[led[1]] + self.tails[led[2]]
            if not met:  # a rare word will not be met with the same punctuation soon
                return ids
        else:
            ids = array("I", self.library_ids(self.lead + word)).tobytes()
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def library_ids(self, piece: str) -> list[int]:
        """The library's ids; letters after a space or none are one word to its splitter, and go to its model at once."""
        if self.model is not None and _LETTERS.fullmatch(piece):
            plain = piece.replace(" ", _SPACE_BYTE) if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            return [t.id for t in self.model.tokenize(plain)]
        return self.library.encode(piece, add_special_tokens=False).ids

    def shrink(self) -> None:
        """Forget half of many words; those met first are the frequent ones and stay."""
        if len(self) > CACHED_PIECES:
            for word in list(itertools.islice(reversed(self), CACHED_PIECES // 2)):
                del self[word]


class Encoder:
    """Texts to ids, as the little-endian unsigned 32-bit numbers that digests are taken of."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.pieces = _Words(library, "")
        self.words = _Words(library, " ", self.pieces)
        self.library = library
        if self.words.model is not None:
            tokens = library.get_vocab()
            self.model = Tokenizer(library.model)  # without a splitter
            self.added = [token.content for token in library.get_added_tokens_decoder().values()]
            self.spaced = np.zeros(max(tokens.values()) + 1, bool)
            self.spaced[[number for token, number in tokens.items() if token[0] == _SPACE_BYTE]] = True
            self.newline = tokens.get(_NEWLINE, -1)
        self.met: dict[bytes, int] = {}
        self.starts, self.sizes, self.pool = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.uint32)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        self.pieces.shrink()
        self.words.shrink()
        out = []
        for text in texts:
            first, *words = (text or "").split(" ")
            try:
                ids = b"".join(map(self.words.__getitem__, words))
                out.append(b"".join(map(self.pieces.__getitem__, _PIECE.findall(first))) + ids)
            except _Spaced:
                out.append(b"".join(map(self.pieces.__getitem__, _PIECE.findall(text))))
        return out


    def column(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text of a column of strings, in order."""
        if self.words.model is None:
            yield from self(texts.to_pylist())
            return
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][1 : len(texts) + 1] if len(texts) else np.empty(0, np.int64)
        at = 0
        while at < len(texts):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else ends[0] - len(texts[0].as_buffer())) + SLICE_BYTES, "right"))
            part = texts.slice(at, max(1, upto - at))
            at += len(part)
            data, bounds = _bytes(part)
            text = data.to_pybytes()
            kind = text.translate(_CLASS)
            odd = pc.match_substring_regex(part, _WIDE_SPACE) if _LEAD in kind else None
            for token in self.added:
                if token.encode() in text:
                    more = pc.match_substring(part, token)
                    odd = more if odd is None else pc.or_(odd, more)
            if odd is None or not pc.any(odd).as_py():
                yield from self._slice(data, bounds, kind)
                continue
            data, bounds = _bytes(pc.if_else(odd, "", part))
            plain = self._slice(data, bounds, data.to_pybytes().translate(_CLASS))
            for k, (is_odd, ids) in enumerate(zip(odd.to_pylist(), plain)):
                yield self([part[k].as_py()])[0] if is_odd else ids

    def _slice(self, data: pa.Buffer, bounds: np.ndarray, kind: bytes) -> list[bytes]:
        if not len(kind):
            return [b""] * (len(bounds) - 1)
        places = _cuts(np.frombuffer(data, np.uint8), bounds, kind).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), data]).dictionary_encode()
        known = self._numbers(pieces.dictionary)
        which = known[pieces.indices.to_numpy()]
        sizes = self.sizes[which]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[which] - upto[:-1].astype(np.int32), sizes)
        at += np.arange(upto[-1], dtype=np.int32)
        out = self.pool.take(at).tobytes()
        stops = (4 * upto[np.searchsorted(places, bounds)]).tolist()
        self._forget()
        return [out[a:b] for a, b in zip(stops, stops[1:])]

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces stand: numbers of ``starts`` and ``sizes``; new ones are added, long ones last."""
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset :][: len(pieces) + 1]
        data = pieces.buffers()[2].to_pybytes()
        bounds = at.tolist()
        keys = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        numbers = np.fromiter(map(self.met.get, keys, itertools.repeat(-1)), np.int32, len(keys))
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return numbers
        lengths = np.diff(at)[new]
        letters = _of_letters(np.frombuffer(data, np.uint8), at)[new] & (lengths <= CACHED_LENGTH)
        spaced = np.frombuffer(data, np.uint8)[at[new]] == 32
        kinds = (letters & spaced, letters & ~spaced, ~letters & (lengths <= CACHED_LENGTH), ~letters & (lengths > CACHED_LENGTH))
        spaced, bare, others, long = ([keys[k] for k in new[kind].tolist()] for kind in kinds)
        ids = [self._letters(spaced, True), self._letters(bare, False)]
        ids += [self._each([self.library.encode(key.decode(), add_special_tokens=False).ids for key in some]) for some in (others, long)]
        sizes = np.concatenate([x[1] for x in ids])
        first = len(self.starts)
        self.starts = np.concatenate((self.starts, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pool = np.concatenate((self.pool, *(x[0] for x in ids)))
        self.met.update(zip(itertools.chain(spaced, bare, others), itertools.count(first)))
        numbers[np.concatenate([new[kind] for kind in kinds])] = np.arange(first, first + len(new))
        return numbers

    @staticmethod
    def _each(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, lists), np.int32, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def _letters(self, words: list[bytes], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the sizes of words of letters after a space or none; the space or a line feed between them parts them in the model."""
        between = b"" if spaced else b"\n"
        joined = [between.join(words[at : at + JOINED_WORDS]) + between for at in range(0, len(words), JOINED_WORDS)]
        lists = [x.ids for x in self.model.encode_batch_fast([_STANDS[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in joined], add_special_tokens=False)]
        ids = self._each(lists)[0]
        if spaced:
            heads = np.flatnonzero(self.spaced[ids])
            sizes = np.diff(heads, append=len(ids))
        else:
            ends = np.flatnonzero(ids == self.newline)
            ids, sizes = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        if len(sizes) != len(words):
            raise ValueError("the vocabulary joins words")
        return ids, sizes.astype(np.int32)

    def _forget(self) -> None:
        """Drop the ids of long pieces, and half of many pieces; those met first are the frequent ones and stay."""
        if len(self.met) > 2 * CACHED_PIECES:
            self.met = dict(itertools.islice(self.met.items(), CACHED_PIECES))
        if len(self.starts) > len(self.met):
            # pieces are numbered in the order in which they were met, the long ones of a slice last
            self.starts, self.sizes = self.starts[: len(self.met)], self.sizes[: len(self.met)]
            self.pool = self.pool[: int(self.starts[-1] + self.sizes[-1]) if len(self.met) else 0]


def _of_letters(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether pieces, given as their bytes one after another, are letters alone, after a space or none."""
    other = ~_IN_WORDS[data]
    other[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    heads = bounds[:-1]
    alone = np.diff(bounds) == 1
    other[heads[(data[heads] == 32) & ~alone]] = False
    upto = np.concatenate(([0], np.cumsum(other, dtype=np.int32)))
    return upto[bounds[1:]] == upto[heads]


def _bytes(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of texts, one after another, and their bounds."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    return (texts.buffers()[2] or pa.py_buffer(b"")).slice(int(bounds[0]), int(bounds[-1] - bounds[0])), bounds - bounds[0]


def _cuts(data: np.ndarray, bounds: np.ndarray, kind: bytes) -> np.ndarray:
    """Where texts, given as their bytes one after another and these bytes' classes, are cut: at their bounds and where the library always cuts.

    That is before white space, also before the last space of several white-space characters; after single white space
    other than a space; between a letter or digit and ASCII punctuation after it; and between ASCII punctuation without
    the apostrophe, which may begin a contraction, and an ASCII letter or digit.
    """
    classes = np.frombuffer(kind, np.uint8)
    pairs = classes[:-1] << 3
    pairs |= classes[1:]
    what = np.frombuffer(pairs.tobytes().translate(_PAIR), np.uint8)
    cut = np.zeros(len(data) + 1, bool)
    np.equal(what, _CUT, out=cut[1:-1])
    rare = np.flatnonzero(what > _CUT) + 1
    which = what[rare - 1]
    # a text's end counts as white space, so that nothing is cut before its last space
    at = rare[which == _LAST_SPACE]
    at = at[at + 1 < len(data)]
    after = classes[at + 1]
    at = at[(after != _SPACES) & (after != _WHITE)]
    cut[at[bounds[np.searchsorted(bounds, at, "right")] != at + 1]] = True
    at = rare[which == _SINGLE]
    at = at[at >= 2]
    first = classes[at - 2]
    cut[at[(first != _SPACES) & (first != _WHITE)]] = True
    # letters of two bytes
    at = rare[which == _LETTER]
    at = at[at >= 2]
    lead, last = data[at - 2], data[at - 1]
    cut[at[((lead >= 0xC4) & (lead <= 0xC8)) | ((lead == 0xC9) & (last < 0x90)) | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))]] = True
    cut[bounds] = True
    return np.flatnonzero(cut)


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker; it outlives tasks, with its cache."""
    return Encoder(path)


def release() -> None:
    """Free a worker's encoder, for tasks of other stages that run in it later."""
    encoder.cache_clear()
