"""Best-fit packing: pieces against the library, whole packings, and the local search."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import packing, tokens


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("length", [2048, 16])
def test_pieces_and_places(spark, length):
    rows = [(d, t) for d, t in odd_rows() if d != 4]
    got = packing.pack(with_clashes(table(spark, rows)), length=length).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    known = {d: np.array([*library_ids(t), 0], "<u4") for d, t in rows if d is not None}
    assert set(by_doc) == set(known) | {None}
    for doc, ids in known.items():
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
        assert len(own) == -(-len(ids) // length) and all(r["length"] == length for r in own[1:])
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // length) * 1.05 + 1


def test_repeated_ids_are_packed_each(spark):
    got = packing.pack(table(spark, [(4, "a b c"), (4, "a b c"), (4, "d")])).collect()
    assert len(got) == 3 and sum(r["length"] for r in got) == 4 + 4 + 2


def test_empty_table(spark):
    assert packing.pack(table(spark, [])).count() == 0


def test_search_beats_best_fit():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit needs four bins of ten, three are enough
    plain = packing.best_fit(lengths, 10)
    found = packing.pack_lengths(lengths, 10)
    assert len(found) == 3 <= len(plain)
    assert sorted(i for b in found for i in b) == list(range(7))


def fewest(lengths, capacity):
    """The least number of bins, by trying every placement."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_small_packings_against_all_placements():
    """The search alone: never more bins than it began with, whole, and the least number in nearly all cases."""
    rng, more = random.Random(7), 0
    for _ in range(150):
        lengths = np.array([rng.randint(1, 40) for _ in range(rng.randint(1, 9))])
        found = packing.pack_lengths(lengths, 40)
        assert sorted(i for b in found for i in b) == list(range(len(lengths)))
        assert all(lengths[b].sum() <= 40 for b in found)
        assert len(found) <= len(packing.best_fit(lengths[np.argsort(4 * lengths < 40, kind="stable")], 40))
        more += len(found) - fewest(sorted(lengths.tolist(), reverse=True), 40)
    assert more <= 3


def test_the_search_saves_where_best_fit_is_poor():
    """Three of these lengths fill a sequence; best fit, also by descending length, puts many pairs together."""
    lengths = np.random.default_rng(0).integers(650, 721, 1000)
    begun = packing.best_fit(lengths, packing.LENGTH)
    search = packing.LocalSearch(lengths, begun, packing.LENGTH, rounds=0)
    squares = sum(f * f for f in search.fill)
    found = search.run()
    descending = packing.best_fit(np.sort(lengths)[::-1], packing.LENGTH)
    assert len(found) < 0.95 * min(len(begun), len(descending)) and search.steps > 0
    assert sum(int(lengths[b].sum()) ** 2 for b in found) > squares


def test_the_search_takes_documents_to_the_bound(spark):
    """On the documents of sf0.01: moves and swaps save sequences, down to what the number of ids demands."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs).collect()
    lengths = np.array([r["length"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"]))])
    bound = -(-int(lengths.sum()) // packing.LENGTH)
    plain = packing.best_fit(lengths, packing.LENGTH)
    search = packing.LocalSearch(lengths, plain, packing.LENGTH)
    assert len(search.run()) < len(plain) and search.steps > 0
    assert len({r["sequence_id"] for r in rows}) <= bound + 1


def test_encoder_equals_the_library():
    encode = tokens.encoder(tokens.default_path())
    texts = [t or "" for _, t in odd_rows()] + [prose(9, 400), "a b  c　", " lead", "trail  ", "x" * 5000, "tab\t\tend\r\n\r\n", "it's we'll 123 4a5 <|endoftext|> z", "\x1c\x1d a \x85 b", "é ​ zero", "!!! ??? ...", "日本語 テキスト", "\n" * 300 + "a"]
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text), text[:50]
