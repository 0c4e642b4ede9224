"""Token-id files: exact round trips, order, checksums."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import idcoder, token_files, tokens
from convolens.llm.common import scratch_path


def library_ids(text):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def expected(rows):
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library_ids(text)
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize(("chunk_ids", "parts"), [(2_000_000, None), (3000, 3), (1, 1)])
def test_files_hold_all_ids_in_order(spark, chunk_ids, parts):
    rows = odd_rows() + [(100 + k, prose(k, k * 7)) for k in range(20)]
    got = token_files.round_trip(with_clashes(table(spark, rows)), chunk_ids=chunk_ids, parts=parts)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark):
    assert token_files.round_trip(table(spark, [])).count() == 0


def test_chunks_round_trip():
    rng = random.Random(3)
    for vocabulary in (1, 2, 70, 50257):
        documents = []
        for n in (0, 1, 5, 3000, 0, 2500):
            word = [rng.randrange(vocabulary) for _ in range(40)]
            documents.append(np.array([rng.choice(word) if rng.random() < 0.8 else rng.randrange(vocabulary) for _ in range(n)], "<u4").tobytes())
        names = [None, -5, 0, 1, 2**62, 9]
        assert idcoder.unpack_chunk(idcoder.pack_chunk(names, documents)) == (names, documents)
    assert idcoder.unpack_chunk(idcoder.pack_chunk([], [])) == ([], [])


def test_coder_beats_general_compression_and_order_0_on_documents():
    """Token ids of documents take fewer bits than their order-0 entropy, and than zstd makes of them."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    documents = [x + np.array([2], "<u4").tobytes() for x in tokens.encoder(tokens.default_path())(texts)]
    ids = np.frombuffer(b"".join(documents), "<u4")
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum()
    bits = 8 * len(idcoder.pack_chunk(list(range(len(documents))), documents)) / len(ids)
    assert bits < entropy < 8 * len(zstandard.ZstdCompressor(level=3).compress(ids.tobytes())) / len(ids)


def test_damage_is_seen():
    chunk = bytearray(idcoder.pack_chunk([1], [np.arange(4000, dtype="<u4").tobytes()]))
    for at in (0, len(chunk) // 2, len(chunk) - 40):
        broken = bytearray(chunk)
        broken[at] ^= 0x41
        with pytest.raises(ValueError):
            idcoder.unpack_chunk(bytes(broken))


def test_files_can_be_read_again(spark):
    path = scratch_path(spark, "again")
    token_files.write_files(table(spark, [(2, "b"), (1, "a")]), path)
    assert [r["doc_id"] for r in token_files.read_files(spark, path).orderBy("start").collect()] == [1, 2]


def test_words_are_cut_as_the_library_cuts_texts():
    rng, encode = random.Random(5), tokens.Encoder(tokens.default_path())
    parts = [" ", " ", "  ", "a", "bé", "1", "'s", "'ll", "'", ",", "€", "\n", "\t", "\r\n", "\xa0", "\u3000", "中", "<|endoftext|>", "²", "_", "ɏ", "\x1c", "\u0301", "🙂", "Word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    library = encode.pieces.library
    assert encode(texts) == encode(texts) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]


def test_a_word_goes_to_the_library_once_whatever_follows_it():
    encode, asked = tokens.Encoder(tokens.default_path()), []
    ask = encode.words.library_ids
    encode.words.library_ids = encode.pieces.library_ids = lambda piece: asked.append(piece) or ask(piece)
    text = "x word word, word. word... words word,\nword"
    assert encode([text, text]) == [library_ids(text)[:-1].tobytes()] * 2
    assert sorted(asked) == sorted(["x", " word", ",", ".", "...", " words", "\nword"])


def test_carries_run_through_full_words():
    words = np.array([[7, 2**32 - 1, 2**32 - 1, 0], [1, 2, 3, 0]], np.uint32)
    idcoder._carry(words, np.array([0, 1]), np.array([3, 2]))
    assert words.tolist() == [[8, 0, 0, 0], [1, 3, 3, 0]]


def test_a_range_loses_nothing_where_words_are_put_out():
    """7.971 bits an id before carries, 7.920 with them; a range was cut short where its ends differed in the upper word."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    documents = [x + np.array([2], "<u4").tobytes() for x in tokens.encoder(tokens.default_path())(texts)]
    assert 8 * len(idcoder.pack_chunk(list(range(len(documents))), documents)) / (sum(map(len, documents)) // 4) < 7.95


def test_a_prior_without_followers_takes_few_bytes():
    """7.920 bits an id with -4 where ids or pairs have no follower, 7.883 with 0."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    documents = [x + np.array([2], "<u4").tobytes() for x in tokens.encoder(tokens.default_path())(texts)]
    assert 8 * len(idcoder.pack_chunk(list(range(len(documents))), documents)) / (sum(map(len, documents)) // 4) < 7.9


def test_words_with_one_mark_at_the_end_are_cut_without_expressions(monkeypatch):
    encode = tokens.Encoder(tokens.default_path())
    encode([",", ".", "!"])
    monkeypatch.setattr(tokens, "_LED", None)
    text = "x word, école. straße! Ça, b"
    assert encode([text]) == [library_ids(text)[:-1].tobytes()]


def test_phrases_take_fewer_bits_than_ids():
    """7.883 bits an id where every id is a symbol, 6.924 with phrases."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    documents = [x + np.array([2], "<u4").tobytes() for x in tokens.encoder(tokens.default_path())(texts)]
    ids = np.frombuffer(b"".join(documents), "<u4")
    symbols, phrases = idcoder.Phrases.of(ids)
    assert len(symbols) < 0.7 * len(ids) and (phrases.ids(symbols)[0] == ids).all()
    assert 8 * len(idcoder.pack_chunk(list(range(len(documents))), documents)) / len(ids) < 7


def test_phrases_overlap_and_repeat():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(5000), np.tile([1, 1, 2], 900), np.tile([7, 7, 7, 9], 700), rng.integers(0, 3, 6000), np.arange(70_000), np.tile(np.arange(70_000), 2), [2**20]):
        ids = np.asarray(ids, "<u4")
        symbols, phrases = idcoder.Phrases.of(ids)
        assert (idcoder.Phrases.unpacked(phrases.packed()).ids(symbols)[0] == ids).all()
        assert phrases.size <= max(idcoder.MOST_SYMBOLS, len(phrases.own))
    with pytest.raises(ValueError):
        idcoder.Phrases(np.arange(3, dtype="<u4"), np.array([3 << 16], np.uint32))


def test_columns_are_cut_as_the_library_cuts_texts(monkeypatch):
    rng, encode = random.Random(6), tokens.Encoder(tokens.default_path())
    parts = [" ", " ", "  ", "a", "bé", "1", "'s", "'ll", "'", ",", "€", "\n", "\n\n", "\t", "\r\n", "\xa0", "　", "中", "<|endoftext|>", "×", "ɏ", "ɐ", "\x1c", "́", "🙂", "Word", "***", "\x00", "Ġ", "x" * 70]
    plain = [p for p in parts if p not in ("\xa0", "　", "<|endoftext|>")]
    texts = [None, *("".join(rng.choice(some) for _ in range(rng.randrange(12))) for some in (parts, plain) for _ in range(3000))]
    whole = [np.array(x.ids, "<u4").tobytes() for x in encode.library.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
    column = pa.array(texts)
    assert list(encode.column(column)) == list(encode.column(column)) == whole
    assert list(encode.column(column.slice(7, 900))) == whole[7:907] and list(encode.column(column.slice(0, 0))) == []
    monkeypatch.setattr(tokens, "SLICE_BYTES", 50)
    monkeypatch.setattr(tokens, "CACHED_PIECES", 20)
    assert list(encode.column(column)) == whole
    assert len(encode.met) == len(encode.starts) <= 40 and all(len(key) <= tokens.CACHED_LENGTH for key in encode.met)


def test_words_of_a_column_go_to_the_model_together(monkeypatch):
    encode = tokens.Encoder(tokens.default_path())
    model, calls = encode.model, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return model.encode_batch_fast(texts, **options)

    monkeypatch.setattr(encode, "model", Counted())
    text = " ".join(prose(k, 200) for k in range(5))
    assert list(encode.column(pa.array([text, text]))) == [library_ids(text)[:-1].tobytes()] * 2
    assert len(calls) <= 2
