"""The prefix trie against a trie of whole tuples built one conversation at a time."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import DATA, compare

from convolens.llm import prefix_trie
from convolens.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    """Nodes as sets of members over explicit tuples of (role, text)."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    turns = {c: [(t[3], t[4]) for t in sorted(own)] for c, own in by_conv.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in rebuilt.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    nodes = [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]
    return sorted(nodes, key=str)


def check(spark, rows, frame=None):
    df = frame if frame is not None else spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(df)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(kind == "bigint" for name, kind in got.dtypes if name != "ends_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows)


def random_rows(seed, convs, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * convs), convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(("user", "assistant", None)), rng.choice(("", None, "a", "a", "bé", "ccc"))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    check(spark, random_rows(seed, 120))


def test_small_blocks_and_chunks(spark, monkeypatch):
    """Long conversations over many blocks and parts, long end lists over many chunks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = random_rows(3, 60, 40) + [(c, t, "user", f"same {t}") for c in range(1000, 1050) for t in range(3)] + [(2000, t, "user", f"long {t}") for t in range(400)]
    check(spark, rows)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, a long text, clashing columns, no table rows."""
    from pyspark.sql import functions as F

    rows = [(None, 0, "user", "x"), (1, None, "user", "first"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "b", "tie"), (1, 0, "a", "tie"), (5, 3, "user", "long " * 50_000), (5, 2, "", ""), (7, 1, "u", "z"), (2**40, 1, "u", "z"), (-7, 1, "u", "z"), (8, 1, "u:", "z"), (9, 1, "u", ":z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    check(spark, rows, frame.withColumns({name: F.lit(1) for name in ("pos", "digest", "size", "part", "depth", "k1", "rep", "length", "h", "base")}))
    check(spark, [], spark.createDataFrame([], SCHEMA))


def test_a_conversation_without_turns_ends_at_the_root(spark):
    lone = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    check(spark, [(lone, 0, "user", "only")])


def test_query_equals_sql(spark, duck):
    compare(QUERIES["op13_prefix_trie"](spark, DATA), duck, ORACLE_SQL["op13_prefix_trie"])
