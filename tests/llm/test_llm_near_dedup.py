"""MinHash near-dedup against exact similarities of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
from conftest import DATA, compare
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import near_dedup
from convolens.llm.graph import connected_components
from convolens.llm.queries import ORACLE_SQL, QUERIES


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    root = {doc: doc for doc, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, one), (b, two) in combinations(sets, 2):
        if one and two and 100 * len(one & two) >= 75 * len(one | two):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((doc, len(s), find(doc), doc == find(doc)) for doc, s in sets)


def edited_copies(text, n, edits, seed):
    rng, words, out = random.Random(seed), text.split(), []
    for _ in range(n):
        own = list(words)
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_against_all_pairs(spark):
    rows = odd_rows()
    rows += [(100 + k, t) for k, t in enumerate(edited_copies(prose(3, 200), 120, 3, 1))]  # a group that is in long lists
    rows += [(300 + k, t) for k, t in enumerate(edited_copies(prose(4, 60), 60, 2, 2))]  # some of these are under the limit
    rows += [(400 + k, prose(5, 80) + prose(1000 + k, 60)) for k in range(60)]  # a shared passage, no near copies
    rows += [(500 + k, prose(6, 90)) for k in range(200)]  # exact copies
    got = near_dedup.find_groups(table(spark, rows))
    assert sorted(tuple(r) for r in got.where("doc_id is not null").collect()) == expected(rows)
    lost = got.where("doc_id is null").collect()
    assert len(lost) == 2 and all(r["component_id"] is None for r in lost)


def test_near_copies_that_only_share_common_passages(spark):
    rng, base = random.Random(1), " ".join(f"b{j}" for j in range(150))
    passages = [" ".join(f"p{k}x{j}" for j in range(16)) for k in range(30)]
    rows = [(k, " ".join([base] + [passages[p] for p in sorted(rng.sample(range(30), 5))])) for k in range(500)]
    got = near_dedup.find_groups(table(spark, rows), short=2, rare=2, chunk=80)  # 500 texts and lists of 2 stand for many more
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_pairs_among_pages_of_one_template(spark):
    """600 pairs of similarity 0.762 among 1,200 pages that are 0.728 alike: each pair is found, and no other."""
    template = " ".join(f"t{j}" for j in range(304))
    own = lambda name, n: " ".join(f"{name}w{j}" for j in range(n))
    rows = [(k, f"{template} {own(f'pair{k // 2}', 8)} {own(f'page{k}', 48)}") for k in range(1200)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.find_groups(table(spark, rows)).collect()}
    assert got == {k: k // 2 * 2 for k in range(1200)}


def test_a_block_returns_a_forest():
    sets = [np.arange(at, at + 100) for at in (0, 1, 2, 3, 500, 501, 900)]
    links = near_dedup.links_of_block(sets, np.array([0, 0, 1, 2, 3, 4, 5]), None)
    assert len(links) == 4 and {frozenset(x) for x in links} >= {frozenset((4, 5))}
    assert near_dedup.links_of_block(sets, np.arange(7), np.array([1, 1, 1, 1, 1, 1, 0], bool)) == []


def test_one_of_each_group_stays(spark):
    rows = odd_rows()
    docs = with_clashes(table(spark, rows))
    kept = near_dedup.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    wanted = {d for d, _, _, stays in expected(rows) if stays}
    assert {r["doc_id"] for r in kept.collect()} == wanted | {None}


def test_empty_table(spark):
    assert near_dedup.find_groups(table(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = spark.range(200).selectExpr("(id * 37) % 201 as a", "((id + 1) * 37) % 201 as b")
    got = connected_components(pairs).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}


def test_query_against_sql(spark, duck):
    compare(QUERIES["op10_minhash_near_dedup"](spark, DATA), duck, ORACLE_SQL["op10_minhash_near_dedup"])
