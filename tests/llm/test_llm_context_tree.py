"""Context-tree weighting against a plain recursion over dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import odd_rows, prose, table, with_clashes

from convolens.llm import context_tree

DEPTH = context_tree.DEPTH


def lowered(text):
    return (text or "").encode().lower()


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def decisions(data):
    """(context of DEPTH bytes, node, bit) of every decision of a text and its end."""
    padded = bytes(DEPTH) + data + b"\0"
    for i in range(DEPTH, len(padded)):
        for k in range(8):
            yield padded[i - DEPTH : i], (1 << k) | (padded[i] >> (8 - k)), (padded[i] >> (7 - k)) & 1


def log_kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


class Tree:
    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        longer = defaultdict(set)
        for data in texts:
            for context, node, bit in decisions(data):
                for d in range(DEPTH + 1):
                    self.n[context[DEPTH - d :], node][bit] += 1
                    if d:
                        longer[context[DEPTH - d + 1 :], node].add((context[DEPTH - d :], node))
        self.split, weighted = {}, {}
        for key in sorted(self.n, key=lambda k: -len(k[0])):
            own = log_kt(*self.n[key])
            if len(key[0]) == DEPTH:
                weighted[key] = own
            else:
                self.split[key] = sum(weighted[k] for k in longer[key])
                top = max(own, self.split[key])
                weighted[key] = top + math.log(math.exp(own - top) + math.exp(self.split[key] - top)) - math.log(2)

    def log10(self, data):
        total = 0.0
        for context, node, bit in decisions(data):
            done, left, last = 0.0, 1.0, 0.5
            for d in range(DEPTH + 1):
                key = (context[DEPTH - d :], node)
                if key not in self.n:
                    break
                n0, n1 = self.n[key]
                last = (n1 + 0.5) / (n0 + n1 + 1)
                if d < DEPTH:
                    share = 1 / (1 + math.exp(min(700, self.split[key] - log_kt(n0, n1))))
                    done, left = done + left * share * last, left * (1 - share)
            one = min(max(done + left * last, 1e-12), 1 - 1e-12)
            total += math.log10(one if bit else 1 - one)
        return total


def expected(rows):
    training = [lowered(t) for d, t in rows if not held_out(d)]
    tree = Tree(training)
    words = Counter(w for t in training for w in re.findall(rb"[^\x20\x09-\x0D]+", t))
    counts = Counter(words)
    counts[None] = len(training)
    total, distinct = sum(counts.values()), sum(1 for n in counts.values() if n)
    out = []
    for doc, text in rows:
        own = [counts[w] for w in re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))] + [counts[None]]
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (distinct + 1))) for c in own)
        out.append((doc, held_out(doc), len(own), sum(c > 0 for c in own), total, pytest.approx(base, rel=1e-9), pytest.approx(tree.log10(lowered(text)), rel=1e-6)))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


def test_against_the_recursion(spark):
    rows = [(d, t if t is None else t[:400]) for d, t in odd_rows()] + [(50 + k, prose(k, 20, 60)) for k in range(25)]
    got = context_tree.score_documents(with_clashes(table(spark, rows)))
    assert ordered(tuple(r) for r in got.collect()) == ordered(expected(rows))


def test_without_training_documents(spark):
    held = next(d for d in range(100) if held_out(d))
    row = context_tree.score_documents(table(spark, [(held, "ab c")])).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_tokens"] == 3 and row["n_known"] == 0
    assert row["score"] == pytest.approx(5 * math.log10(1 / 256))
    assert row["base_score"] == pytest.approx(0)


def test_empty_table(spark):
    assert context_tree.score_documents(table(spark, [])).count() == 0


def test_held_out_texts_beat_the_base_and_very_long_texts_pass(spark):
    rows = [(k, prose(k, 150, 300)) for k in range(120)] + [(500, "word " * 300_000)]
    got = [r for r in context_tree.score_documents(table(spark, rows)).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
