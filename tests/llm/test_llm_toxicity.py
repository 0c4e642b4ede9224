"""Toxicity: the composed grammar against rules over word positions, the scan against a plain search, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import odd_rows, table, with_clashes

from convolens.llm import toxicity
from convolens.llm import transducers as T

LABELS = "doc_id long, quality int, toxic int"


def by_position(clause):
    """What the grammar weighs, told from word positions."""
    total, waiting, named, left = 0.0, None, None, 0
    saying = aimed = False
    negated_at = None
    for at, (symbol, weight) in enumerate(clause):
        near = negated_at is not None and at - negated_at <= T.REACH
        if symbol == T.INSULT:
            total += weight * (T.NEGATED if near else 1) * (T.REPORTED if saying else 1) * (T.AIMED if aimed else 1)
        elif symbol == T.NEGATION:
            negated_at = at
        elif symbol == T.REPORT:
            saying = True
        elif symbol == T.TARGET:
            aimed = True
            if waiting is not None and at - waiting[0] <= T.REACH:
                total += waiting[1]
                waiting = named = None
            else:
                waiting, named = None, at
        elif symbol == T.THREAT and not near and not saying:
            if named is not None and at - named <= T.REACH:
                total += weight
                waiting = named = None
            else:
                waiting, named = (at, weight), None
    return total


def test_the_composition_follows_the_rules():
    rng = random.Random(4)
    for _ in range(4000):
        clause = [(s, float(rng.randint(1, 5)) if s in (T.INSULT, T.THREAT) else 0.0) for s in rng.choices((T.WORD, T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT), (4, 2, 2, 2, 1, 1), k=rng.randrange(12))]
        assert T.weigh([*clause, (T.END, 0.0)]) == pytest.approx(by_position(clause)), clause


def test_an_end_resets_every_machine():
    for symbols in ([T.NEGATION], [T.REPORT], [T.TARGET], [T.THREAT], [T.NEGATION, T.TARGET, T.WORD, T.REPORT]):
        state = 0
        for s in [*symbols, T.END]:
            state = T.GRAMMAR.moves[state, s][0]
        assert state == 0


def test_clauses():
    grammar = toxicity.Grammar({"blarg*": 3.0, "zonk": 4.0})
    score = lambda text: sum(grammar.clauses(text))
    assert score("a zonk there") == 4.0 and score("zonks there") == 0 and score("a blargish thing") == 3.0 and score("unblarg") == 0
    assert score("not a zonk there") == pytest.approx(0.8)
    assert score("he said zonk") == pytest.approx(1.6)
    assert score("you zonk") == 6.0 and score("you. zonk") == 4.0
    assert score("I will hurt you") == toxicity.SEED_WEIGHT and score("I will not hurt you") == 0 and score("it may hurt a lot") == 0 and score("they said they will hurt you") == 0
    assert len(grammar.clauses("zonk. fine. zonk zonk\nblarg! nothing")) == 3
    assert grammar.clauses(None) == grammar.clauses("") == []


def test_the_scan_finds_what_a_search_of_every_word_finds():
    rng = random.Random(6)
    lexicon = {"".join(rng.choices("abé", k=rng.randint(1, 4))) + rng.choice(("", "*")): float(rng.randint(1, 9)) for _ in range(12)}
    grammar = toxicity.Grammar(lexicon)
    for _ in range(500):
        text = "".join(rng.choices("abé .'x1", (5, 5, 2, 3, 1, 1, 1, 1), k=rng.randrange(40)))
        wanted = {}
        for m in re.finditer(r"[^\W\d_]+", text):
            if m.start() and text[m.start() - 1] == "'":
                continue
            for length in range(len(m[0]), 0, -1):
                forms = ([m[0]] if length == len(m[0]) else []) + [m[0][:length] + "*"]
                hit = next((lexicon[f] for f in forms if f in lexicon), None)
                if hit is not None:
                    wanted[m.start()] = (T.INSULT, hit)
                    break
        assert grammar.found(text) == wanted, (text, lexicon)


def test_odd_rows(spark):
    docs = with_clashes(table(spark, [*odd_rows(), (500, "you idiot. you stupid loser"), (501, "İ you Idiot " * 3)]))
    labels = spark.createDataFrame([(8, 1, 0), (8, 0, 1), (None, 1, 1), (9, 1, None), (77, 1, 1)], LABELS)
    for known in (labels, labels.where("false")):
        got = toxicity.report(docs, known)
        assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in rows)
        by_id = {r.doc_id: r.score for r in rows}
        assert by_id[500] > by_id[12] == by_id[13]
    assert toxicity.report(table(spark, []), labels).count() == 0


def test_near_copies_teach_once_and_held_out_labels_never(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(k, text + f" end{k}") for k in range(60)] + [(100 + k, f"other text number {k} with words v{k} u{k}") for k in range(20)]
    labels = spark.createDataFrame([(d, 1, int(d < 60)) for d, _ in rows], LABELS)
    sample = toxicity.labelled_sample(table(spark, rows), labels, 1000, 5).collect()
    assert sum(r.toxic for r in sample) < 6 and sum(1 - r.toxic for r in sample) == sum(zlib.crc32(str(d).encode()) % 5 != 0 for d in range(100, 120))


def test_held_out_documents(spark):
    path = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(path + "documents.parquet"), spark.read.parquet(path + "labels.parquet")
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    rows = [(known[r.doc_id], r.predicted) for r in toxicity.report(docs, labels).where("held_out").collect() if r.doc_id in known]
    clean = np.array([p for (_, toxic), p in rows if not toxic])
    toxic = np.array([p for (quality, toxic), p in rows if toxic and quality])
    assert len(toxic) > 50 and toxic.mean() > 0.95 and clean.mean() < 0.01
