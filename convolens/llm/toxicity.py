"""Toxicity by a weighted finite-state pattern grammar.

1. A bounded sample of labelled documents (``SAMPLE`` rows, by the hash of their id; near copies count once)
   gives the insult lexicon: words and word beginnings that mark toxic documents, counted by grouped
   aggregation, each with its log odds as weight. Threats, targets, negations and verbs of saying are fixed
   short lists, as is a list of common insults for a sample that lacks them.
2. The lexicon is an automaton that runs once over a text. Clauses that hold an insult or a threat become
   symbols and go through the composed transducers (``transducers``); a clause's score is the weight of its
   hits. Words alone score nothing: a negated, reported or unaimed word weighs by its clause.
3. A logistic model over the scores of a text's clauses (all, the heaviest, how many, by length) gives the
   probability. For it, each half of the sample is scored with the lexicon of the other half.

Inputs of a score are texts alone. Rows whose crc32(doc_id as text) modulo ``FOLDS`` is 0 teach nothing.

Defined cases: a null or empty text has no clause, and the score of a text without hits; a null doc_id counts
as the empty text and is held out; labels with a null are left out, and labels that repeat a doc_id count once, toxic if any says so; repeated rows each get a row;
very long texts count whole; without labels of both classes the score is the smoothed rate, or above one half
where the fixed insults weigh enough; an empty table gives no rows; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from convolens.llm.common import materialize, other_columns
from convolens.llm.quality import logistic
from convolens.llm.transducers import END, INSULT, NEGATION, REPORT, TARGET, THREAT, WORD, weigh

SAMPLE = 20_000
FOLDS = 5
#: A form enters the lexicon with so many toxic documents and so large a log likelihood ratio.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 10.0
BEGINNINGS = (4, 5, 6, 7, 8)
#: The weight of fixed insults and threats, in log odds.
SEED_WEIGHT = 2.0

# Short lists in English, German, French and Spanish.
INSULTS = "idiot idiots moron loser scum stupid pathetic worthless dumb trash idiotin dummkopf trottel abschaum versager connard imbécile crétin idiote idiota imbécil estúpido estúpida".split()
THREATS = "kill hurt beat destroy punch stab shoot töten umbringen schlagen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u ya you're du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tu usted ustedes vosotros".split()
NEGATIONS = "not no never n't isn't aren't don't won't wasn't nicht kein keine nie niemals ne pas jamais non no nunca jamás".split()
REPORTS = "said says say called calls wrote writes claimed claims told quoted sagte sagt nannte schrieb behauptet dit disait appelait écrit dijo dice llamó escribió".split()

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?;\n]+")
_FIXED = {w: s for words, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}


def forms(text: str | None) -> set[str]:
    """The words of a text, and the beginnings (marked by *) of its words, which may be the whole word."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) >= k}


@dataclass
class Grammar:
    """The lexicon (form -> weight), and the logistic model over clause scores."""

    lexicon: dict[str, float]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: np.ndarray | None = None
    rate: float = 0.5

    @functools.cached_property
    def automaton(self):
        """All forms at once; a form's value is (length, whole word or not, symbol, weight)."""
        import ahocorasick

        out = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        listed = {w: (INSULT, SEED_WEIGHT) for w in INSULTS} | {w: (THREAT, SEED_WEIGHT) for w in THREATS}
        listed |= {form: (INSULT, weight) for form, weight in self.lexicon.items()}
        for form, (symbol, weight) in listed.items():
            bare = form.rstrip("*")
            entries.setdefault(bare, []).append((len(bare), not form.endswith("*"), symbol, weight))
        for bare, values in entries.items():
            out.add_word(bare, sorted(values, key=lambda v: v[1]))  # the whole word last: it wins
        out.make_automaton()
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def found(self, lower: str) -> dict[int, tuple[int, float]]:
        """Where words begin that the lexicon holds: (symbol, weight), of the longest form."""
        out: dict[int, tuple[int, float]] = {}
        size = len(lower)
        for end, values in self.automaton.iter(lower):
            at = end - values[0][0] + 1
            if at and (lower[at - 1].isalpha() or lower[at - 1] == "'"):
                continue
            for _, whole, symbol, weight in values:
                if not whole or end + 1 == size or not lower[end + 1].isalpha():
                    out[at] = symbol, weight
        return out

    def clauses(self, text: str | None) -> list[float]:
        """The scores of the clauses that hold a hit."""
        lower = (text or "").lower()
        found = self.found(lower)
        if not found:
            return []
        bounds = [0, *(m.end() for m in _END.finditer(lower)), len(lower)]
        scores = []
        for clause in sorted({bisect_right(bounds, at) - 1 for at in found}):
            symbols = []
            for m in _WORD.finditer(lower, bounds[clause], bounds[clause + 1]):
                symbols.append(found.get(m.start()) or (_FIXED.get(m[0], WORD), 0.0))
            score = weigh([*symbols, (END, 0.0)])
            if score:
                scores.append(score)
        return scores

    def features(self, text: str | None) -> list[float]:
        """What the logistic model sees of a text: its clause scores, and no word."""
        scores = self.clauses(text)
        if not scores:
            return [0.0] * WIDTH
        total, thousands = sum(scores), (len(text) + 200) / 1000
        return [1.0, math.log1p(total), max(scores), math.log1p(len(scores)), math.log1p(total / thousands)]

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability that each text is toxic."""
        if not texts:
            return np.empty(0)
        x = np.array([self.features(t) for t in texts])
        if self.weights is None:
            return 1 - (1 - self.rate) * np.exp(-x[:, 1] / 2)
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


WIDTH = 5


def held_out(folds: int = FOLDS) -> Column:
    """Whether a row's label is kept from learning."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0


def sketch(text: str) -> int:
    """The least hash of three words in a row: near copies mostly share it, other texts do not."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(t).encode("utf-8", "surrogatepass")) for t in zip(words, words[1:], words[2:])), default=zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass")))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, folds: int) -> DataFrame:
    """(text, toxic, half) of at most ``sample`` labelled documents that may teach, near copies once."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(folds))
    chosen = usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([sketch(t) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "sketch"])

    rows = texts.mapInArrow(sketched, StructType([*texts.schema.fields, StructField("sketch", LongType())]))
    once = rows.groupBy("sketch", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("text"))
    return materialize(once.select("text", "toxic", F.pmod(F.xxhash64("sketch", F.lit(7)), F.lit(2)).cast("int").alias("half")), "labelled")


def _counted(labelled: DataFrame) -> DataFrame:
    """(form, n0, k0, n1, k1): documents and toxic documents that hold a form, in each half."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns)):
                for form in forms(text):
                    row = seen.setdefault(form, [0, 0, 0, 0])
                    row[2 * half] += 1
                    row[2 * half + 1] += toxic
            columns = list(zip(*seen.values())) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["form", "n0", "k0", "n1", "k1"])

    rows = labelled.select("text", "toxic", "half").mapInArrow(count, "form string, n0 long, k0 long, n1 long, k1 long")
    return rows.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("n0", "k0", "n1", "k1")])


def _marking(counted: DataFrame, n: Column, k: Column, total: int, toxic: int) -> dict[str, float]:
    """Log odds of the forms that mark toxic documents, from the counts ``n`` and ``k``."""
    if not 0 < toxic < total:
        return {}
    base = toxic / total
    rate = (F.col("k") + 2 * base) / (F.col("n") + 2)
    ratio = F.col("k") * F.log(rate / base) + (F.col("n") - F.col("k")) * F.log((1 - rate) / (1 - base))
    chosen = counted.select("form", n.alias("n"), k.alias("k")).where(F.col("k") >= LEAST_DOCUMENTS).withColumn("rate", rate).withColumn("ratio", ratio)
    # each of the sample's toxic documents marks at most its own forms, and LEAST_DOCUMENTS of them are needed for one
    rows = chosen.where((F.col("rate") > 3 * base) & (F.col("ratio") > LEAST_RATIO)).collect()
    counts = {r["form"]: r["k"] for r in rows}
    whole = Counter()
    for form, k_ in counts.items():
        if not form.endswith("*"):
            for b in BEGINNINGS:
                whole[form[:b] + "*"] = max(whole[form[:b] + "*"], k_)
    prior = math.log(base / (1 - base))
    # a beginning that one word accounts for says no more than that word
    return {r["form"]: math.log(r["rate"] / (1 - r["rate"])) - prior for r in rows if not (r["form"].endswith("*") and whole[r["form"]] >= 0.9 * r["k"])}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> Grammar:
    """The grammar's lexicon and model, from a bounded sample of labelled documents."""
    labelled = labelled_sample(docs, labels, sample, folds)
    tally = {(r["half"], r["toxic"]): r["n"] for r in labelled.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    at = lambda half: (tally.get((half, 0), 0) + tally.get((half, 1), 0), tally.get((half, 1), 0))
    counted = materialize(_counted(labelled), "forms")
    c = F.col
    halves = [Grammar(_marking(counted, c(f"n{h}"), c(f"k{h}"), *at(h))) for h in (0, 1)]
    total, toxic = (a + b for a, b in zip(at(0), at(1)))
    grammar = Grammar(_marking(counted, c("n0") + c("n1"), c("k0") + c("k1"), total, toxic), rate=(toxic + 0.1) / (total + 1))
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value[1 - half].features(text) for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = labelled.select("text", "toxic", "half").mapInArrow(rows, "x array<double>, toxic int").collect()  # at most SAMPLE rows of WIDTH numbers
    x, y = np.array([r["x"] for r in got]).reshape(-1, WIDTH), np.array([r["toxic"] for r in got], float)
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, *x.T))
        x, y = x[order], y[order]
        grammar.mean, grammar.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        grammar.weights = logistic(grammar.design(x), y)
    return grammar


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """(_row, score, predicted, held_out) of every row; ``_row`` has all columns but ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, folds))
    rows = docs.select(other_columns(docs), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())], names=["_row", "score"])

    scored = rows.mapInArrow(run, StructType([rows.schema["_row"], StructField("score", DoubleType())]))
    kept_out = F.crc32(F.coalesce(F.col("_row.doc_id").cast("string"), F.lit(""))) % folds == 0
    return scored.select("_row", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), kept_out.alias("held_out"))


def report(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted."""
    return judge(docs.select("doc_id", "text"), labels, **parameters).select("_row.doc_id", "held_out", "score", "predicted")
