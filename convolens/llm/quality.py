"""Quality classifier: document evidence combined with host and path posteriors (empirical Bayes).

1. A bounded sample of labelled documents (``SAMPLE`` rows, by the hash of their id) gives a lexicon of
   words and word beginnings that mark toxic documents, counted by grouped aggregation, and two
   logistic models (low quality, toxic) over lexicon and shape features of the text.
2. The models give every document its evidence: the probability that it should be rejected.
3. Grouped sums of the evidence give every host and every path below it a posterior rate. A path
   shrinks toward its host and a host toward the global rate, by prior weights that the method of
   moments draws from the spread between groups; a sparse site so keeps close to the global prior.
4. The path's posterior replaces the global prior in the document's log odds. A document whose
   posterior reaches ``THRESHOLD`` is rejected.

Hosts are ``source`` and paths ``lang`` below it in the documents table; both are parameters.

Defined cases: a null or empty text has the features of a text without words. A null host or path is
the group ''. A missing host or path column makes one group. Labels with a null are left out, labels
that repeat a doc_id count once (as low quality or toxic if any says so). A very long text counts whole. Where the sample lacks one
of the two classes, the evidence is the smoothed rate alone. Repeated documents each get a row. An empty
table of documents or labels gives no rows, or the smoothed rate as evidence. Extra columns of any name are carried by ``keep_good``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from convolens.llm import tokens
from convolens.llm.common import materialize, other_columns, row_columns

SAMPLE = 20_000
#: A feature enters the lexicon with so many toxic documents and so large a log likelihood ratio.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 10.0
THRESHOLD = 0.5
#: Most paths whose posteriors are broadcast (about 100 bytes each); more are joined by shuffle.
MAX_BROADCAST_PATHS = 50_000
SALTS = 64
_WORD = re.compile(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_BEGINNINGS = (4, 5, 6)
_PUNCTUATION = np.array([33 <= c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 127 for c in range(256)])


def lexical(text: str | None) -> set[str]:
    """The words of a text, and the beginnings (marked by *) of its longer words."""
    out = set(_WORD.findall(text.lower())) if text else set()
    for word in list(out):
        out.update(word[:k] + "*" for k in _BEGINNINGS if len(word) > k)
    return out


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Lexicon and shape features of a text."""
    text = text or ""
    marks = []
    for word in set(_WORD.findall(text.lower())):
        for form in (word, *(word[:k] + "*" for k in _BEGINNINGS if len(word) > k)):
            weight = lexicon.get(form)
            if weight is not None:
                marks.append(weight)
    marks.sort(reverse=True)
    data = text.encode("utf-8", "surrogatepass")
    at = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, words = max(1, len(data)), text.split()
    counts, n = Counter(words), max(1, len(words))
    distinct = len(counts) / n
    return [
        marks[0] if marks else 0.0,
        sum(marks[1:4]),
        math.log1p(len(marks)),
        at[65:91].sum() / size,
        at[_PUNCTUATION].sum() / size,
        at[48:58].sum() / size,
        distinct,
        max(counts.values(), default=0) / n,
        size / n,
        math.log(n + 1),
        counts.get("|", 0) / n,
        sum(1 for word in words if len(word) > 1 and word.isupper()) / n,
        distinct * math.log(n + 1) / 5,
    ]


@dataclass
class Model:
    """A lexicon, the standardisation of features, and a weight vector for each of the two heads."""

    lexicon: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    heads: list[np.ndarray | float]

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(np.hstack([z, z * z, np.ones((len(x), 1))]), -8, 8)

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """The probability that a document is of low quality or toxic."""
        if not texts:
            return np.empty(0)
        good = np.ones(len(texts))
        z = self.design(np.array([features(t, self.lexicon) for t in texts])) if any(isinstance(h, np.ndarray) for h in self.heads) else None
        for head in self.heads:
            p = 1 / (1 + np.exp(-np.clip(z @ head, -30, 30))) if isinstance(head, np.ndarray) else head
            good = good * (1 - p)
        return 1 - good


def logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton's method."""
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, bad, toxic) of at most ``sample`` labelled documents, chosen by the hash of their id."""
    usable = labels.where("doc_id is not null and quality is not null and toxic is not null")
    chosen = usable.groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("bad"), (F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return materialize(texts.select("text", "bad", "toxic"), "labelled")


def toxic_lexicon(labelled: DataFrame, total: int, toxic: int) -> dict[str, float]:
    """Log odds weights of the features that mark toxic documents the most clearly."""
    if not 0 < toxic < total:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, marked = Counter(), Counter()
            for text, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = lexical(text)
                seen.update(own)
                if flag:
                    marked.update(own)
            names = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[x] for x in names], pa.int64()), pa.array([marked[x] for x in names], pa.int64())], names=["feature", "n", "k"])

    base = toxic / total
    rate = (F.col("k") + 2 * base) / (F.col("n") + 2)
    ratio = F.col("k") * F.log(rate / base) + (F.col("n") - F.col("k")) * F.log((1 - rate) / (1 - base))
    counted = labelled.select("text", "toxic").mapInArrow(count, "feature string, n long, k long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    marking = counted.where(F.col("k") >= LEAST_DOCUMENTS).withColumn("rate", rate).withColumn("ratio", ratio).where((F.col("rate") > 3 * base) & (F.col("ratio") > LEAST_RATIO))
    # so many marks can the bounded sample give: three of its toxic documents each
    rows = marking.collect()
    return {r["feature"]: math.log(r["rate"] / (1 - r["rate"])) - math.log(base / (1 - base)) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The two heads, from a bounded sample of labelled documents."""
    labelled = labelled_sample(docs, labels, sample)
    total, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    lexicon = toxic_lexicon(labelled, total, toxic)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "bad", "toxic"])

    got = labelled.select("text", "bad", "toxic").mapInArrow(rows, "x array<double>, bad int, toxic int").collect()
    width = len(features("", {}))
    x = np.array([r["x"] for r in got]).reshape(-1, width)
    order = np.lexsort(x.T) if len(x) else []
    x, targets = x[order], [np.array([r[name] for r in got], float)[order] for name in ("bad", "toxic")]
    model = Model(lexicon, x.mean(axis=0) if len(x) else np.zeros(width), x.std(axis=0) + 1e-9 if len(x) else np.ones(width), [])
    for y in targets:
        both = len(y) and 0 < y.sum() < len(y)
        model.heads.append(logistic(model.design(x), y) if both else float((y.sum() + 0.1) / (len(y) + 1)))
    return model


def with_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with the column ``evidence``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            p = shared.value.evidence(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "evidence"])

    return rows.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields), StructField("evidence", DoubleType())]))


def prior_weight(groups: DataFrame, rate: str, toward: str) -> float:
    """How many documents the prior counts for: the method of moments over groups (n, rate)."""
    spread = F.col(rate) - F.col(toward)
    noise = F.col(toward) * (1 - F.col(toward))
    row = groups.agg(F.sum(F.col("n") * spread * spread), F.sum(noise), F.sum("n"), F.sum(F.col("n") * noise)).first()
    if not row[2]:
        return 1.0
    between = ((row[0] or 0.0) - row[1]) / row[2]
    within = row[3] / row[2]
    return min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) of every path, and the global rate, of (host, path, p) rows."""
    paths = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = (s + 0.01) / (n + 1) if n else 0.01
    hosts = hosts.withColumn("rate", F.col("s") / F.col("n")).withColumn("toward", F.lit(overall))
    weight = prior_weight(hosts, "rate", "toward")
    hosts = hosts.select("host", ((F.col("s") + weight * overall) / (F.col("n") + weight)).alias("host_rate"))
    below = paths.join(hosts, "host").withColumn("rate", F.col("s") / F.col("n"))
    weight = prior_weight(below, "rate", "host_rate")
    return below.select("host", "path", "host_rate", ((F.col("s") + weight * F.col("host_rate")) / (F.col("n") + weight)).alias("path_rate")), overall


def _groups(docs: DataFrame, host: str, path: str) -> tuple:
    return tuple(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in (host, path))


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, threshold: float = THRESHOLD, texts: bool = True) -> DataFrame:
    """(_row, text, evidence, host, path, host_rate, path_rate, posterior, kept) of every row of ``docs``.

    Without ``texts`` the column text is null. The evidence is computed once and written.
    """
    model = fit(docs, labels, sample)
    host_column, path_column = _groups(docs, host, path)
    rows = docs.select(other_columns(docs), "text", host_column.alias("host"), path_column.alias("path"))
    judged = with_evidence(rows, model)
    judged = materialize(judged if texts else judged.withColumn("text", F.lit(None).cast("string")), "evidence")
    rates, overall = posteriors(judged.select("host", "path", F.col("evidence").alias("p")))
    rates = materialize(rates, "rates")
    if rates.count() <= MAX_BROADCAST_PATHS:
        joined = judged.join(F.broadcast(rates), ["host", "path"], "left")
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("_row", "evidence"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"], "left")
    p = F.least(F.greatest("evidence", F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = lambda x: F.log(x / (1 - x))
    posterior = 1 / (1 + F.exp(logit(F.lit(overall)) - logit(p) - logit(F.col("path_rate"))))
    return joined.select("_row", "text", "evidence", "host", "path", "host_rate", "path_rate", posterior.alias("posterior")).withColumn("kept", F.col("posterior") < threshold)


def report(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """One row per document row: doc_id, host, path, evidence, host_rate, path_rate, posterior, kept."""
    names = [c for c in ("doc_id", "text", "source", "lang") if c in docs.columns]
    return judge(docs.select(*names), labels, texts=False, **parameters).select("_row.doc_id", "host", "path", "evidence", "host_rate", "path_rate", "posterior", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return judge(docs, labels, **parameters).where("kept").select(*row_columns(docs.columns))
