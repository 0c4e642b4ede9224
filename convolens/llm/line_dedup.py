"""Line dedup: levelled sorted runs of line hashes, each new batch merge-anti-joined with them.

Documents arrive in batches of ascending doc_id. A batch first hashes its lines (128 bits of the
key), then merges them with the sorted runs that earlier batches left: a hash found there was first
seen in an earlier document. What the runs do not hold is new, and becomes a run of its own on
level 0. Runs lie in sorted buckets, so that only the batch is shuffled and sorted. As soon as a level holds ``FANOUT`` runs, they are merged into one run on the next level, so
that a batch meets a number of runs that is logarithmic in the number of batches.

A line is dropped if its key was seen in a smaller doc_id, in an earlier batch or in its own. Hashes
with more rows in a batch than a bucket's share, of which there are fewer than buckets, are broadcast,
so that a line that all documents hold does not meet in one task. Only the dropped (doc_id, hash)
pairs return to the documents, one list per document.

Key of a line: the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of fewer
than ``MIN_KEY`` code points are never dropped. Defined cases: a null or empty text is one empty
line; repeated rows of one doc_id are one document to the keys, and each row gets its own result; a
row with a null doc_id keeps all its lines and claims none; an empty table gives an empty result.
Extra columns of any name are carried by ``dedup_lines``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from convolens.llm import tokens
from convolens.llm.common import ASCII_SPACE, materialize, other_columns, parallelism, row_columns, scratch_path

MIN_KEY = 10
BATCHES = 4
FANOUT = 3


def key_hash(line: str, min_key: int = MIN_KEY) -> bytes | None:
    """128 bits of the line's key, or None for a key too short to count."""
    key = line.strip(ASCII_SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= min_key else None


def hash_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The distinct (doc_id, line hash) pairs of each row, keys too short left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.release()
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {key_hash(line, min_key) for line in text.split("\n")} - {None}
                ids.extend([doc] * len(own))
                hashes.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["doc_id", "h"])

    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, h binary")


class SortedRuns:
    """Levels of runs; each run is a table (h, first_doc) in the shared folder, in buckets of h sorted by h.

    A batch is shuffled and sorted once and then merged with one run after another, as they lie.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets, self.levels = spark, fanout, parallelism(spark), [[]]

    def runs(self) -> list[DataFrame]:
        """All runs; a hash is in one of them only."""
        return [run for level in self.levels for run in level]

    def find(self, own: DataFrame) -> DataFrame:
        """``own`` with ``seen``, the document of the run that holds h; null in the rows of the anti-join."""
        out = own.withColumn("seen", F.lit(None).cast("long"))
        for run in self.runs():
            out = out.join(run.withColumnRenamed("first_doc", "_at").hint("merge"), "h", "left").withColumn("seen", F.coalesce("seen", "_at")).drop("_at")
        return out

    def add(self, own: DataFrame) -> DataFrame:
        """Look up ``own`` (h, first_doc, ...); what no run holds is a new run on level 0, and full levels are merged.

        Returns what ``find`` does, from the stored rows.
        """
        found = self._stored(self.find(own), 0)
        self.levels[0].append(found.where("seen is null").select("h", "first_doc"))
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = level[0]
            for run in level[1:]:
                merged = merged.unionByName(run)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._stored(merged.repartition(self.buckets, "h"), k + 1))
            self.levels[k] = []
        return found

    def _stored(self, rows: DataFrame, level: int) -> DataFrame:
        """``rows``, which are partitioned by h, as a table of sorted buckets; its files outlive its name."""
        path = scratch_path(self.spark, f"lines-level{level}")
        name = f"lines_{uuid.uuid4().hex}"
        ordered = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(ordered)
        self.spark.conf.set(ordered, "true")  # a bucket is one file, so a scan of it is in order
        try:
            rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        finally:
            self.spark.conf.set(ordered, before)
        stored = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return stored


def batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """The doc_ids at which a new batch begins, for batches of about equal numbers of rows."""
    at = [k / batches for k in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, at)), F.lit(1000)).alias("at")).first()["at"] if at else None
    return sorted(set(found or []))


def dropped_lines(docs: DataFrame, min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The (doc_id, h) pairs of lines that a smaller doc_id holds too."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, batches)
    number = F.lit(0)
    for bound in bounds:
        number = number + (F.col("doc_id") >= bound).cast("int")
    lines = materialize(hash_lines(docs, min_key).withColumn("batch", number), "line-hashes")
    rows = {r["batch"]: r["count"] for r in lines.groupBy("batch").count().collect()}  # one row a batch
    runs, dropped = SortedRuns(spark, fanout), None
    for k in sorted(rows):
        batch = lines.where(F.col("batch") == k).select("doc_id", "h")
        own = batch.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
        found = runs.add(own)
        repeated = found.where("seen is not null or n > 1").select("h", F.coalesce("seen", "first_doc").alias("first_doc"), "n")
        share = rows[k] / runs.buckets
        common = repeated.where(F.col("n") > share).drop("n")  # fewer hashes than buckets, whatever the batch
        rare = batch.join(F.broadcast(common), "h", "left_anti").join(repeated.where(F.col("n") <= share).drop("n").hint("merge"), "h")
        late = batch.join(F.broadcast(common), "h").unionByName(rare).where("doc_id > first_doc").select("doc_id", "h")
        dropped = late if dropped is None else dropped.unionByName(late)
    return lines.select("doc_id", "h").limit(0) if dropped is None else dropped


def cut_lines(docs: DataFrame, min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(_row, text, n_lines, n_dropped): every row with its text less the repeated lines."""
    lists = dropped_lines(docs, min_key, batches, fanout).groupBy("doc_id").agg(F.collect_set("h").alias("gone"))
    rows = docs.select(other_columns(docs), F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(lists, "doc_id", "left").select("_row", "text", "gone")
    schema = StructType([joined.schema["_row"]]).add("text", StringType()).add("n_lines", LongType()).add("n_dropped", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                if gone:
                    gone = set(gone)
                    kept = [line for line in lines if key_hash(line, min_key) not in gone]
                    texts.append("\n".join(kept))
                else:
                    kept = lines
                    texts.append(text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            arrays = [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "text", "n_lines", "n_dropped"])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs``, all rows and columns, with repeated lines cut from ``text``."""
    return cut_lines(docs, **parameters).select(*row_columns(docs.columns))


def line_report(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document row: doc_id, n_lines, n_dropped, kept_sha256."""
    kept = cut_lines(docs.select("doc_id", "text"), **parameters)
    return kept.select("_row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
