"""Document retrieval: grep, BM25 and cosine scores, fusion by the greatest score, and top-k.

Documents have ``doc_id`` and ``text``. Ties go to the smaller doc_id. BM25 weighs all tokens
once and makes postings of the asked ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from convolens.functions.text import tokens, valid_pattern
from convolens.operators.nearest import ByWidth

#: fixed values: the published parameters of BM25 in its Okapi form
K1, B, EPSILON = 1.5, 0.75, 0.25


def grep(docs: DataFrame, pattern: str, ignore_case: bool = True) -> DataFrame:
    """(doc_id, score): how often the pattern occurs, documents without it left out."""
    wanted = ("(?i)" if ignore_case else "") + valid_pattern(pattern)
    return docs.select("doc_id", F.regexp_count("text", F.lit(wanted)).cast("double").alias("score")).where("score > 0")


@dataclass
class Bm25Index:
    """Token lists (doc_id, length, tokens), token weights and the mean length of a corpus.

    The weights, a row for each distinct token, are kept on the executors' disks. Postings are made of
    the asked tokens only, in one pass over the token lists, so that no shuffle carries whole texts.
    """

    split: DataFrame
    weights: DataFrame
    mean_length: float

    @classmethod
    def build(cls, docs: DataFrame) -> Bm25Index:
        split = docs.select("doc_id", tokens(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("length"), "tokens")
        n, mean = split.agg(F.count("*"), F.avg("length")).first()
        counts = split.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        raw = counts.select("token", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")).persist(StorageLevel.DISK_ONLY)
        floor = EPSILON * (raw.agg(F.avg("idf")).first()[0] or 0.0)
        return cls(split, raw.select("token", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf")), mean or 0.0)

    def postings(self, asked: DataFrame) -> DataFrame:
        """(doc_id, length, token, tf) of the tokens in ``asked`` (token)."""
        rows = self.split.select("doc_id", "length", F.explode("tokens").alias("token")).join(asked, "token", "left_semi")
        return rows.groupBy("doc_id", "length", "token").agg(F.count("*").alias("tf"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of documents that share a token with a query (query_id, query)."""
        asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
        found = self.postings(asked.select("token").distinct()).join(asked.join(self.weights, "token"), "token")
        norm = K1 * (1 - B + B * F.col("length") / self.mean_length)
        part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        return found.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))), F.lit(0.0))


def cosine_search(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(vec_id, score) of all vectors against one query vector."""
    return vectors.select("vec_id", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))


#: Most queries of one batch: they are broadcast.
MAX_QUERIES = 10_000


def cosine_batch(vectors: DataFrame, queries: DataFrame, k: int, parts: int = 64) -> DataFrame:
    """(query_id, vec_id, score): the k nearest vectors of each query (query_id, query).

    Queries are broadcast, after a check of their number. Vectors are dealt into ``parts`` parts that find each
    query's best of their own by blocked products (see ``nearest``), so that no query's scores meet in one task.
    """
    n = queries.count()
    if n > MAX_QUERIES:
        raise ValueError(f"{n} queries in one batch; at most {MAX_QUERIES} are broadcast")
    asked = queries.select("query_id", "query")
    shared = queries.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = ByWidth(shared.value, k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            best.add(batch)
        if kind is not None:
            yield from best.batches(kind, ["query_id", "vec_id", "score"])

    kinds = StructType([asked.schema["query_id"], StructField("vec_id", vectors.schema["vec_id"].dataType), StructField("score", DoubleType())])
    scored = vectors.select("vec_id", "embedding").repartition(parts, "vec_id").mapInArrow(run, kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select("query_id", "vec_id", "score")


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """Queries (query_id, query) in blocks of at most ``MAX_QUERIES`` rows, dealt by a hash."""
    blocks = 1
    same = Window.partitionBy("query_id", "query").orderBy("query_id")
    rows = queries.select("query_id", "query", F.row_number().over(same).alias("_copy"))  # equal rows are dealt apart
    while True:
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64("query_id", "query", "_copy"), F.lit(blocks)))
        most = dealt.groupBy("_block").count().agg(F.max("count")).first()[0] or 0
        if most <= MAX_QUERIES:
            break
        blocks = max(blocks + 1, blocks * most // MAX_QUERIES)
    return [queries] if blocks == 1 else [dealt.where(F.col("_block") == b) for b in range(blocks)]


def cosine_batches(vectors: DataFrame, queries: DataFrame, k: int, parts: int = 64) -> DataFrame:
    """``cosine_batch`` for any number of queries: dealt by a hash into blocks that each fit one batch.

    Rows of one query_id are ranked together again after the blocks.
    """
    blocks = query_blocks(queries)
    if len(blocks) == 1:
        return cosine_batch(vectors, blocks[0], k, parts)
    every = reduce(DataFrame.unionByName, [cosine_batch(vectors, block, k, parts) for block in blocks])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def rerank(scored: DataFrame, rating: Column, least: float, k: int) -> DataFrame:
    """The k best by a rating from 0 to 10 (clamped) that is at least ``least``; ties to the smaller doc_id."""
    clamped = F.least(F.greatest(rating.cast("double"), F.lit(0.0)), F.lit(10.0))
    return top_k(scored.withColumn("score", clamped), k, least)


def fuse(*results: DataFrame) -> DataFrame:
    """The greatest raw score of each document over several results."""
    every = results[0].select("doc_id", "score")
    for other in results[1:]:
        every = every.unionByName(other.select("doc_id", "score"))
    return every.groupBy("doc_id").agg(F.max("score").alias("score"))


def top_k(scored: DataFrame, k: int, least: float | None = None, key: str = "doc_id") -> DataFrame:
    """The k best rows, of at least a score if given; a top-k sort, not a sort of everything."""
    kept = scored if least is None else scored.where(F.col("score") >= least)
    return kept.orderBy(F.desc("score"), key).limit(k)


def filled_top_k(scored: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best documents, those without a score counting as 0."""
    every = docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top_k(every, k)
