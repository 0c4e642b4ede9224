"""An index of vectors in coarse cells, for exact top-k search by cosine that reads few of them.

Centroids come from a bounded sample (``SAMPLE`` vectors by the hash of their id); every vector is stored in order of
its nearest centroid's cell and of its angle to that, by ranges, so that neither a small cell nor a crowded one is a file. A cell knows its greatest angle. By the triangle
inequality of angles a query at angle a from a centroid is at least a - r from all of a cell of radius r, and at least
|a - b| from a vector at b. So a search first scores the most promising cells that hold k vectors, and then only the
cells, and of them the stretches of angles, that can still hold a better one. Results equal a full scan; how much is read depends
on how well the vectors form cells. Vectors without length score 0 against all, in a cell of their own.

Cells grow as the square root of the vectors, up to ``MOST_CELLS``; what is known of them (centroid, radius, count) is a row a cell,
and is all that the driver holds and queries are sent with.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from convolens.operators.nearest import Nearest, matrix
from convolens.operators.retrieval import cosine, query_blocks
from convolens.sources.scratch import shared_path

SAMPLE, MOST_CELLS, ROUNDS = 20_000, 2048, 8
#: Angles are compared with this much room, for what rounding may have lost.
SLACK = 1e-6
NO_LENGTH = -1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centroids_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids by spherical k-means, from the sample's first vectors on."""
    points = _unit(sample)
    centroids = points[:cells].copy()
    for _ in range(ROUNDS):
        home = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        met = np.linalg.norm(sums, axis=1) > 1e-9
        centroids[met] = _unit(sums[met])
    return centroids


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


@dataclass
class VectorIndex:
    """The stored vectors (vec_id, embedding, angle, cell), and of each cell its centroid, radius and number of vectors."""

    vectors: DataFrame
    cells: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None) -> VectorIndex:
        """Index all rows (vec_id, embedding) with a vector; ``path`` keeps the index for later sessions (``load``)."""
        spark = vectors.sparkSession
        path = path or shared_path(spark, "vectors")
        length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        rows = vectors.where("embedding is not null").select("vec_id", "embedding")
        usable = rows.where(length > 0)
        n = usable.count()
        sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
        wanted = max(1, min(MOST_CELLS, len(sample), cells or math.isqrt(n)))
        centroids = centroids_of(np.array(sample.tolist(), float), wanted) if len(sample) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast(centroids)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dots = _unit(_matrix(batch.column(1))) @ shared.value.T
                home = dots.argmax(axis=1) if len(dots) else np.zeros(0, int)
                angle = np.arccos(np.clip(dots[np.arange(len(dots)), home], -1, 1)) if len(dots) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angle, pa.float64()), pa.array(home, pa.int32())], names=["vec_id", "embedding", "angle", "cell"])

        kind = StructType([*rows.schema.fields, StructField("angle", DoubleType()), StructField("cell", IntegerType())])
        lone = rows.where(~F.coalesce(length > 0, F.lit(False))).select("*", F.lit(0.0).alias("angle"), F.lit(NO_LENGTH).alias("cell"))
        placed = usable.mapInArrow(place, kind).unionByName(lone)
        placed.repartitionByRange("cell", "angle", "vec_id").sortWithinPartitions("cell", "angle").write.parquet(f"{path}/vectors")
        head = [(k, [float(x) for x in c], None) for k, c in enumerate(centroids)] + [(None, None, kind.json())]
        spark.createDataFrame(head, "cell int, centroid array<double>, vectors string").coalesce(1).write.parquet(f"{path}/cells")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """A stored index."""
        head = spark.read.parquet(f"{path}/cells")
        kind = StructType.fromJson(json.loads(head.where("cell is null").first()["vectors"]))
        vectors = spark.read.schema(kind).parquet(f"{path}/vectors")
        known = {r["cell"]: r["centroid"] for r in head.where("cell is not null").collect()}
        stats = sorted((r["cell"], r["far"], r["n"]) for r in vectors.groupBy("cell").agg(F.max("angle").alias("far"), F.count("*").alias("n")).collect())
        width = len(next(iter(known.values()), [0.0]))
        return cls(vectors, np.array([c for c, _, _ in stats], int), np.array([known.get(c, [0.0] * width) for c, _, _ in stats], float).reshape(-1, width), np.array([f for _, f, _ in stats], float), np.array([n for _, _, n in stats], int))

    def _nearest_angles(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The query's angle to each centroid, and to the nearest vector that each cell may hold."""
        norm = np.linalg.norm(query)
        if not len(self.cells):
            return np.zeros(0), np.zeros(0)
        at = np.arccos(np.clip(self.centroids @ (query / norm), -1, 1)) if norm > 0 else np.full(len(self.cells), math.pi / 2)
        at = np.where(self.cells == NO_LENGTH, math.pi / 2, at)
        # all of the cell without length are at a right angle; to a query without length every vector is
        near = np.full(len(self.cells), math.pi / 2) if norm == 0 else np.where(self.cells == NO_LENGTH, math.pi / 2, np.maximum(0, at - self.radius))
        return at, near

    def _first(self, near: np.ndarray, k: int) -> np.ndarray:
        """Positions of the most promising cells that together hold ``k`` vectors."""
        order = np.argsort(near, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1]

    def _scored(self, positions: np.ndarray, query: list[float]) -> DataFrame:
        rows = self.vectors.where(F.col("cell").isin([int(self.cells[p]) for p in positions]))
        return rows.select("vec_id", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))

    def search(self, query: list[float], k: int) -> tuple[DataFrame, int]:
        """The ``k`` nearest (vec_id, score), ties to the smaller vec_id, and how many vectors were scored at most."""
        at, near = self._nearest_angles(np.array(query, float))
        first = self._first(near, k)
        best = lambda df: df.orderBy(F.desc("score"), "vec_id").limit(k)
        held = best(self._scored(first, query)).collect()  # k rows
        if len(held) < k:
            reach = math.pi
        else:
            reach = math.acos(max(-1.0, min(1.0, held[-1]["score"]))) + SLACK
        more = np.array([p for p in np.flatnonzero(near <= reach) if p not in set(first.tolist())], int)
        kept = self.vectors.sparkSession.createDataFrame([(r["vec_id"], r["score"]) for r in held], StructType([self.vectors.schema["vec_id"], StructField("score", DoubleType())]))
        if not len(more):
            return best(kept), int(self.counts[first].sum())
        # of each further cell only vectors whose own angle leaves them within reach
        near_enough = F.lit(False)
        for p in more:
            near_enough = near_enough | ((F.col("cell") == int(self.cells[p])) & F.col("angle").between(float(at[p] - reach), float(at[p] + reach)))
        near_enough = near_enough if NO_LENGTH not in self.cells[more] else near_enough | (F.col("cell") == NO_LENGTH)
        rows = self.vectors.where(F.col("cell").isin([int(self.cells[p]) for p in more]) & near_enough)
        further = rows.select("vec_id", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("score"))
        return best(kept.unionByName(further)), int(self.counts[first].sum() + self.counts[more].sum())

    def _wanted(self, queries: np.ndarray, reach: np.ndarray | None, k: int) -> np.ndarray:
        """Which cells (columns) each query (rows) is to meet: the nearest that hold ``k`` vectors, or all others within ``reach``."""
        out = np.zeros((len(queries), len(self.cells)), bool)
        for start in range(0, len(queries) if len(self.cells) else 0, 512):
            some = slice(start, start + 512)
            norms = np.linalg.norm(queries[some], axis=1)
            at = np.arccos(np.clip(_unit(queries[some]) @ self.centroids.T, -1, 1))
            at[:, self.cells == NO_LENGTH] = math.pi / 2
            at[norms == 0] = math.pi / 2
            first = np.zeros(at.shape, bool)
            nearest = at.argmin(axis=1)
            first[np.arange(len(at)), nearest] = True
            few = np.flatnonzero(self.counts[nearest] < k)
            order = np.argsort(at[few], axis=1, kind="stable")
            upto = np.cumsum(self.counts[order], axis=1) - self.counts[order]
            first[few[:, None], order] = upto < k
            if reach is not None:
                near = np.where((self.cells == NO_LENGTH) | (norms == 0)[:, None], math.pi / 2, at - self.radius)
                first = ~first & (near <= reach[some][:, None] + SLACK)
            out[some] = first
        return out

    def _met(self, asked: pa.Table, kind_of_query: DataType, k: int, reach: np.ndarray | None = None) -> DataFrame:
        """(at, query_id, vec_id, score): the best ``k`` that tasks find for each query, in the cells that ``_wanted`` names.

        With ``reach`` known, what lies beyond it is left out; ``at`` is the query's place in ``asked``.
        """
        spark = self.vectors.sparkSession
        width = self.centroids.shape[1]
        rows, odd = matrix(_column(asked, "query"), width)
        least = None if reach is None else np.cos(np.minimum(reach + SLACK, math.pi))
        shared = spark.sparkContext.broadcast((self, _column(asked, "query_id"), rows, odd, reach, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, names, queries, odd, reach, least = shared.value
            best, kind, wanted = Nearest(queries, k, odd, least), None, None
            for batch in batches:
                kind = batch.schema.field(0).type
                if wanted is None:
                    wanted = index._wanted(queries, reach, k)
                vectors, without = matrix(batch.column(1), width)
                homes = batch.column(2).to_numpy(zero_copy_only=False)
                for cell in np.unique(homes):
                    at = np.flatnonzero(homes == cell)
                    among = np.flatnonzero(wanted[:, np.searchsorted(index.cells, cell)])
                    best.add(batch.column(0).take(pa.array(at)), vectors[at], without[at], among)
            if kind is not None:
                at, ids, scores = best.rows(kind)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), names.take(pa.array(at)), ids, pa.array(scores)], names=["at", "query_id", "vec_id", "score"])

        kinds = StructType([StructField("at", IntegerType()), StructField("query_id", kind_of_query), self.vectors.schema["vec_id"], StructField("score", DoubleType())])
        return self.vectors.select("vec_id", "embedding", "cell").mapInArrow(run, kinds)

    def _batch(self, queries: DataFrame, k: int) -> DataFrame:
        """``batch`` for at most ``MAX_QUERIES`` queries, which are broadcast."""
        spark = queries.sparkSession
        asked = queries.select("query_id", "query").toArrow()
        order = Window.partitionBy("at").orderBy(F.desc("score"), "vec_id")
        kind = queries.schema["query_id"].dataType
        found = self._met(asked, kind, k).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
        path = shared_path(spark, "nearest")
        found.write.parquet(path)
        found = spark.read.schema(found.schema).parquet(path)
        reach = np.full(asked.num_rows, math.pi)
        for row in found.groupBy("at").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k).collect():  # a row for a query
            reach[row["at"]] = math.acos(max(-1.0, min(1.0, row["worst"])))
        return found.unionByName(self._met(asked, kind, k, reach)).select("query_id", "vec_id", "score")

    def batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the ``k`` nearest of each query (query_id, query), ties to the smaller vec_id.

        Queries go to the tasks in blocks of at most ``MAX_QUERIES``, twice: to the cells that may hold the best, and with the
        score of the k-th of these to the other cells within its reach. A task makes products of a cell's vectors and the
        queries that want the cell (see ``nearest``) and passes on a query's best ``k``, not a row for each pair.
        """
        found = [self._batch(block, k) for block in query_blocks(queries)]
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return reduce(DataFrame.unionByName, found).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")

    def __getstate__(self):
        """What tasks need: the cells, not the table."""
        return {name: getattr(self, name) for name in ("cells", "centroids", "radius", "counts")}
