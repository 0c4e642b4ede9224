"""Token-id files: documents in ascending doc_id order, written as checksummed chunks and read back.

The documents are dealt by ranges of doc_id and sorted, so that the files in part order hold them in
ascending order. A file is Parquet whose rows are chunks (see ``idcoder``): ``part``, ``chunk``,
``n_docs``, ``n_ids`` and the binary ``payload``; each chunk can be read alone. Spark's writer commits
the files, so a lost executor leaves no partial file behind.

Defined cases: a null or empty text is the end id alone. A very long text stays in one chunk, which grows by it. A null doc_id comes first, as null. Rows that
repeat a doc_id follow one another in the order of their texts (nulls first). An empty table writes
no chunk. Extra columns are not kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.llm import idcoder, tokens
from convolens.llm.common import parallelism, scratch_path

END = 2
#: A chunk is closed after so many ids, at the end of a document.
CHUNK_IDS = 2_000_000
CHUNKS = "part int, chunk int, n_docs long, n_ids long, payload binary"


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, chunk_ids: int = CHUNK_IDS, parts: int | None = None) -> None:
    """Encode the documents and write their files to the folder ``path``."""
    vocabulary = tokenizer or tokens.default_path()
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, chunk = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0
        names, documents, held = [], [], 0

        def close() -> pa.RecordBatch:
            row = [[part], [chunk], [len(names)], [held], [idcoder.pack_chunk(names, documents)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["part", "chunk", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.column(batch.column(1))):
                names.append(doc)
                documents.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= chunk_ids:
                    yield close()
                    names, documents, held, chunk = [], [], 0, chunk + 1
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    parts = parts or parallelism(docs.sparkSession)
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id")).sortWithinPartitions(*order)
    dealt.mapInArrow(run, CHUNKS).write.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. All checksums are verified."""
    chunks = spark.read.schema(CHUNKS).parquet(path)
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_part_start"))
    within = Window.partitionBy("part").orderBy("chunk")
    starts = chunks.select("part", "chunk", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("_chunk_start")).join(before_part, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, documents = idcoder.unpack_chunk(batch.column(2)[row].as_py())
                lengths = np.array([len(d) // 4 for d in documents], np.int64)
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * n, pa.int32()),
                        pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                        pa.array(names, pa.int64()),
                        pa.array(np.cumsum(lengths) - lengths),
                        pa.array(lengths),
                        pa.array([zlib.crc32(d) for d in documents], pa.int64()),
                    ],
                    names=["part", "chunk", "doc_id", "_start", "n_tokens", "ids_crc32"],
                )

    rows = chunks.select("part", "chunk", "payload").mapInArrow(run, "part int, chunk int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    placed = rows.join(starts, ["part", "chunk"])
    return placed.select("doc_id", (F.col("_part_start") + F.col("_chunk_start") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, **parameters) -> DataFrame:
    """Write all documents as files in the shared folder and report them from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_files(docs, path, **parameters)
    return read_files(spark, path)
