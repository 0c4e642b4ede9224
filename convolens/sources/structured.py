"""Structured files of mixed formats, read by their ending, and leaderboard entries chosen by a manifest."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.sources import runs

#: fixed values: endings of structured and of plain files, names of the manifest and of an entry's file, folders that are no entries
YAML, TOML, JSON, PLAIN = ("yaml", "yml"), ("toml",), ("json",), ("txt", "md")
MANIFEST, ENTRY, NO_ENTRY = "manifest.json", "submission.json", r"^(\.|A_EXAMPLE)"


def _loaded(ending: str, content: bytes) -> str:
    """A file's value as JSON text; dates and times as ISO text."""
    text = content.decode("utf-8")
    if ending in YAML:
        import yaml

        value = yaml.safe_load(text)
    elif ending in TOML:
        value = tomllib.loads(text)
    elif ending in JSON:
        value = json.loads(text)
    elif ending in PLAIN:
        value = text
    else:
        raise ValueError(f"unsupported ending: {ending}")
    return json.dumps(value, ensure_ascii=False, default=lambda x: x.isoformat() if hasattr(x, "isoformat") else str(x))


def read_structured(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, doc VARIANT, reason) of every file below files, folders or globs, read by its ending.

    Spark's reader lists and fetches the files, from any store, and tasks parse them, one file at a time. A file that cannot be
    read has a null doc and the reason; its path stays, so that nothing is lost silently.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    row = (path, _loaded(path.rpartition(".")[2].lower(), content.as_py()), None)
                except Exception as e:  # any parser's error becomes a row
                    row = (path, None, f"{type(e).__name__}: {e}"[:500])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=["path", "json", "reason"])

    rows = files.mapInArrow(parse, "path string, json string, reason string")
    doc = F.try_parse_json("json")
    return rows.select("path", doc.alias("doc"), F.coalesce("reason", F.when(F.col("json").isNotNull() & doc.isNull(), "no JSON value")).alias("reason"))


def entry_names(spark: SparkSession, folder: str) -> list[str]:
    """The entries of a leaderboard: those that its manifest lists, without one the folders that hold an entry's file."""
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).load(root).select("content").limit(1)
    found = listed.select(F.from_json(F.col("content").cast("string"), "submissions ARRAY<STRING>, voice_submissions ARRAY<STRING>").alias("m")).first()
    if found is not None and found["m"] is not None:
        return list(dict.fromkeys([*(found["m"]["submissions"] or []), *(found["m"]["voice_submissions"] or [])]))
    files = spark.read.format("binaryFile").load(f"{root}/*/{ENTRY}").select(F.element_at(F.split("path", "/"), -2).alias("name"))
    return sorted(r["name"] for r in files.where(~F.col("name").rlike(NO_ENTRY)).collect())


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """``runs.submissions`` of the entries that ``entry_names`` gives: no other file is opened.

    A listed entry without a file is passed over.
    """
    root, names = folder.rstrip("/"), entry_names(spark, folder)
    wanted = "{" + ",".join(names) + "}" if names else "{}"
    return runs.submissions(spark, root, wanted)
