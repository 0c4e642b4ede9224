"""Marked scripts: messages whose chunks are tagged and which say what chunks were received.

A script is ``<message uuid="u" active="0,1"><chunk id=0>text</chunk>...</message>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbers(texts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.trim(x).cast("long"))))


def message_uuid(script: Column) -> Column:
    """The uuid of the first message; null without one."""
    return F.nullif(F.regexp_extract(script, r'<message uuid="([^"]+)"', 1), F.lit(""))


def active_ids(script: Column) -> Column:
    """The chunks received, in ascending order; none without the attribute."""
    return _numbers(F.split(F.regexp_extract(script, r'active="([^"]+)"', 1), ","))


def chunk_ids(script: Column) -> Column:
    """All chunks tagged, in ascending order."""
    return _numbers(F.regexp_extract_all(script, F.lit(r"<chunk id=(\d+)>"), 1))


def missing_ids(script: Column) -> Column:
    """The chunks that were tagged but not received."""
    return F.array_except(chunk_ids(script), active_ids(script))


def plain_text(script: Column) -> Column:
    """The script without the tags of messages and chunks."""
    return F.regexp_replace(script, r"<message[^>]*>|</message>|<chunk[^>]*>|</chunk>", "")


def chunk_texts(script: Column) -> Column:
    """(id, text) of the chunks without inner tags, in the order of the script."""
    pattern = F.lit(r"<chunk id=(\d+)>([^<]*)</chunk>")
    ids = F.transform(F.regexp_extract_all(script, pattern, 1), lambda x: x.cast("long"))
    return F.arrays_zip(ids.alias("id"), F.regexp_extract_all(script, pattern, 2).alias("text"))


def merge_scripts(rows: DataFrame, group: str, order: str, script: str) -> DataFrame:
    """(group, script): each message once, in the order of first appearance, from its first template, with all chunks received.

    A template without the attribute ``active`` stays as it is; scripts without a uuid do not count, and a group
    without any has a null. Chunk numbers are gathered as a set, so that a group of many rows is combined before
    it is shuffled.
    """
    text = F.col(script)
    marked = rows.select(F.col(group), F.col(order).alias("_pos"), text.alias("_script"), message_uuid(text).alias("_uuid"))
    exploded = marked.withColumn("_id", F.explode_outer(active_ids(F.col("_script"))))
    messages = exploded.groupBy(group, "_uuid").agg(F.min("_pos").alias("_first"), F.min_by("_script", "_pos").alias("_script"), F.array_sort(F.collect_set("_id")).alias("_ids"))
    content = F.regexp_extract("_script", r'(?s)<message uuid="[^"]+" active="[^"]+">(.+)</message>', 1)
    active = F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",")
    merged = F.when(content == "", F.col("_script")).otherwise(F.concat(F.lit('<message uuid="'), "_uuid", F.lit('" active="'), active, F.lit('">'), content, F.lit("</message>")))
    part = F.when(F.col("_uuid").isNotNull(), F.struct(F.col("_first"), merged.alias("_merged")))
    parts = messages.groupBy(group).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return parts.select(group, F.when(F.size("_parts") > 0, F.array_join(F.transform("_parts", lambda p: p["_merged"]), "")).alias("script"))
