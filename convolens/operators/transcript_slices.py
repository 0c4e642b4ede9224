"""Provider transcripts spread over the ticks in which their speech was heard.

Transcripts that lie close are one. Each goes to the first segment of ticks, in order, that ends after it starts:
segments in order have ends that do not fall back once their running maximum is taken, so the greedy first-come
choice is an as-of match. Within its segment a transcript shows, tick by tick, the share of its characters that
the speech heard so far is of it; the cursor never goes back (a running maximum), and the last tick gets the rest.

All steps are windows by simulation or by transcript, and joins by simulation and segment or time cell.

Ticks are (simulation_id, tick, spoken, start_ms, end_ms): ``spoken`` marks ticks with user text, null times keep a tick
from its segment but do not end it. Transcripts are (simulation_id, start_ms, end_ms, text). A null text is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolens.operators.intervals import overlaps

GAP_MS = 500
#: Width of the time cells in which ticks and transcripts meet.
CELL_MS = 2000


def joined_transcripts(transcripts: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """(simulation_id, t, start, end, text): transcripts that overlap or are at most ``gap`` apart as one, in order of time."""
    order = Window.partitionBy("simulation_id").orderBy("start_ms", "end_ms", "text")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = transcripts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_new", F.coalesce((F.col("start_ms") > before + gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("t", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    listed = F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    return rows.groupBy("simulation_id", "t").agg(F.min("start_ms").alias("start"), F.max("end_ms").alias("end"), F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"))


def numbered_ticks(ticks: DataFrame) -> DataFrame:
    """Timed ticks with user text and ``seg``, the number of their run of consecutive such ticks."""
    order = Window.partitionBy("simulation_id").orderBy("tick")
    spoken = ticks.where("spoken")
    fresh = F.coalesce((F.col("tick") - F.lag("tick").over(order) > 1).cast("int"), F.lit(1))
    run = spoken.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order)).where("start_ms is not null and end_ms is not null")
    return run.withColumn("seg", F.dense_rank().over(Window.partitionBy("simulation_id").orderBy("_run")) - 1).select("simulation_id", "tick", "seg", "start_ms", "end_ms")


def assigned(transcripts: DataFrame, segments: DataFrame) -> DataFrame:
    """``transcripts`` with ``seg``: the first that ends after they start or starts when they have ended, else the last.

    ``segments`` are (simulation_id, seg, seg_start, seg_end). Both sides go through one order and the next segment is carried back.
    """
    upto = Window.partitionBy("simulation_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    grown = segments.select("simulation_id", "seg", F.max("seg_end").over(upto).alias("far_end"), F.max("seg_start").over(upto).alias("far_start"), F.max("seg").over(Window.partitionBy("simulation_id")).alias("last"))

    def ahead(rows: DataFrame, at: str, far: str, strict: bool, name: str) -> DataFrame:
        sides = rows.select("*", F.col(at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast("long").alias("_seg"))
        marks = grown.select("simulation_id", F.col(far).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.col("seg").cast("long").alias("_seg"))
        later = Window.partitionBy("simulation_id").orderBy(F.col("_at").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
        both = sides.unionByName(marks, allowMissingColumns=True).withColumn(name, F.min("_seg").over(later))
        return both.where("t is not null").drop("_at", "_side", "_seg")

    met = ahead(ahead(transcripts, "start", "far_end", True, "_ends"), "end", "far_start", False, "_starts")
    last = grown.groupBy("simulation_id").agg(F.max("last").alias("last"))
    return met.join(last, "simulation_id").withColumn("seg", F.coalesce(F.least("_ends", "_starts"), "last")).drop("_ends", "_starts", "last")


def distribute(ticks: DataFrame, transcripts: DataFrame, gap: int = GAP_MS) -> DataFrame:
    """(simulation_id, tick, user_transcript) of every timed tick with user text; null where nothing is shown."""
    placed = numbered_ticks(ticks)
    segments = placed.groupBy("simulation_id", "seg").agg(F.min_by("start_ms", "tick").alias("seg_start"), F.max_by("end_ms", "tick").alias("seg_end"), F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"))
    given = assigned(joined_transcripts(transcripts, gap), segments).join(segments, ["simulation_id", "seg"])
    size = F.length("text")
    ids = given.select("simulation_id", F.struct("seg", "t").alias("id"), "start", "end")
    spans = placed.select("simulation_id", F.struct("seg", "tick", "end_ms").alias("id"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    meets = overlaps(ids, spans, "simulation_id", CELL_MS).where("left_id.seg = right_id.seg").select("simulation_id", "left_id.seg", "left_id.t", "right_id.tick", F.col("right_id.end_ms").alias("end_ms"))
    shown = meets.join(given.select("simulation_id", "seg", "t", "start", "end", "text"), ["simulation_id", "seg", "t"])
    heard = F.least("end_ms", "end") - F.col("start")
    upto = F.when(F.col("end") <= F.col("start"), size).otherwise(F.ceil(F.least(F.lit(1.0), heard / (F.col("end") - F.col("start"))) * size))
    cursor = shown.select("simulation_id", "seg", "t", "tick", upto.cast("long").alias("upto"))
    # speech that ended before its segment is shown whole on the first tick
    early = given.where("end <= seg_start").select("simulation_id", "seg", "t", F.col("first_tick").alias("tick"), size.cast("long").alias("upto"))
    order = Window.partitionBy("simulation_id", "seg", "t").orderBy("tick")
    sofar = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, 0))
    steps = cursor.unionByName(early).groupBy("simulation_id", "seg", "t", "tick").agg(F.max("upto").alias("upto")).withColumn("at", sofar)
    steps = steps.withColumn("was", F.coalesce(F.lag("at").over(order), F.lit(0)))
    texts = given.select("simulation_id", "seg", "t", "text", "last_tick")
    pieces = steps.join(texts, ["simulation_id", "seg", "t"]).select("simulation_id", "tick", F.lit(0).alias("rest"), "t", F.substr("text", F.col("was").cast("int") + 1, (F.col("at") - F.col("was")).cast("int")).alias("piece"))
    reached = steps.groupBy("simulation_id", "seg", "t").agg(F.max("at").alias("reached"))
    rest = texts.join(reached, ["simulation_id", "seg", "t"], "left").select("simulation_id", F.col("last_tick").alias("tick"), F.lit(1).alias("rest"), "t", F.substr("text", F.coalesce("reached", F.lit(0)).cast("int") + 1).alias("piece"))
    parts = pieces.unionByName(rest).where("piece <> ''").groupBy("simulation_id", "tick").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rest", "t", "piece"))), lambda x: x["piece"]), " ").alias("user_transcript"))
    return placed.select("simulation_id", "tick").join(parts, ["simulation_id", "tick"], "left")
