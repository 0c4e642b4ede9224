"""Answers of judge models as typed rows, with a table of the answers that could not be read.

An answer is text around one JSON value. Reading never fails and never drops: ``read_*`` give the rows that
were read, and ``dead_letters`` those that were not, with the reason and the whole answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: severities that each side's errors may have, those that are critical for a user, and states of authentication
SEVERITIES = {"user": ("minor", "critical_helped", "critical_hindered"), "agent": ("minor", "critical")}
CRITICAL = ("critical_helped", "critical_hindered")
AUTH_STATES = ("succeeded", "failed", "not_needed")
UNREADABLE = "Could not parse response"


def json_of_answer(answer: Column) -> Column:
    """The first fenced block, else the text from the first { to the last }, else the whole answer."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)```", 1)
    has_fence = answer.rlike(r"(?s)```(?:json)?\s*.*?```")
    braces = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.when(has_fence, F.trim(fenced)).when(braces != "", braces).otherwise(answer)


def parsed(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """``answers`` with ``doc`` (VARIANT, null if unreadable) and ``reason``: no answer, no json, broken json, no object."""
    text = json_of_answer(F.col(answer))
    rows = answers.withColumn("_text", text).withColumn("doc", F.try_parse_json("_text"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    reason = F.when(F.col(answer).isNull(), "no answer").when(~F.contains("_text", F.lit("{")) & F.col("doc").isNull(), "no json").when(F.col("doc").isNull(), "broken json").when(~is_object, "no object")
    return rows.withColumn("reason", reason).drop("_text")


def dead_letters(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """The answers that cannot be read, whole, with the reason."""
    rows = parsed(answers, answer)
    return rows.where("reason is not null").drop("doc")


def _text(path: str, missing: str | None = None, of: Column | None = None) -> Column:
    value = F.try_variant_get(F.col("doc") if of is None else of, path, "string")
    return value if missing is None else F.coalesce(value, F.lit(missing))


def _list(path: str) -> Column:
    """A list of objects; what is missing or no list counts as none, and elements that are no objects are left out."""
    items = F.coalesce(F.try_variant_get("doc", path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, lambda x: F.coalesce(F.startswith(F.schema_of_variant(x), F.lit("OBJECT")), F.lit(False)))


def read_reviews(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Readable reviews: summary, agent_error, user_error, critical_user_error, has_errors and the typed list ``errors``.

    A source other than user and agent is unknown; a severity that its source may not have is null; one tag counts as a list of one.
    """

    def error(x: Column) -> Column:
        named = F.lower(_text("$.source", "unknown", x))
        source = F.when(named.isin("user", "agent"), named).otherwise("unknown")
        given = _text("$.severity", None, x)
        severity = F.when((source == "user") & given.isin(*SEVERITIES["user"]), given).when((source == "agent") & given.isin(*SEVERITIES["agent"]), given)
        listed = F.try_variant_get(x, "$.error_tags", "array<string>")
        tags = F.coalesce(listed, F.array_compact(F.array(_text("$.error_tags", None, x))))
        number = lambda name: F.try_variant_get(x, f"$.{name}", "int").alias(name)
        return F.struct(source.alias("source"), _text("$.error_type", None, x).alias("error_type"), tags.alias("error_tags"), severity.alias("severity"), number("turn_idx"), number("tick_start"), number("tick_end"), _text("$.reasoning", "", x).alias("reasoning"), _text("$.correct_behavior", None, x).alias("correct_behavior"))

    rows = parsed(answers, answer).where("reason is null")
    rows = rows.withColumn("errors", F.transform(_list("$.errors"), error)).withColumn("summary", _text("$.summary", ""))
    some = lambda test: F.exists("errors", test)
    flags = {
        "agent_error": some(lambda e: e["source"] == "agent"),
        "user_error": some(lambda e: e["source"] == "user"),
        "critical_user_error": some(lambda e: (e["source"] == "user") & F.coalesce(e["severity"].isin(*CRITICAL), F.lit(False))),
        "has_errors": F.size("errors") > 0,
    }
    return rows.withColumns(flags).drop("doc", "reason", answer)


def read_hallucinations(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Every answer: reasoning, summary, hallucination_found and the list ``hallucinations``; an unreadable one found none and says so."""
    rows = parsed(answers, answer)
    one = lambda x: F.struct(_text("$.reasoning", "", x).alias("reasoning"), _text("$.user_message", None, x).alias("user_message"), _text("$.correct_behavior", None, x).alias("correct_behavior"))
    read = F.col("reason").isNull()
    rows = rows.withColumn("hallucinations", F.when(read, F.transform(_list("$.hallucinations"), one)).otherwise(F.array()))
    reasoning = F.when(read, _text("$.reasoning", "")).otherwise(F.concat(F.lit("unreadable: "), "reason"))
    return rows.withColumns({"reasoning": reasoning, "summary": F.when(read, _text("$.summary", "")), "hallucination_found": F.size("hallucinations") > 0}).drop("doc", answer)


def read_authentications(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Every answer: status and reasoning of its first object without inner braces; an unreadable one needed no authentication."""
    found = F.regexp_extract(F.coalesce(F.col(answer), F.lit("")), r"(\{[^{}]*\})", 1)
    rows = answers.withColumn("doc", F.try_parse_json(F.nullif(found, F.lit(""))))
    given = _text("$.status", "not_needed")
    status = F.when(F.col("doc").isNotNull() & given.isin(*AUTH_STATES), given).otherwise("not_needed")
    reasoning = F.when(F.col("doc").isNull(), UNREADABLE).otherwise(_text("$.reasoning", ""))
    return rows.withColumns({"status": status, "reasoning": reasoning}).drop("doc", answer)
