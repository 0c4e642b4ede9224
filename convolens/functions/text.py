"""Scalar helpers over text: tokens, call formats, canonical JSON and deterministic ids."""

from __future__ import annotations

import ast
import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from convolens.functions.variants import canonical_variant


#: fixed value: the characters that split words, Unicode white space and the four separators before it
_WHITE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens between runs of white space."""
    return F.filter(F.split(F.lower(text), _WHITE), lambda x: x != "")


def said(message: Column, information: Column) -> Column:
    """Whether a message holds the information: any case, commas dropped from the message only."""
    return F.contains(F.replace(F.lower(message), F.lit(","), F.lit("")), F.lower(information))


def call_format(name: Column, arguments: Column) -> Column:
    """``name(k=v, ...)`` of a name and a map of texts, in the order of the arguments."""
    parts = F.transform(F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.concat(name, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def canonical(arguments: Column) -> Column:
    """A text that is equal for equal maps: entries sorted by key, nulls kept apart from texts."""
    return F.to_json(F.array_sort(F.map_entries(arguments)), {"ignoreNullFields": "false"})


def content_hash(*columns: Column) -> Column:
    """sha256 of canonical JSON over the given columns, in order."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])), 256)


def deterministic_id(prefix: str, *seeds: Column) -> Column:
    """``prefix`` and the first sixteen hex digits of the sha256 of the seeds."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("_", *seeds), 256), 1, 16))


def valid_pattern(pattern: str) -> str:
    """A regular expression of the engine that will run it, or the quoted text where it is not one."""
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
        return pattern
    except IllegalArgumentException:
        return re.escape(pattern)


def parse_call(text: str) -> tuple[str, dict] | None:
    """(name, keyword arguments) of a call in functional form with literal values, else None."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
        if not isinstance(node, ast.Call) or node.args or not isinstance(node.func, ast.Name):
            return None
        return node.func.id, {k.arg: ast.literal_eval(k.value) for k in node.keywords if k.arg}
    except (SyntaxError, ValueError):
        return None


def amount(text: Column) -> Column:
    """A number out of a money text such as ``$1,234.50``; null where there is none."""
    return F.regexp_replace(text.cast("string"), r"[$,\s]", "").try_cast("double")


def fenced_json(text: Column) -> Column:
    """The JSON text inside a fenced block, or the whole text without a fence."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", F.trim(inner)).otherwise(F.trim(text))


def same_name(left: Column, right: Column) -> Column:
    """Whether two names or addresses are equal in any case."""
    return F.lower(left) == F.lower(right)


def safe_filename(name: Column, longest: int = 255) -> Column:
    """A name with ``..`` and everything but letters and digits of any script, ``.``, ``_`` and ``-`` replaced by ``_``, cut to ``longest``."""
    return F.substring(F.regexp_replace(F.replace(name, F.lit(".."), F.lit("_")), r"[^\p{L}\p{N}._-]", "_"), 1, longest)


def task_intent(task_id: Column) -> Column:
    """The intent in brackets at the start of a task id such as ``[mobile_data_issue]a|b[PERSONA:None]``."""
    return F.nullif(F.regexp_extract(task_id, r"^\[([a-zA-Z_]+)\]", 1), F.lit(""))


def task_persona(task_id: Column) -> Column:
    """The persona after ``PERSONA:`` in a task id: letters and _ alone; null for any other."""
    return F.nullif(F.regexp_extract(task_id, r"\[PERSONA:([a-zA-Z_]+)\]", 1), F.lit(""))


def task_issues(task_id: Column) -> Column:
    """How many issues, separated by bars, a task id lists."""
    return F.size(F.split(task_id, r"\|"))


def not_nan(number: Column) -> Column:
    """The number, null where it is not a number."""
    return F.when(~F.isnan(number), number)


def same_output(left: Column, right: Column) -> Column:
    """Whether two tool outputs hold the same value: JSON by value (1 is 1.0), and a text that is no JSON as a string."""

    def value(text: Column) -> Column:
        quoted = F.to_json(F.array(text))  # of one string: its JSON without the brackets
        return F.coalesce(canonical_variant(F.try_parse_json(text)), F.substring(quoted, 2, F.length(quoted) - 2))

    return value(left) == value(right)


def arrival_date(date: Column, arrival: Column) -> Column:
    """The day of arrival: the day after ``date`` where the arrival time ends in ``+1``."""
    return F.when(F.endswith(arrival, F.lit("+1")), F.date_add(F.to_date(date), 1)).otherwise(F.to_date(date))
