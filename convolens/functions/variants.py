"""Free-form values as VARIANT: one text for equal values, and argument objects as maps of such texts.

A VARIANT cannot be compared or grouped. Its JSON text can, once equal numbers are written alike: 1, 1.0
and 1e0 are one number, and true and false count as 1 and 0 beside numbers, as they do in a comparison
of Python values. Texts stay texts ("1" is not 1), null is a value of its own, and keys of objects are in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: strings, numbers, words and punctuation of a JSON text, left to right
_TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null|[\[\]{},:]'


def _number(token: Column) -> Column:
    """A JSON number, written without a point or exponent if it is whole."""
    value = token.try_cast("double")
    whole = value.try_cast("decimal(38,0)")
    text = F.when(whole.cast("double") == value, whole.cast("string")).otherwise(value.cast("string"))
    return F.when(~token.rlike("[.eE]"), F.when(token == "-0", "0").otherwise(token)).otherwise(text)


def same_json(text: Column) -> Column:
    """A JSON text with its numbers and truth values written in one way; equal for equal values in key order."""
    write = lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).when(t == "true", "1").when(t == "false", "0").otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0)), write), "")


def canonical_variant(value: Column) -> Column:
    """The text that all equal VARIANT values share; null for a missing value, 'null' for JSON's null."""
    return same_json(F.to_json(value))


def argument_map(arguments: Column) -> Column:
    """An object of arguments as a map of canonical texts; empty for anything else."""
    entries = F.try_variant_get(arguments, "$", "map<string,variant>")
    return F.coalesce(F.transform_values(entries, lambda _, v: F.coalesce(canonical_variant(v), F.lit("null"))), F.create_map().cast("map<string,string>"))


def items(rows: DataFrame, document: str, path: str, *keep: str) -> DataFrame:
    """One row (*keep, pos, value VARIANT) per element of the list at ``path`` of a VARIANT column, in order."""
    listed = F.try_variant_get(F.col(document), path, "array<variant>")
    return rows.select(*keep, F.posexplode(listed).alias("pos", "value"))


def shredded(rows: DataFrame, document: str, columns: dict[str, tuple[str, str]], *keep: str) -> DataFrame:
    """Typed columns cut out of a VARIANT column: name -> (path, type); null where the path or the type is another."""
    return rows.select(*keep, *[F.try_variant_get(F.col(document), path, kind).alias(name) for name, (path, kind) in columns.items()])
