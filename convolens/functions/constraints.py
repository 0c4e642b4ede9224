"""Field constraints: ``field__op`` keys and values turned into one null-safe predicate.

Keys are split at the last double underscore; without one the operator is ``eq``, and an unknown
operator means ``eq`` on the field name before it. All constraints must hold. A missing field reads as
null; a comparison that types rule out does not match.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, NumericType, StringType


def _comparable(kind: DataType, value: Any) -> bool:
    if isinstance(value, bool) or isinstance(kind, BooleanType):
        return isinstance(value, (bool, int, float)) and isinstance(kind, (BooleanType, NumericType))
    if isinstance(value, (int, float)):
        return isinstance(kind, NumericType)
    return isinstance(value, str) and not isinstance(kind, (NumericType, ArrayType, MapType))


def _equal(column: Column, kind: DataType, value: Any) -> Column:
    if value is None:
        return column.isNull()
    return column.eqNullSafe(F.lit(value)) if _comparable(kind, value) else F.lit(False)


def _ordered(compare: Callable) -> Callable:
    return lambda column, kind, value: compare(column, F.lit(value)) if value is not None and _comparable(kind, value) else F.lit(False)


def _contains(column: Column, kind: DataType, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    if isinstance(kind, ArrayType):
        return F.array_contains(column, value)
    if isinstance(kind, MapType):
        return F.map_contains_key(column, value)
    return F.contains(column, F.lit(value)) if isinstance(kind, StringType) and isinstance(value, str) else F.lit(False)


def _text(method: str) -> Callable:
    return lambda column, kind, value: getattr(column if isinstance(kind, StringType) else column.cast("string"), method)(str(value))


def _member(column: Column, kind: DataType, value: Any) -> Column:
    if isinstance(value, str):
        return F.contains(F.lit(value), column) if isinstance(kind, StringType) else F.lit(False)
    listed = [v for v in value if v is not None and _comparable(kind, v)]
    found = column.isNotNull() & column.isin(*listed) if listed else F.lit(False)
    return found | column.isNull() if None in value else found


#: Columns that are true where a row matches, and false or null elsewhere; ``ne`` and ``nin`` are never null.
OPERATORS: dict[str, Callable[[Column, DataType, Any], Column]] = {
    "eq": _equal,
    "ne": lambda c, k, v: ~_equal(c, k, v),
    "gt": _ordered(operator.gt),
    "gte": _ordered(operator.ge),
    "lt": _ordered(operator.lt),
    "lte": _ordered(operator.le),
    "contains": _contains,
    "startswith": _text("startswith"),
    "endswith": _text("endswith"),
    "in": _member,
    "nin": lambda c, k, v: ~F.coalesce(_member(c, k, v), F.lit(False)),
}


def parse_key(key: str) -> tuple[str, str]:
    """(field, operator) of a constraint key."""
    field, mark, name = key.rpartition("__")
    if not mark:
        return key, "eq"
    return field, name if name in OPERATORS else "eq"


def predicate(df: DataFrame, constraints: Mapping[str, Any], for_filter: bool = False) -> Column:
    """The conjunction of all constraints as one column.

    It is never null, and so may be negated. ``for_filter`` leaves nulls in place, which a filter
    takes as no match: plain comparisons then reach the scan.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for key, value in constraints.items():
        field, name = parse_key(key)
        column, kind = (F.col(f"`{field}`"), kinds[field]) if field in kinds else (F.lit(None).cast("string"), StringType())
        part = OPERATORS[name](column, kind, value)
        parts.append(part if for_filter else F.coalesce(part, F.lit(False)))
    return functools.reduce(operator.and_, parts, F.lit(True))


def query(df: DataFrame, constraints: Mapping[str, Any] | str, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows that meet the constraints (a mapping or its JSON), the first ``limit`` of them in ``order``.

    A limit of 0 still returns the first row, as a limit is tested after a row has been taken.
    """
    found = df.where(predicate(df, json.loads(constraints) if isinstance(constraints, str) else constraints, for_filter=True))
    if limit is None:
        return found
    return (found.orderBy(order) if order else found).limit(max(1, limit))
