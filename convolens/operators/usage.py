"""Usage ledger and prices: sums of deltas and last cumulatives, longest-prefix rates, record costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: token meters of a usage record
METERS = ("input_tokens", "output_tokens", "cached_tokens")


def ledger(records: DataFrame, keys: list[str], meters: tuple[str, ...]) -> DataFrame:
    """Sums of meters by ``keys``: all deltas, and of each scope's cumulative records the last by seq.

    A meter that is null in all records stays null.
    """
    deltas = records.where("semantics = 'delta'").select(*keys, *meters)
    last = records.where("semantics = 'cumulative'").groupBy(*keys, "scope_id").agg(F.max_by(F.struct(*meters), "seq").alias("_last"))
    return deltas.unionByName(last.select(*keys, "_last.*")).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in meters])


def with_rate(records: DataFrame, rates: DataFrame, name: str = "model") -> DataFrame:
    """Records with the rate of their name: exact, else of the longest prefix, else null.

    A name's prefixes are looked up by equality, longest first, instead of a prefix join.
    """
    longest = rates.agg(F.max(F.length("prefix"))).first()[0] or 0
    names = records.select(name).distinct()
    cuts = names.select(name, F.explode(F.expr(f"transform(sequence(1, greatest(1, least(length({name}), {longest}))), i -> left({name}, i))")).alias("prefix"))
    best = cuts.join(rates, "prefix").groupBy(name).agg(F.max_by(F.struct("prefix", *[c for c in rates.columns if c != "prefix"]), F.length("prefix")).alias("_rate"))
    return records.join(best, name, "left").select(records["*"], F.col("_rate.prefix").alias("rate_prefix"), *[F.col(f"_rate.{c}").alias(c) for c in rates.columns if c != "prefix"])


def record_cost(meters: dict[str, str], billable: Column) -> Column:
    """Sum of meter times price; null if a used meter of a billable record has no price, 0 if not billable."""
    total, unpriced = F.lit(0.0), F.lit(False)
    for meter, price in meters.items():
        used = F.coalesce(F.col(meter), F.lit(0))
        total = total + used * F.coalesce(F.col(price), F.lit(0.0))
        unpriced = unpriced | ((used > 0) & F.col(price).isNull())
    return F.when(~billable, 0.0).when(unpriced, None).otherwise(total)


def session_cost(costs: DataFrame, key: str) -> DataFrame:
    """Cost of each session; null if any of its records has none."""
    return costs.groupBy(key).agg(F.when(F.bool_or(F.col("cost").isNull()), None).otherwise(F.sum("cost")).alias("cost"))
