"""State replay as an algebra of changes: calls become patches, patches compose, a patch applies to a state.

A patch of one key is the last call that sets or deletes it (``reset``), and what was added and appended
after that. Patches of consecutive stretches of calls compose to the patch of both stretches, and how the
calls are cut into stretches does not matter; so a simulation with a third of all calls is folded in pieces,
by grouped aggregates, in any number of tasks. Numbers are decimals, whose sums do not depend on their order.

Calls are (simulation_id, pos, name, key, value); ``value`` is JSON text. ``set`` stores a value, ``delete``
takes a key and all keys below it (behind a /) away, ``add`` adds to a number, ``append`` puts a value behind a list.
A call that cannot be done changes nothing: other names, ``add`` where no number is stored or given, ``append``
where no list is stored. Calls of one position are taken by name and value; a null key is a key of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions of a simulation whose calls of one key are gathered into one patch.
BLOCK = 1024
NUMBER = "decimal(38,6)"
CHANGES = ("set", "delete", "add", "append")
_KEY = ("simulation_id", "key")
_IS_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def replay_sets(calls: DataFrame, name: str = "set") -> DataFrame:
    """(simulation_id, key, value) after all calls ``name``: the last value of each key.

    Calls that only overwrite need no patches: the last by ``pos`` wins. Other calls are skipped.
    """
    return calls.where(F.col("name") == name).groupBy("simulation_id", "key").agg(F.max_by("value", "pos").alias("value"))


def _parents(key: Column) -> Column:
    """The keys that a key lies below: a/b/c lies below a and a/b."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def spread_deletes(calls: DataFrame, *others: DataFrame) -> DataFrame:
    """``calls`` with a delete of its own for every known key below the last deleted one.

    Keys are those of the calls and of ``others`` (simulation_id, key). Only the last delete of a parent
    can matter to a key: whatever an earlier one took, the last takes too.
    """
    keys = calls.select(*_KEY)
    for other in others:
        keys = keys.union(other.select(*_KEY))
    below = keys.distinct().where(F.contains("key", F.lit("/"))).select(*_KEY, F.explode(_parents(F.col("key"))).alias("_parent"))
    last = calls.where("name = 'delete'").groupBy("simulation_id", F.col("key").alias("_parent")).agg(F.max("pos").alias("pos"))
    spread = below.join(last, ["simulation_id", "_parent"]).select("simulation_id", "pos", F.lit("delete").alias("name"), "key", F.lit(None).cast("string").alias("value"))
    return calls.select("simulation_id", "pos", "name", "key", "value").union(spread)


def patches(calls: DataFrame, block: int = BLOCK) -> DataFrame:
    """(simulation_id, key, stretch, reset, added, items): one patch a key and stretch of ``block`` positions.

    ``reset`` is a struct (name, value) or null, ``added`` a decimal and ``items`` a list of JSON texts. What is
    gathered is bounded by the stretch.
    """
    change = F.struct("pos", "name", "value")
    grouped = calls.where(F.col("name").isin(*CHANGES)).groupBy(*_KEY, F.floor(F.col("pos") / block).alias("stretch")).agg(F.sort_array(F.collect_list(change)).alias("c"))
    is_reset = lambda x: x["name"].isin("set", "delete")
    last = F.coalesce(F.array_max(F.transform("c", lambda x, i: F.when(is_reset(x), i))), F.lit(-1))
    marked = grouped.withColumn("_last", last)
    after = marked.withColumn("_after", F.filter("c", lambda x, i: i > F.col("_last")))
    number = lambda x: F.when(x["value"].rlike(_IS_NUMBER), x["value"].try_cast(NUMBER))
    added = F.aggregate(F.filter("_after", lambda x: x["name"] == "add"), F.lit(0).cast(NUMBER), lambda s, x: (s + F.coalesce(number(x), F.lit(0).cast(NUMBER))).cast(NUMBER))
    items = F.transform(F.filter("_after", lambda x: (x["name"] == "append") & x["value"].isNotNull()), lambda x: x["value"])
    reset = F.when(F.col("_last") >= 0, F.struct(F.get("c", F.col("_last"))["name"].alias("name"), F.get("c", F.col("_last"))["value"].alias("value")))
    return after.select(*_KEY, "stretch", reset.alias("reset"), added.alias("added"), items.alias("items"))


def compose(stretches: DataFrame) -> DataFrame:
    """The patch of all stretches of each key; it bears the number of the last, so that composition goes on.

    A stretch before the last reset says nothing any more; those from it on add up.
    """
    last = F.max(F.when(F.col("reset").isNotNull(), F.col("stretch"))).over(Window.partitionBy(*_KEY))
    kept = stretches.withColumn("_last", last).where("_last is null or stretch >= _last")
    listed = F.sort_array(F.collect_list(F.when(F.size("items") > 0, F.struct("stretch", "items"))))
    summed = kept.groupBy(*_KEY).agg(F.max("stretch").alias("stretch"), F.max_by("reset", F.when(F.col("reset").isNotNull(), F.col("stretch"))).alias("reset"), F.sum("added").cast(NUMBER).alias("added"), listed.alias("_listed"))
    return summed.select(*_KEY, "stretch", "reset", "added", F.flatten(F.transform("_listed", lambda x: x["items"])).alias("items"))


def apply(patch: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """(simulation_id, key, kind, number, items, value): the state that composed patches make of ``initial``.

    ``initial`` is (simulation_id, key, value). Kinds are number, list and other; the columns of another
    kind are null. ``value`` is the JSON text of a value of the kind other.
    """
    if initial is None:
        joined = patch.withColumn("_before", F.lit(None).cast("string"))
    else:
        before = initial.select(*_KEY, F.col("value").alias("_before"), F.lit(True).alias("_known"))
        joined = patch.withColumn("_patched", F.lit(True)).join(before, list(_KEY), "full_outer")
    stored = F.when(F.col("reset").isNull(), F.col("_before")).when(F.col("reset.name") == "set", F.coalesce("reset.value", F.lit("null")))
    held = joined.withColumn("_stored", stored).where("_stored is not null")
    number = F.when(F.col("_stored").rlike(_IS_NUMBER), F.col("_stored").try_cast(NUMBER))
    # elements as JSON texts: to_json of each element of the stored list
    elements = F.transform(F.try_variant_get(F.try_parse_json("_stored"), "$", "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    typed = held.select(*_KEY, number.alias("_n"), F.when(F.ltrim("_stored").startswith("["), elements).alias("_l"), F.coalesce("added", F.lit(0).cast(NUMBER)).alias("added"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "_stored")
    kind = F.when(F.col("_n").isNotNull(), "number").when(F.col("_l").isNotNull(), "list").otherwise("other")
    return typed.select(*_KEY, kind.alias("kind"), (F.col("_n") + F.col("added")).cast(NUMBER).alias("number"), F.concat("_l", "items").alias("items"), F.when(kind == "other", F.col("_stored")).alias("value"))


def replay(calls: DataFrame, initial: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The state after all calls of each simulation."""
    known = [] if initial is None else [initial]
    return apply(compose(patches(spread_deletes(calls, *known), block)), initial)


def state_digest(states: DataFrame) -> DataFrame:
    """One digest a simulation of its rows, whatever their order: their number, and hashes that add up by exclusive or."""
    columns = sorted(c for c in states.columns if c != "simulation_id")
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    parts = [F.hex(F.bit_xor(F.xxhash64(F.lit(k), F.col("_row")))) for k in (1, 2)]
    return states.select("simulation_id", row.alias("_row")).groupBy("simulation_id").agg(F.concat_ws("-", F.count("*").cast("string"), *parts).alias("digest"))


def same_state(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(simulation_id, db_match) by digest; a simulation without a found state does not match."""
    left = state_digest(expected)
    right = state_digest(found).withColumnRenamed("digest", "_other")
    return left.join(right, "simulation_id", "left").select("simulation_id", F.coalesce(F.col("digest") == F.col("_other"), F.lit(False)).alias("db_match"))
