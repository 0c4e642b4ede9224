"""Work units of a run: tasks times trials less what is done, and composed tasks of selection sets."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most items of a selection set that is broadcast.
MAX_SET = 100_000


def work_units(tasks: DataFrame, trials: int, seed: int, done: DataFrame) -> DataFrame:
    """(task_id, trial, seed) that ``done`` lacks; each trial's seed is derived from the run's."""
    units = tasks.select("task_id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).withColumn("seed", F.lit(seed) + F.col("trial"))
    return units.join(done.select("task_id", "trial", "seed"), ["task_id", "trial", "seed"], "left_anti")


def composed(sets: list[DataFrame]) -> DataFrame:
    """All choices of one or no item from each small selection set (column ``item``), with their size.

    The product is what a task generator asks for; its size is that of the sets' sizes plus one. Sets are
    broadcast one by one; one of more than ``MAX_SET`` items is an error.
    """
    for s in sets[1:]:
        if s.limit(MAX_SET + 1).count() > MAX_SET:
            raise ValueError(f"a selection set has more than {MAX_SET} items")
    parts = [s.select(F.array("item").alias(f"_c{k}")).unionByName(s.sparkSession.createDataFrame([([],)], f"_c{k} array<string>")) for k, s in enumerate(sets)]
    product = functools.reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    items = F.flatten(F.array(*[f"_c{k}" for k in range(len(parts))]))
    return product.select(items.alias("items"), F.size(items).alias("size"))


def select_tasks(tasks: DataFrame, ids: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Tasks by id (all must exist) and the first so many by numeric id."""
    if ids is not None:
        found = {r[0] for r in tasks.select("task_id").where(F.col("task_id").isin(ids)).distinct().collect()}
        if missing := sorted(set(ids) - found):
            raise ValueError(f"no such tasks: {missing}")
        tasks = tasks.where(F.col("task_id").isin(ids))
    return tasks if first is None else tasks.orderBy(F.col("task_id").try_cast("int").asc_nulls_last(), "task_id").limit(first)
