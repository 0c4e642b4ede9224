"""Run files in both layouts: one JSON file, or a folder with results.json and a file per simulation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions.variants import items
from convolens.sources import schemas


@dataclass
class Run:
    """The tables of one or more runs."""

    info: DataFrame
    tasks: DataFrame
    simulations: DataFrame
    index: DataFrame


def _json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_run(spark: SparkSession, path: str, layout: str = "json", check: bool = True) -> Run:
    """Read a run. ``layout`` is ``json`` or ``dir``; ``check`` holds the index against the files."""
    top = _json(spark, path if layout == "json" else f"{path.rstrip('/')}/results.json", schemas.run_schema())
    info = top.select("timestamp", "info.*")
    tasks = top.select(F.explode("tasks").alias("t")).select("t.*")
    index = top.select(F.explode("simulation_index").alias("i")).select("i.*")
    if layout == "json":
        simulations = top.select(F.explode("simulations").alias("s")).select("s.*")
    else:
        simulations = _json(spark, f"{path.rstrip('/')}/simulations/*.json", schemas.struct(schemas.SIMULATION))
    run = Run(info, tasks, simulations, index)
    if check and layout == "dir":
        check_index(run)
    return run


def read_untyped(spark: SparkSession, path: str, layout: str = "json") -> tuple[DataFrame, DataFrame]:
    """A run without a schema: (file, doc) of its head, and (file, pos, value) of its simulations, all VARIANT.

    Fields of any depth are cut out by ``variants.shredded`` and ``variants.items``; what a schema does not
    know is kept. In the layout ``dir`` each file is one simulation, at position 0.
    """

    def documents(at: str) -> DataFrame:
        whole = spark.read.option("multiLine", True).option("singleVariantColumn", "doc").json(at)
        return whole.select(F.col("_metadata.file_path").alias("file"), "doc")

    root = path.rstrip("/")
    if layout == "json":
        head = documents(root)
        return head, items(head, "doc", "$.simulations", "file")
    return documents(f"{root}/results.json"), documents(f"{root}/simulations/*.json").select("file", F.lit(0).alias("pos"), F.col("doc").alias("value"))


def gold_actions(run: Run) -> DataFrame:
    """The expected actions of every simulation, as ``rewards.match_actions`` takes them."""
    actions = run.tasks.select(F.col("id").alias("task_id"), F.posexplode("evaluation_criteria.actions").alias("_at", "a"))
    rows = run.simulations.select(F.col("id").alias("simulation_id"), "task_id").join(actions, "task_id")
    return rows.select("simulation_id", F.coalesce("a.action_id", F.col("_at").cast("string")).alias("action_id"), "a.name", "a.arguments", "a.compare_args")


def read_metadata(spark: SparkSession, path: str) -> Run:
    """A run without its simulations: only the small fields are read."""
    whole = schemas.run_schema()
    top = _json(spark, path, type(whole)([f for f in whole.fields if f.name != "simulations"]))
    empty = spark.createDataFrame([], schemas.struct(schemas.SIMULATION))
    return Run(top.select("timestamp", "info.*"), top.select(F.explode("tasks").alias("t")).select("t.*"), empty, top.select(F.explode("simulation_index").alias("i")).select("i.*"))


def check_index(run: Run) -> None:
    """Raise if the index and the simulations do not hold the same ids."""
    missing = run.index.join(run.simulations.select("id"), "id", "left_anti").select("id")
    extra = run.simulations.select("id").join(run.index, "id", "left_anti")
    both = missing.withColumn("what", F.lit("missing")).unionByName(extra.withColumn("what", F.lit("extra"))).limit(5).collect()
    if both:
        raise ValueError(f"index and simulations differ: {[(r['what'], r['id']) for r in both]}")


def build_index(simulations: DataFrame) -> DataFrame:
    """The summary row of each simulation."""
    return simulations.select("id", "task_id", "trial", F.col("reward_info.reward").alias("reward"), "termination_reason", "agent_cost", "duration")


def task_counts(tasks: DataFrame) -> DataFrame:
    """Per task its numbers of actions by requestor, of assertions and of information to be said.

    An action without a requestor is the agent's. A task whose one action is a transfer has -1 actions.
    """
    actions = F.coalesce("evaluation_criteria.actions", F.array().cast(tasks.schema["evaluation_criteria"].dataType["actions"].dataType))
    by = lambda who: F.size(F.filter(actions, lambda x: F.coalesce(x["requestor"], F.lit("assistant")) == who))
    size = lambda c: F.when(F.col(f"evaluation_criteria.{c}").isNull(), 0).otherwise(F.size(f"evaluation_criteria.{c}"))
    transfer = (F.size(actions) == 1) & F.contains(F.lower(F.get(actions, F.lit(0))["name"]), F.lit("transfer"))
    return tasks.select(
        F.col("id").alias("task_id"),
        by("assistant").alias("num_agent_actions"),
        by("user").alias("num_user_actions"),
        F.when(transfer, -1).otherwise(by("assistant") + by("user")).alias("num_actions"),
        size("env_assertions").alias("num_env_assertions"),
        size("nl_assertions").alias("num_nl_assertions"),
        size("communicate_info").alias("num_communicate"),
    )


def info_columns(info: DataFrame) -> DataFrame:
    """One row of the run's settings, named as in a flat table of simulations."""
    plain = [F.col(c).alias(f"info_{c}") for c in ("git_commit", "seed", "num_trials", "max_steps", "max_errors")]
    sides = [F.col(f"{side}_info.{c}").alias(f"info_{side}_{c}") for side in ("user", "agent") for c in ("implementation", "llm", "llm_args")]
    return info.select(*plain, F.col("environment_info.domain_name").alias("info_domain"), *sides)


def flatten(run: Run, strict: bool = True) -> DataFrame:
    """One row per simulation with its reward, costs, task counts and the run's settings.

    With ``strict`` a simulation whose task is missing raises; else its task columns are null. A task
    without criteria counts 0 actions.
    """
    rows = run.simulations.join(task_counts(run.tasks).withColumn("_known", F.lit(True)), "task_id", "left")
    if strict and (bad := rows.where("_known is null").select("task_id").first()):
        raise KeyError(bad["task_id"])
    said = F.size(F.coalesce("messages", F.array().cast(run.simulations.schema["messages"].dataType))).alias("num_messages")
    counts = [c for c in rows.columns if c.startswith("num_")]
    flat = rows.select(F.col("id").alias("simulation_id"), "task_id", "trial", "seed", "duration", "termination_reason", "agent_cost", "user_cost", F.col("reward_info.reward").alias("reward"), "reward_info", *counts, said)
    return flat.crossJoin(F.broadcast(info_columns(run.info).limit(1)))  # one row of settings


def messages(simulations: DataFrame) -> DataFrame:
    """One row per message, with its position."""
    return simulations.select(F.col("id").alias("simulation_id"), F.posexplode("messages").alias("pos", "m")).select("simulation_id", "pos", "m.*")


def tool_calls(simulations: DataFrame) -> DataFrame:
    """One row per tool call, in message order."""
    rows = messages(simulations)
    return rows.select("simulation_id", "pos", F.posexplode("tool_calls").alias("call", "c")).select("simulation_id", "pos", "call", "c.*")


def ticks(simulations: DataFrame) -> DataFrame:
    """One row per tick with both sides' speech flags."""
    rows = simulations.select(F.col("id").alias("simulation_id"), F.explode("ticks").alias("t"))
    speech = lambda side: F.coalesce(F.col(f"t.{side}_chunk.contains_speech"), F.lit(False)).alias(f"{side}_speaks")
    return rows.select("simulation_id", F.col("t.tick_id").alias("tick"), speech("user"), speech("agent"))


def _document(run: Run, index: DataFrame, simulations: DataFrame | None) -> DataFrame:
    """A run file as one row. Without simulations it has metadata alone; with them it is one document by its format."""
    lists = {"tasks": run.tasks, "simulation_index": index} | ({} if simulations is None else {"simulations": simulations})
    out = run.info.select("timestamp", F.struct(*[F.col(c) for c in run.info.columns if c != "timestamp"]).alias("info")).limit(1)
    for name, rows in lists.items():
        out = out.crossJoin(rows.agg(F.collect_list(F.struct("*")).alias(name)))  # one row each
    return out


def write_run(run: Run, path: str, layout: str = "json") -> None:
    """Write a run as ``read_run`` reads it, in either layout; ``path`` becomes a folder of Spark's files.

    In the layout ``dir`` each simulation is a file of its own, written in parallel, beside results.json.
    """
    index = build_index(run.simulations)
    if layout == "json":
        _document(run, index, run.simulations).coalesce(1).write.mode("errorifexists").json(path)
        return
    root = path.rstrip("/")
    run.simulations.write.mode("errorifexists").option("maxRecordsPerFile", 1).json(f"{root}/simulations")
    _document(run, index, None).coalesce(1).write.mode("errorifexists").json(f"{root}/results.json")


def write_metadata(run: Run, path: str) -> None:
    """Replace the info and the tasks of a run of layout ``dir``; the index on disk stays as it is."""
    spark, root = run.tasks.sparkSession, path.rstrip("/")
    stored = _json(spark, f"{root}/results.json", schemas.run_schema()).select(F.explode("simulation_index").alias("i")).select("i.*")
    fresh, old = f"{root}/results.json.new", f"{root}/results.json"
    _document(run, stored, None).coalesce(1).write.mode("overwrite").json(fresh)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm(root).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm(f"{old}.old")  # at every moment one whole copy has a name
    files.delete(aside, True)
    files.rename(jvm(old), aside)
    files.rename(jvm(fresh), jvm(old))
    files.delete(aside, True)


def convert_run(spark: SparkSession, source: str, target: str, layout: str) -> None:
    """Write a run again in the other layout; the source stays as a backup."""
    write_run(read_run(spark, source, "dir" if layout == "json" else "json"), target, layout)


def task_set(spark: SparkSession, path: str, split: str | None = None, splits: str | None = None) -> DataFrame:
    """The tasks of a JSON file; of one named split of the file ``splits`` (name to list of task ids), in its order."""
    tasks = _json(spark, path, schemas.struct(schemas.TASK))
    if split is None:
        return tasks
    named = _json(spark, splits, "`" + split + "` ARRAY<STRING>").select(F.posexplode(F.col(f"`{split}`")).alias("_at", "id"))
    return tasks.join(named, "id").orderBy("_at").drop("_at").select(*tasks.columns)


def file_list(spark: SparkSession, paths: list[str], suffix: str = "") -> DataFrame:
    """(path): the files below the given files, folders and globs, once each, that end in ``suffix``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    return rows.where(F.endswith("path", F.lit(suffix))).distinct()


def log_lines(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """One row per line of log files that matches ``pattern``, its groups as columns, and the file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path")).where(F.col("value").rlike(pattern))
    return lines.select("file", *[F.regexp_extract("value", pattern, k + 1).alias(name) for k, name in enumerate(names)])


#: fixed value: the name of a run's file, as llm_domain_mode_llmuser_4trials.json, with _10tasks before the ending if tasks were picked
RUN_FILE = r"^(.+)_(.+)_(.+)_(.+)_(\d+)trials(_(\d+)tasks)?\.json"


def named_parameters(path: Column) -> list[Column]:
    """The settings that the last part of a run's path names, as columns; all null for another name, num_tasks null if not given."""
    name = F.substring_index(path, "/", -1)
    part = lambda k: F.nullif(F.regexp_extract(name, RUN_FILE, k), F.lit(""))
    texts = [part(k).alias(c) for k, c in enumerate(("llm", "domain", "mode", "llm_user"), 1)]
    return [*texts, part(5).cast("int").alias("num_trials"), part(7).cast("int").alias("num_tasks")]


def knowledge_base(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, content) of a folder of JSON documents, ids distinct."""
    rows = spark.read.schema("id STRING, title STRING, content STRING").option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return rows.dropDuplicates(["id"])


def submissions(spark: SparkSession, folder: str, entries: str = "*") -> DataFrame:
    """Leaderboard entries: one row per submission and domain, with pass^1 to pass^4 and cost; ``entries`` is a glob of their folders."""
    domains = ("airline", "retail", "telecom", "banking_knowledge")
    one = "STRUCT<pass_1: DOUBLE, pass_2: DOUBLE, pass_3: DOUBLE, pass_4: DOUBLE, cost: DOUBLE>"
    rows = spark.read.schema(f"model_name STRING, submitting_organization STRING, submission_date STRING, results STRUCT<{', '.join(f'{d}: {one}' for d in domains)}>").option("multiLine", True).json(f"{folder.rstrip('/')}/{entries}/submission.json")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"results.{d}").alias("r")) for d in domains])).alias("d")
    return rows.select("model_name", "submitting_organization", "submission_date", each).select("model_name", "submitting_organization", "submission_date", "d.domain", "d.r.*").where("pass_1 is not null")
