"""From measured trials and a task suite to an observation matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrixloom.functions.sizes import small


def last_write(trials: DataFrame, order: str | None = None) -> DataFrame:
    """The last row of each task and model; failed and unnamed rows don't count. The order is that
    of place, which holds over all files of a run, where there is one, else of line_no."""
    order = order or ("place" if "place" in trials.columns else "line_no")
    ok = trials.where("task_id is not null and task_id <> '' and model is not null and model <> '' and (error is null or error = '')")
    rest = [c for c in trials.columns if c not in ("task_id", "model")]
    last = ok.groupBy("task_id", "model").agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select("task_id", "model", "r.*").select(*trials.columns)


def outstanding(tasks: DataFrame, models: DataFrame, done: DataFrame) -> DataFrame:
    """(task_id, model) pairs still to be measured."""
    return tasks.select("task_id").crossJoin(small(models.select("model"))).join(done.select("task_id", "model"), ["task_id", "model"], "left_anti")


def cold_load(trials: DataFrame) -> DataFrame:
    """(model, cold_load_ms): the longest positive load of each model, else 0."""
    return trials.groupBy("model").agg(F.coalesce(F.max(F.when(F.col("load_ms") > 0, F.col("load_ms"))), F.lit(0.0)).alias("cold_load_ms"))


def to_matrix(trials: DataFrame, suite: DataFrame, models: list[str], trace: str = "'trials'") -> DataFrame:
    """Observations of the tasks that every model has a result for, renumbered without gaps.

    suite: (task_id, pos, task, prompt, grader); trace: SQL for the trace of a task.
    """
    t = trials.where(F.col("model").isin(models) & F.col("error").isNull())
    whole = t.groupBy("task_id").agg(F.count_distinct("model").alias("k")).where(F.col("k") == len(models)).select("task_id")
    usable = suite.join(whole, "task_id", "left_semi").withColumn("trace_id", F.expr(trace))
    usable = usable.withColumn("sequence_index", F.row_number().over(Window.partitionBy("trace_id").orderBy("pos")).cast("long") - 1)
    loads = small(cold_load(trials.where(F.col("model").isin(models))))  # one row a model
    rows = usable.join(t, "task_id").join(loads, "model")
    meta = F.to_json(F.struct("grader"))
    return rows.select(F.col("task_id").alias("prompt_id"), "prompt", "task", "trace_id", "sequence_index", "model", "quality", F.round("generation_ms", 3).alias("latency_ms"), F.lit(0.0).alias("cost_usd"), F.round("cold_load_ms", 3).alias("load_ms"), meta.alias("metadata"))


def dropped(trials: DataFrame, suite: DataFrame, models: list[str]) -> DataFrame:
    """(task_id) of the tasks that to_matrix leaves out."""
    t = trials.where(F.col("model").isin(models) & F.col("error").isNull())
    whole = t.groupBy("task_id").agg(F.count_distinct("model").alias("k")).where(F.col("k") == len(models))
    return suite.select("task_id").join(whole, "task_id", "left_anti")


def accuracy(trials: DataFrame) -> DataFrame:
    """(model, n_correct, n, accuracy)."""
    by = trials.groupBy("model").agg(F.count_if("correct").alias("n_correct"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("accuracy", F.col("n_correct") / F.col("n"))


def select_tasks(suite: DataFrame, limit: int | None = None) -> DataFrame:
    """limit tasks, taken in turn from each type, types in the order of their first task."""
    if limit is None:
        return suite
    if isinstance(limit, bool) or limit < 1:
        raise ValueError("limit must be a positive number")
    w = Window.partitionBy("task")
    turn = suite.withColumn("__turn", F.row_number().over(w.orderBy("pos"))).withColumn("__first", F.min("pos").over(w))
    return turn.where(F.col("__turn") <= limit).orderBy("__turn", "__first").limit(limit).select(*suite.columns)


def suite_summary(suite: DataFrame) -> DataFrame:
    return suite.groupBy("task").agg(F.count(F.lit(1)).alias("n"))


def profile_summary(observations: DataFrame) -> DataFrame:
    """(model, measure, median, low, high) of profiled load and total durations."""
    each = observations.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("load_duration_ms", "total_duration_ms")])).alias("m")).select("model", "m.*")
    return each.groupBy("model", "measure").agg(F.percentile("value", 0.5).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def milliseconds(nanoseconds):
    """A column of nanoseconds in milliseconds to six places; null unless it is a number >= 0."""
    c = nanoseconds.cast("double")
    return F.when((c >= 0) & ~F.isnan(c), F.round(c / 1e6, 6))


def estimated_seconds(n_models: int, n_tasks: int, load: float = 10.0, each: float = 15.0) -> float:
    return n_models * (load + each * n_tasks)


def duration_text(seconds: float) -> str:
    if seconds < 90:
        return f"{seconds:.0f} s"
    return f"{seconds / 60:.0f} min" if seconds < 5400 else f"{seconds / 3600:.1f} h"


def resolve_models(requested: DataFrame, installed: DataFrame) -> DataFrame:
    """(requested, canonical) of the models asked for, the first of each canonical name.

    requested: (pos, name); installed: (pos, canonical, name), a row for each name that a model
    goes by. A name goes to the first model that has it. ValueError for one that none has.
    """
    asked = requested.select("pos", F.trim("name").alias("name"))
    first = installed.groupBy("name").agg(F.min_by("canonical", "pos").alias("canonical"))
    found = asked.join(first, "name", "left")
    missing = found.where("canonical is null or name = ''").orderBy("pos").limit(5).collect()
    if missing or not asked.limit(1).count():
        raise ValueError("not installed: " + ", ".join(repr(r.name) for r in missing) if missing else "at least one model is required")
    return found.groupBy("canonical").agg(F.min_by("name", "pos").alias("requested")).select("requested", "canonical")


def residency_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(model, side) of models that are gone, 'missing', or new, 'additional'."""
    a, b = before.select("model").distinct(), after.select("model").distinct()
    side = lambda x, y, name: x.join(y, "model", "left_anti").select("model", F.lit(name).alias("side"))
    return side(a, b, "missing").unionByName(side(b, a, "additional"))
