"""Constraints over the whole observation table. All violations are reported, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrixloom.schema import HEAD, ValidationError

VIOLATION = ["code", "prompt_id", "model", "detail"]


def _found(rows: DataFrame, code: str, detail: Column, prompt: Column | None = None, model: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(F.lit(code).alias("code"), (none if prompt is None else prompt).alias("prompt_id"), (none if model is None else model).alias("model"), detail.alias("detail"))


def untrimmed(c: Column) -> Column:
    return (c == "") | F.rlike(c, F.lit(r"(?U)\A\s|\s\z"))


def _row_checks(require_signal: bool = False) -> tuple[Column, Column]:
    """Whether something is wrong with a row by itself, and an array of (code, detail) of what is."""
    checks: list[tuple[Column, str, str]] = []
    for c in ("prompt_id", "model"):
        checks.append((F.col(c).isNull() | untrimmed(F.col(c)), "text", c))
    checks += [(untrimmed(F.col(c)), "text", c) for c in ("prompt", "task", "trace_id")]
    for c, top in (("quality", 1.0), ("latency_ms", None), ("cost_usd", None), ("load_ms", None)):
        v = F.col(c)
        bad = v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
        checks.append((bad if top is None else bad | (v > top), "range", c))
    checks.append((F.col("trace_id").isNull() != F.col("sequence_index").isNull(), "trace_pair", "trace_id and sequence_index come together"))
    checks.append((F.col("sequence_index") < 0, "range", "sequence_index"))
    if require_signal:
        checks.append((F.col("prompt").isNull() & F.col("task").isNull(), "no_signal", "neither prompt nor task"))
    wrong = [F.coalesce(bad, F.lit(False)) for bad, _, _ in checks]
    each = [F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail"))) for bad, (_, code, detail) in zip(wrong, checks, strict=True)]
    return reduce(Column.__or__, wrong), F.filter(F.array(*each), lambda x: x.isNotNull())


def out_of_range(obs: DataFrame, require_signal: bool = False) -> DataFrame:
    """Text that is blank or padded, and measures that are missing, not finite or out of bounds; with
    require_signal rows without prompt and task. One scan, whatever the number of checks."""
    wrong, what = _row_checks(require_signal)
    found = obs.where(wrong).select("prompt_id", "model", F.explode(what).alias("x"))
    return found.select("x.code", "prompt_id", "model", "x.detail")


def duplicates(obs: DataFrame) -> DataFrame:
    """(prompt_id, model, n) of pairs that occur more than once."""
    return obs.groupBy("prompt_id", "model").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inconsistent_prompts(obs: DataFrame) -> DataFrame:
    """(prompt_id, n_versions) of prompts whose own fields differ between rows."""
    fields = [c for c in (*HEAD[1:], "metadata") if c in obs.columns]
    return obs.groupBy("prompt_id").agg(F.count_distinct(F.struct(*fields)).alias("n_versions")).where("n_versions > 1")


def shared_places(obs: DataFrame) -> DataFrame:
    """(trace_id, sequence_index, n_prompts) of places that two prompts claim."""
    places = obs.where("trace_id is not null").select("trace_id", "sequence_index", "prompt_id").distinct()
    return places.groupBy("trace_id", "sequence_index").agg(F.count("prompt_id").alias("n_prompts")).where("n_prompts > 1")


def missing_pairs(obs: DataFrame) -> DataFrame:
    """(prompt_id, model) pairs that a complete matrix would have. The models are few; prompts
    that have them all are left out before anything is crossed."""
    models = obs.select("model").distinct()
    n = models.agg(F.count(F.lit(1)).alias("n_models"))
    short = obs.groupBy("prompt_id").agg(F.count_distinct("model").alias("k")).crossJoin(F.broadcast(n)).where("k < n_models").select("prompt_id")
    return short.crossJoin(models).join(obs.select("prompt_id", "model").distinct(), ["prompt_id", "model"], "left_anti")


def _version(obs: DataFrame) -> Column:
    """Hashes that stand for a prompt's own fields, and for whether they are null; versions are told apart
    by 128 bits."""
    each = [x for c in (*HEAD[1:], "metadata") if c in obs.columns for x in (F.col(c), F.col(c).isNull())]
    return F.struct(*[F.xxhash64(F.lit(s), *each).alias(f"h{s}") for s in (1, 2)])


def _by_prompt(obs: DataFrame, require_complete: bool, by_prompt: bool = False) -> DataFrame:
    """What duplicates(), inconsistent_prompts() and missing_pairs() find, as violations, by one shuffle,
    or none if the rows lie by_prompt: rows of a prompt and model are counted first, so a prompt holds as
    many entries as it has models and versions, whatever the number of rows."""
    rows = obs.select("prompt_id", "model", _version(obs).alias("version"))
    if not by_prompt:
        rows = rows.repartition("prompt_id")  # serves both groupings
    pairs = rows.groupBy("prompt_id", "model", "version").agg(F.count(F.lit(1)).alias("n"))
    held = pairs.groupBy("prompt_id").agg(F.collect_list(F.struct("model", "n")).alias("held"), F.collect_set("version").alias("versions"), F.max("n").alias("most"), F.count("model").alias("named"))
    same = lambda m: F.filter("held", lambda x: x["model"].eqNullSafe(m))
    total = lambda m: F.aggregate(same(m), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    models = F.array_distinct(F.transform("held", lambda x: x["model"]))
    none = F.lit(None).cast("string")
    one = lambda code, model, detail: F.struct(F.lit(code).alias("code"), model.alias("model"), detail.alias("detail"))
    twice = F.transform(F.filter(models, lambda m: total(m) > 1), lambda m: one("duplicate", m, total(m).cast("string")))
    differ = F.when(F.size("versions") > 1, F.array(one("inconsistent", none, F.size("versions").cast("string")))).otherwise(F.expr("cast(array() as array<struct<code:string,model:string,detail:string>>)"))
    found = [twice, differ]
    # what is wrong is worked out only for prompts that something is wrong with
    suspect = (F.col("most") > 1) | (F.size("versions") > 1)
    if require_complete:
        every = obs.select("model").distinct().agg(F.collect_set("model").alias("every"))
        held = held.crossJoin(F.broadcast(every))
        found.append(F.transform(F.array_except("every", models), lambda m: one("missing", m, F.lit("no result"))))
        suspect = suspect | (F.col("named") != F.size("every"))
    each = held.where(suspect).select("prompt_id", F.explode(F.concat(*found)).alias("x"))
    return each.select("x.code", "prompt_id", "x.model", "x.detail")


def violations(obs: DataFrame, require_signal: bool = False, require_complete: bool = True, by_prompt: bool = False) -> DataFrame:
    """Every violation as (code, prompt_id, model, detail)."""
    parts = [
        out_of_range(obs, require_signal),
        _by_prompt(obs, require_complete, by_prompt),
        _found(shared_places(obs), "shared_place", F.format_string("%s[%d]", "trace_id", "sequence_index")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _clean(obs: DataFrame, require_signal: bool, require_complete: bool, by_prompt: bool) -> bool:
    """Whether there are no violations, by counts of fixed width: one pass for what rows and prompts show,
    and one for places."""
    wrong, _ = _row_checks(require_signal)
    rows = obs.select("prompt_id", "model", _version(obs).alias("version"), wrong.cast("int").alias("wrong"))
    if not by_prompt:
        rows = rows.repartition("prompt_id")
    pairs = rows.groupBy("prompt_id", "model", "version").agg(F.count(F.lit(1)).alias("n"), F.max("wrong").alias("wrong"))
    one = lambda f, h: f(F.col("version")[h])
    each = pairs.groupBy("prompt_id").agg(F.max("n").alias("most"), F.max("wrong").alias("wrong"), F.count("model").alias("named"), *[one(f, h).alias(f"{n}_{h}") for n, f in (("lo", F.min), ("hi", F.max)) for h in ("h1", "h2")])
    bad = (F.col("most") > 1) | (F.col("wrong") > 0) | (F.col("lo_h1") != F.col("hi_h1")) | (F.col("lo_h2") != F.col("hi_h2"))
    if require_complete:
        bad = bad | (F.col("named") != obs.select("model").where("model is not null").distinct().count())
    return not each.where(bad).limit(1).count() and not shared_places(obs).limit(1).count()


def validate(obs: DataFrame, require_signal: bool = False, require_complete: bool = True, by_prompt: bool = False) -> DataFrame:
    """The table itself, or ValidationError with the first violations in canonical order. by_prompt: rows
    of a prompt lie together, as kept() leaves them."""
    if not obs.limit(1).count():
        raise ValidationError("there are no observations")
    if _clean(obs, require_signal, require_complete, by_prompt):
        return obs
    found = violations(obs, require_signal, require_complete, by_prompt).orderBy("code", "prompt_id", "model", "detail").limit(5).collect()
    if found:
        raise ValidationError("; ".join(f"{v.code}: {v.detail} (prompt {v.prompt_id}, model {v.model})" for v in found))
    return obs


# --- facts about traces -----------------------------------------------------------------------


def heads(obs: DataFrame) -> DataFrame:
    """One row for each prompt, with the fields that all its rows share."""
    return obs.groupBy("prompt_id").agg(*[F.any_value(c).alias(c) for c in HEAD[1:] if c in obs.columns])


def trace_completeness(obs: DataFrame) -> DataFrame:
    """(trace_id, n_prompts, first_index, last_index, contiguous) of each trace."""
    h = heads(obs).where("trace_id is not null")
    by = h.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_prompts"), F.min("sequence_index").alias("first_index"), F.max("sequence_index").alias("last_index"))
    return by.withColumn("contiguous", F.col("last_index") - F.col("first_index") + 1 == F.col("n_prompts"))


def trace_coverage(obs: DataFrame) -> DataFrame:
    """(n_prompts, n_traced, coverage, trace_complete) of the table."""
    facts = heads(obs).agg(F.count(F.lit(1)).alias("n_prompts"), F.count("trace_id").alias("n_traced"))
    whole = trace_completeness(obs).agg(F.coalesce(F.bool_and("contiguous"), F.lit(False)).alias("all_contiguous"))
    share = F.when(F.col("n_prompts") == 0, 0.0).otherwise(F.col("n_traced") / F.col("n_prompts"))
    return facts.crossJoin(whole).select("n_prompts", "n_traced", share.alias("coverage"), ((F.col("n_prompts") == F.col("n_traced")) & F.col("all_contiguous")).alias("trace_complete"))


def trace_groups(obs: DataFrame) -> DataFrame:
    """(trace_id, prompt_ids) with the prompts of each trace in order."""
    h = heads(obs).where("trace_id is not null")
    places = F.array_sort(F.collect_list(F.struct("sequence_index", "prompt_id")))
    return h.groupBy("trace_id").agg(F.transform(places, lambda x: x["prompt_id"]).alias("prompt_ids"))
