"""Rows of a matrix by prompt and model."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from matrixloom.operators.validate import validate


def for_prompt(obs: DataFrame, prompt_id: str) -> DataFrame:
    """The rows of one prompt."""
    return obs.where(F.col("prompt_id") == prompt_id)


def row(obs: DataFrame, prompt_id: str, model: str) -> Row:
    """One result; KeyError where there is none. Joins serve better for more than a look."""
    found = for_prompt(obs, prompt_id).where(F.col("model") == model).limit(1).collect()
    if not found:
        raise KeyError((prompt_id, model))
    return found[0]


def unknown_ids(obs: DataFrame, ids: DataFrame) -> DataFrame:
    """(prompt_id) of ids that the matrix doesn't have."""
    return ids.select("prompt_id").distinct().join(obs.select("prompt_id"), "prompt_id", "left_anti")


def subset(obs: DataFrame, ids: DataFrame | Iterable[str]) -> DataFrame:
    """The matrix of some prompts, validated anew; KeyError for ids that it doesn't have. No ids give
    an empty table."""
    if not isinstance(ids, DataFrame):
        ids = obs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "prompt_id string")
    unknown = unknown_ids(obs, ids).orderBy("prompt_id").limit(5).collect()
    if unknown:
        raise KeyError("unknown prompt ids: " + ", ".join(r.prompt_id for r in unknown))
    out = obs.join(ids.select("prompt_id").distinct(), "prompt_id", "left_semi")
    return validate(out) if ids.limit(1).count() else out


def records(obs: DataFrame) -> list[dict]:
    """The rows as dictionaries in canonical order, absent fields left out; for small tables."""
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in obs.orderBy("prompt_id", "model").collect()]


def sizes(obs: DataFrame) -> DataFrame:
    """(n_rows, n_prompts, n_models)."""
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("prompt_id").alias("n_prompts"), F.count_distinct("model").alias("n_models"))
