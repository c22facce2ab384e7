"""Digest of a workload: its models, prompts, tasks and traces, none of its measurements."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.functions.hashing import ordered_runs
from matrixloom.operators.validate import heads
from matrixloom.schema import VERSION


def fingerprint(obs: DataFrame, version: str = VERSION) -> DataFrame:
    """(fingerprint): SHA-256 of canonical JSON with sorted keys. The prompts pass the driver in order
    of their ids, a partition at a time, as the digest is defined over all of them."""
    h = heads(obs)
    ident = F.sha2(F.coalesce("prompt", F.concat(F.lit("prompt_id:"), "prompt_id")), 256)
    one = F.to_json(F.struct("prompt_id", ident.alias("prompt_identity_sha256"), "sequence_index", "task", "trace_id"), {"ignoreNullFields": "false"})
    pieces = h.select(F.lit("").alias("part"), F.col("prompt_id").alias("ident"), F.encode(F.concat(F.lit(","), one), "utf-8").alias("piece"))
    models = obs.select("model").distinct().agg(F.to_json(F.array_sort(F.collect_set("model")))).first()[0]
    # pieces begin with a comma: the first one stands for the bracket
    text = hashlib.sha256(f'{{"models":{models},"prompts":['.encode())
    first = True
    for run in ordered_runs(pieces):
        text.update(run.run[1:] if first else run.run)
        first = False
    text.update(f'],"schema_version":"{version}"}}'.encode())
    return obs.sparkSession.createDataFrame([("sha256:" + text.hexdigest(),)], "fingerprint string")
