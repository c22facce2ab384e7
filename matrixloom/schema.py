"""The observation table: one measured result of one prompt under one model."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = "matrixloom.observation.v1"
#: Prefix of all hashed identifiers; a parameter wherever it is used.
NAMESPACE = "matrixloom"
MAX_FILE_BYTES = 64 << 20
MAX_LINE_BYTES = 1 << 20
MAX_ROWS = 1_000_000

REQUIRED = ("prompt_id", "model", "quality", "latency_ms", "cost_usd")
OPTIONAL = ("prompt", "task", "trace_id", "sequence_index", "load_ms", "metadata")
MEASURES = ("quality", "latency_ms", "cost_usd", "load_ms")
HEAD = ("prompt_id", "prompt", "task", "trace_id", "sequence_index")
OBJECTIVES = ("balanced", "cost", "latency")
EPSILON = 1e-12

OBSERVATIONS = T.StructType(
    [
        T.StructField("prompt_id", T.StringType(), False),
        T.StructField("prompt", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("sequence_index", T.LongType()),
        T.StructField("model", T.StringType(), False),
        T.StructField("quality", T.DoubleType(), False),
        T.StructField("latency_ms", T.DoubleType(), False),
        T.StructField("cost_usd", T.DoubleType(), False),
        T.StructField("load_ms", T.DoubleType(), False),
        T.StructField("metadata", T.StringType()),
    ]
)


class ValidationError(ValueError):
    """Observations that break the contract of the table."""


class OptimizationError(ValueError):
    """An audit or a compilation that the data can't support."""


class PolicyError(ValueError):
    """A policy document that contradicts itself."""
