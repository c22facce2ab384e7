"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; rank r of n stands at the fraction
(r - 1/2) / n. Sorted by fraction every prefix holds the sources in the proportions of the whole,
so equal cuts of that order give shards that all match the mixture.

Both ranks are found by a range sort over the whole cluster (common.ranked), so a hot source
is never in one task.

Cases: a null source is a source of its own and sorts first; a null id hashes as the empty id.
Equal fractions go by source, then id; repeated rows are interchangeable. Shards differ by one
row at most; with fewer rows than shards some stay empty. Texts are not read. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash52, project, ranked

SEED = "shard-1"
SHARDS = 64


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, place, shard): place 1, 2, ... in the interleaved order, shard from 0."""
    d = project(docs, "doc_id", "source")
    d = d.withColumn("draw", hash52(F.lit(seed), F.col("source"), F.col("doc_id")))
    r = ranked(d, "source", ["draw", "doc_id"], "r", "n")
    r = r.select("doc_id", "source", ((F.col("r") - F.lit(0.5)) / F.col("n")).alias("frac"))
    r = ranked(r, None, ["frac", "source", "doc_id"], "place", "all")
    return r.select("doc_id", "source", "place", F.expr(f"((place - 1) * {int(shards)}) div all").cast("int").alias("shard"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) AS draw
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST) AS r, count(*) OVER (PARTITION BY source) AS n FROM d
), f AS (
  SELECT *, (r - CAST(0.5 AS DOUBLE)) / n AS frac FROM r
), o AS (
  SELECT *, row_number() OVER (ORDER BY frac, source NULLS FIRST, doc_id NULLS FIRST) AS place, count(*) OVER () AS everything FROM f
)
SELECT doc_id, source, place, CAST(((place - 1) * {SHARDS}) // everything AS INTEGER) AS shard FROM o
"""
