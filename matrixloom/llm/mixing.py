"""Mixing sources to target weights by Pareto order sampling (Rosen 1997).

Each source gets a whole number of copies in proportion to its weight. Within it a document
expects copies in proportion to the root of its length; the whole part is certain, and for the
fractions p a fixed-size sample with unequal probabilities takes the documents with the lowest

    (u / (1 - u)) / (p / (1 - p)),    u uniform from a hash of seed, source and id.

Cases: a null source is a source of its own; a null or non-positive n_chars counts as length 1;
a null id draws as the empty id. Ties go to the lower id (null first); rows that agree in source,
id and length are interchangeable. An empty table gives an empty one. Other columns are ignored
by sample_copies and carried through by mix_documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, hash52, null_safe, position, project, small, with_columns_apart

SEED = "mix-1"
#: Steps of the order key per factor e, for finding the cut without sorting a source.
STEPS = 4096


def _measure(docs: DataFrame) -> DataFrame:
    d = project(docs, "doc_id", "source", "n_chars")
    size = F.floor(F.sqrt(F.greatest(F.coalesce("n_chars", F.lit(1)), F.lit(1)).cast("double"))).cast("bigint")
    return d.select("doc_id", "source", size.alias("size"))


def source_quotas(docs: DataFrame, rate: float = 1.0, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(source, n, total, copies): whole copies for each source, which sum to round(rate x rows).

    weights gives integers by source, others get none; without it a source weighs the root of
    its row count (temperature 2). Fractions go to the largest remainders, ties by name.
    """
    by = _measure(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    if weights is None:
        weight: Column = F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("bigint")
    else:
        weight = F.lit(0).cast("bigint")
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(w)).cast("bigint")).otherwise(weight)
    everything = Window.partitionBy(F.lit(0))
    by = by.withColumn("w", weight).withColumn("w_all", F.sum("w").over(everything)).where("w_all > 0")
    by = by.withColumn("m", F.floor(F.sum("n").over(everything).cast("double") * F.lit(float(rate)) + 0.5).cast("bigint"))
    by = by.withColumn("base", F.expr("cast((cast(m as decimal(19,0)) * cast(w as decimal(19,0))) div cast(w_all as decimal(19,0)) as bigint)"))
    by = by.withColumn("left", F.expr("cast((cast(m as decimal(19,0)) * cast(w as decimal(19,0))) % cast(w_all as decimal(19,0)) as bigint)"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("left"), F.col("source").asc_nulls_first())
    extra = F.row_number().over(order) <= F.col("m") - F.sum("base").over(everything)
    return by.select("source", "n", "total", (F.col("base") + F.when(extra & (F.col("w") > 0), 1).otherwise(0)).alias("copies"))


def _keyed(rows: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """Adds whole copies, fraction p and order key q to rows with doc_id, source and size."""
    rows = null_safe(rows, quotas.select("source", "total", "copies"), ["source"])
    share = F.col("copies").cast("double") * F.col("size") / F.col("total")
    rows = rows.withColumn("whole", F.floor(share).cast("bigint")).withColumn("p", share - F.col("whole"))
    u = (hash52(F.lit(seed), F.col("source"), F.col("doc_id")) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = rows.withColumn("u", u)
    return rows.withColumn("q", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))


def _step() -> Column:
    return F.floor(F.log(F.col("q")) * STEPS).cast("bigint")


def _thresholds(keyed: DataFrame, quotas: DataFrame) -> DataFrame:
    """(source, cut, need): all rows below the step cut are taken, and need rows of that step."""
    by = keyed.groupBy("source").agg(F.sum("whole").alias("given"))
    wanted = null_safe(quotas.select("source", "copies"), by, ["source"]).select("source", (F.col("copies") - F.col("given")).alias("wanted"))
    steps = keyed.where("q is not null").groupBy("source", _step().alias("step")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = null_safe(steps.withColumn("upto", F.sum("n").over(running)), wanted, ["source"])
    edge = steps.where("upto >= wanted and upto - n < wanted")
    got = edge.select("source", F.col("step").alias("cut"), (F.col("wanted") - (F.col("upto") - F.col("n"))).alias("need"))
    rest = quotas.select("source").join(got.select(F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s")), "left_anti")
    # a source that wants none, or more than it has: none or all of its fractions
    rest = null_safe(rest, wanted, ["source"])
    none, every = F.lit(-(1 << 62)), F.lit(1 << 62)
    return got.unionByName(rest.select("source", F.when(F.col("wanted") <= 0, none).otherwise(every).alias("cut"), F.lit(0).cast("bigint").alias("need")))


def _copies(keyed: DataFrame, thresholds: DataFrame, names: list[str]) -> DataFrame:
    """Rows with copies >= 1. Only the rows in the step of the cut are sorted."""
    rows = null_safe(keyed, thresholds, ["source"]).withColumn("step", _step())
    taken = F.when(F.col("step") < F.col("cut"), 1).otherwise(0)
    sure = rows.where("step is null or step <> cut").withColumn("n_copies", F.col("whole") + F.coalesce(taken, F.lit(0)))
    order = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    edge = rows.where("step = cut").withColumn("n_copies", F.col("whole") + F.when(F.row_number().over(order) <= F.col("need"), 1).otherwise(0))
    return sure.select(*names, "n_copies").unionByName(edge.select(*names, "n_copies")).where("n_copies >= 1")


def sample_copies(docs: DataFrame, rate: float = 1.0, weights: Mapping[str, int] | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_copies) of each document that is drawn at least once."""
    quotas = cut(source_quotas(docs, rate, weights))
    keyed = _keyed(_measure(docs), small(quotas), seed)
    thresholds = cut(_thresholds(keyed, quotas))
    return _copies(keyed, small(thresholds), ["doc_id", "source"])


def mix_documents(docs: DataFrame, rate: float = 1.0, weights: Mapping[str, int] | None = None, seed: str = SEED) -> DataFrame:
    """The documents with all their columns, each as often as it is drawn.

    The text is not shuffled: rows are judged against the small table of cuts where they lie,
    and only those in the step of a cut are sorted.
    """
    quotas = cut(source_quotas(docs, rate, weights))
    thresholds = cut(_thresholds(_keyed(_measure(docs), small(quotas), seed), quotas))
    plain, names = with_columns_apart(docs)

    def own(name: str, kind: str) -> Column:
        at = position(docs, name)
        return F.lit(None).cast(kind) if at is None else F.col(f"c{at}").cast(kind)

    size = F.floor(F.sqrt(F.greatest(F.coalesce(own("n_chars", "bigint"), F.lit(1)), F.lit(1)).cast("double"))).cast("bigint")
    carried = plain.columns
    rows = plain.select("*", own("doc_id", "bigint").alias("doc_id"), own("source", "string").alias("source"), size.alias("size"))
    drawn = _copies(_keyed(rows, small(quotas), seed), small(thresholds), carried)
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies")))).select(*carried).toDF(*names)


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 1), 1) AS DOUBLE))) AS BIGINT) AS size
  FROM documents
), g AS (
  SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY source
), w AS (
  SELECT *, CAST(floor(sqrt(CAST(n AS DOUBLE)) * 1000) AS BIGINT) AS w FROM g
), q0 AS (
  SELECT *, sum(CAST(w AS HUGEINT)) OVER () AS w_all, CAST(sum(n) OVER () AS HUGEINT) AS m FROM w
), q1 AS (
  SELECT *, CAST((m * w) // w_all AS BIGINT) AS base, CAST((m * w) % w_all AS BIGINT) AS rem FROM q0
), q AS (
  SELECT source, total, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, source NULLS FIRST) <= m - sum(base) OVER () THEN 1 ELSE 0 END AS copies
  FROM q1
), k AS (
  SELECT d.*, q.copies, CAST(q.copies AS DOUBLE) * d.size / q.total AS share,
         (CAST(('0x' || substr(md5('mix-1|' || coalesce(d.source, '') || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
), p AS (
  SELECT *, CAST(floor(share) AS BIGINT) AS whole, share - floor(share) AS p FROM k
), o AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds, copies - sum(whole) OVER (PARTITION BY source) AS wanted FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS FIRST, size) AS rn FROM o
)
SELECT doc_id, source, CAST(whole + CASE WHEN odds IS NOT NULL AND rn <= wanted THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM r WHERE whole + CASE WHEN odds IS NOT NULL AND rn <= wanted THEN 1 ELSE 0 END >= 1
"""
