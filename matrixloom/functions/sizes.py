"""Broadcast hints for tables that were measured first, parts by size, and tables kept for many passes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side is broadcast only if it has no more rows and no more bytes, as JSON, than this.
ROWS = 100_000
BYTES = 16 << 20


def small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """The table with a broadcast hint if it is small, else as it is, to be joined by a shuffle."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, octets = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and octets <= size else df


def is_small(rows: int, width: int = 1) -> bool:
    """Whether so many rows of width numbers are few enough to be broadcast."""
    return rows <= ROWS and rows * width * 8 <= BYTES


def small_rows(df: DataFrame, rows: int, width: int = 1) -> DataFrame:
    """The same for a table that the driver made of so many rows of width numbers."""
    return F.broadcast(df) if is_small(rows, width) else df


def shares(df: DataFrame, size: int = 1 << 20, least: int = 1 << 16) -> int:
    """Into how many parts a table of files is split so that each has about size bytes of them; as many
    as there are cores if that gives each of them least bytes."""
    octets = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-octets // size), min(df.sparkSession.sparkContext.defaultParallelism, octets // least))


#: Most parts of a table by shares(); of a table that Spark knows no size of there would be any number.
MOST = 1 << 14


def kept(df: DataFrame, key: str | None = None) -> DataFrame:
    """The table on the executors' disks, worked out once and never held in memory; with a key by it and in
    its order, so that what groups by the key next neither shuffles nor sorts. The caller unpersists it."""
    if key:
        n = shares(df, 2 << 20)
        df = (df.repartition(n, key) if n <= MOST else df.repartition(key)).sortWithinPartitions(key)
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df
