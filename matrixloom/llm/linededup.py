"""Substring removal by hashing lines and the sentences in them.

A unit is a whole line of any length, or, in a line of several sentences, a sentence of LEAST_WORDS
words or more: a part that ends in a word with a full stop, exclamation or question mark, so that
passages are found wherever in a line they begin. Shorter sentences inside a line stay, as "In."
or "Of the." repeat by chance. Units are normalised (ASCII and Latin-1 letters lower-cased, space
collapsed), hashed twice to 64 bits from the bytes up, and grouped over the whole corpus. The
occurrence of lowest document id and lowest place stays, the rest are cut from their texts together
with the space up to the next unit; the offsets that were cut refer to the original text, in
characters.

Repeats within a batch are marked before the shuffle, so a unit that fills the corpus sends one
row a batch. Grouping streams through a rank: no group is held in memory.

Cases: null texts come out null with nothing cut, empty ones empty; very long texts are units like
any other. A null id ranks after all
others. Rows that repeat id and text are one document and come out once; documents of equal id
but different text are ranked by hash. An empty table gives an empty one. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _BASE2, arrow_batches, chunks, project, span_hash, word_hashes

LEAST_WORDS = 5
SCHEMA = "h1 bigint, h2 bigint, doc_id bigint, k1 bigint, k2 bigint, start int, stop int, again boolean"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, which keeps every byte in its place."""
    out = _LOWER[data]
    if len(out) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def units(data: np.ndarray, offsets: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """h1, h2, document, first and last character of each line and of each sentence of least words
    or more."""
    folded = fold(data)
    w, starts, ends, doc = word_hashes(folded, offsets)
    n = len(w)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    w2 = span_hash(folded, starts, ends, _BASE2)
    lines = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    line_end = np.ones(n, bool)
    line_end[:-1] = (doc[1:] != doc[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
    end = np.flatnonzero(line_end | _STOP[data[ends - 1]]) + 1
    first = np.concatenate([[0], end[:-1]])
    d = doc[first]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    start = starts[first]
    following = offsets[d + 1].copy()
    same = d[1:] == d[:-1]
    following[:-1][same] = start[1:][same]
    base = chars[offsets[d]]
    whole = line_end[end - 1] & ((first == 0) | line_end[first - 1])
    keep = whole | (end - first >= least)
    first, end = first[keep], end[keep]
    return span_hash(w, first, end).view(np.int64), span_hash(w2, first, end, _BASE2).view(np.int64), d[keep], (chars[start] - base)[keep], (chars[following] - base)[keep]


def _run(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k1, k2 = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            rank = np.where(known, ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
            for at, _, data, offsets in chunks(b.column(3)):
                h1, h2, doc, start, stop = units(data, offsets, least)
                row = doc + at
                order = np.lexsort((start, k2[row], k1[row], ~known[row], rank[row], h2, h1))
                s1, s2, sr, ss = h1[order], h2[order], row[order], start[order]
                head = np.ones(len(order), bool)
                head[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
                lead = np.flatnonzero(head)[np.cumsum(head) - 1]
                lr = sr[lead]
                later = (rank[sr] != rank[lr]) | (known[sr] != known[lr]) | (k1[sr] != k1[lr]) | (k2[sr] != k2[lr]) | (ss != ss[lead])
                again = np.empty(len(order), bool)
                again[order] = later
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1), pa.array(h2), ids.take(pa.array(row)), pa.array(k1[row]), pa.array(k2[row]), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(again)],
                    names=["h1", "h2", "doc_id", "k1", "k2", "start", "stop", "again"],
                )

    return run


def remove_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text, removed, n_removed): the text that stays, and the spans cut from the
    original as an array of (start, stop) in characters."""
    arrow_batches(docs.sparkSession)
    d = project(docs, "doc_id", "text")
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7)).alias("k2"), "text")
    found = d.where("text is not null").mapInArrow(_run(least), SCHEMA)
    # what is already known to be a repeat goes to some partition, not to that of its digest
    found = found.withColumn("g1", F.when(F.col("again"), F.col("k1")).otherwise(F.col("h1"))).withColumn("g2", F.when(F.col("again"), F.col("k2") + F.col("start")).otherwise(F.col("h2")))
    w = Window.partitionBy("g1", "g2").orderBy(F.col("doc_id").asc_nulls_last(), "k1", "k2", "start")
    gone = found.select("k1", "k2", "start", "stop", "again", F.rank().over(w).alias("nth")).where("again or nth > 1")
    spans = gone.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    out = d.join(spans, ["k1", "k2"], "left").dropDuplicates(["k1", "k2"])
    kept = "array_join(zip_with(concat(array(0), removed.stop), concat(removed.start, array(length(text))), (a, b) -> substring(text, a + 1, b - a)), '')"
    none = F.expr("cast(array() as array<struct<start: int, stop: int>>)")
    return out.select("doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.expr(kept)).alias("text"), F.coalesce("removed", none).alias("removed"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))
