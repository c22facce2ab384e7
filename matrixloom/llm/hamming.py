"""Nearest neighbours by multi-index hashing (Norouzi, Punjani and Fleet 2012).

Vectors are normalised, centred, turned by a rotation learned on a bounded sample (principal
axes, then iterative quantisation), and reduced to the signs: a code of up to 64 bits. Every row is
indexed: its code is cut into substrings of WIDTH bits, each with a table from value to rows. Two
codes within Hamming radius r = q m + a agree within q in one of the first a + 1 of the m
substrings or within q - 1 in one of the rest, so looking up every value that near retrieves every
code within r. What is retrieved is checked by its whole code, ranked again by the cosine of the
floats, and the K best are kept.

The questions are a stated set, the rows whose id is divisible by EVERY; the answers come from all
rows. The index lies in shards of at most SHARD_ROWS rows and the questions in blocks of as many;
each block asks each shard, and answers of K rows a shard are merged.

The radius is learned: the least that holds TARGET of the true neighbours of QUERIES sampled rows,
which are compared with all rows in one pass. Where vectors cluster it is small and the tables are
asked for few values; where they lie evenly over a sphere, the nearest are hardly nearer than the
rest, so a large share of the values is within it, as with any code of this length.

Cases: null, empty or zero vectors, vectors with null or non-finite entries, and vectors of
another length than the most usual one have no code: they neither ask nor answer. A null id asks
nothing; as an answer it is reported as null and sorts last among ties. Repeated rows with one id
answer for each other, never for the same row; ties go to the lower id. Fewer than K answers come
where fewer codes are within the radius. An empty table, and one without a usable vector, gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, cut, drop_cut, hash52, project

BITS = 64
WIDTH = 16
K = 10
EVERY = 100
TARGET = 0.95
#: Bounds on the rows that the rotation is learned from, and on those whose neighbours give the radius.
TRAIN_ROWS = 4096
QUERIES = 256
SHARD_ROWS = 1 << 17
#: A shard has no fewer rows than this, short of the last ones, however many tasks could be busy.
LEAST_ROWS = 1 << 12
#: Questions looked up, and pairs ranked, at a time.
STEP, PAIRS = 64, 1 << 16
SEED = "mih-1"
FOUND = "row bigint, other bigint, other_id bigint, sim double"


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """uint64 code of each row of normalised vectors."""
        bits = (x - self.mean) @ self.turn > 0
        packed = np.zeros((len(x), 8), np.uint8)
        packed[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1, bitorder="little")
        return packed.view(np.uint64).ravel()


def learn(x: np.ndarray, bits: int = BITS, rounds: int = 30) -> Coder:
    """Rotation from a sample of normalised vectors."""
    rng = np.random.default_rng(7)
    bits = min(bits, x.shape[1])
    mean = x.mean(0)
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c)
    axes = axes[:, ::-1][:, :bits]
    p = c @ axes
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
        turn = (u @ vt).T
    return Coder(mean, axes @ turn)


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised rows and which of them are usable."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    ok = lengths == dims
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1][ok]
    x = np.zeros((n, dims), np.float32)
    x[ok] = flat[begin[:, None] + np.arange(dims)]
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    ok &= np.isfinite(norm) & (norm > 0)
    x[ok] = (x[ok] / norm[ok, None]).astype(np.float32)
    return x, ok


def _coded(vectors: DataFrame, coder: Coder) -> DataFrame:
    """(row, vec_id, code, vec): rows that have a code; vec is the normalised vector as bytes."""
    shared = vectors.sparkSession.sparkContext.broadcast(coder)
    dims = len(coder.mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ok = _vectors(b.column(2), dims)
            keep = pa.array(ok)
            blobs = pa.array([r.tobytes() for r in x[ok]], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(c.codes(x[ok]).view(np.int64)), blobs], names=["row", "vec_id", "code", "vec"])

    return vectors.mapInArrow(run, "row bigint, vec_id bigint, code bigint, vec binary")


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of width bits with at most radius bits set."""
    return np.array([sum(1 << i for i in c) for n in range(min(radius, width) + 1) for c in combinations(range(width), n)], np.int64)


def plan(bits: int, radius: int, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each substring; of radius -1 are those that need no look-up."""
    m = max(1, -(-bits // width))
    q, a = divmod(radius, m)
    out, shift = [], 0
    for i in range(m):
        w = bits // m + (i < bits % m)
        out.append((shift, w, q if i <= a else q - 1))
        shift += w
    return out


class Index:
    """Tables from the values of each substring to the rows of a shard."""

    def __init__(self, codes: np.ndarray, parts: list[tuple[int, int, int]], radius: int):
        self.codes, self.radius, self.tables = codes, radius, []
        for shift, width, r in parts:
            if r < 0:
                continue
            value = self._value(codes, shift, width)
            order = np.argsort(value, kind="stable")
            held, first = np.unique(value[order], return_index=True)
            near = sum(comb(width, i) for i in range(min(r, width) + 1))
            # values that no row has needn't be asked for
            masks = ball(width, r) if near < len(held) else None
            self.tables.append((shift, width, r, order, held, np.append(first, len(order)), masks))

    @staticmethod
    def _value(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (codes >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, row) of every code within the radius of the codes asked for."""
        seen = np.zeros((len(asked), len(self.codes)), bool)
        for shift, width, r, order, held, bounds, masks in self.tables:
            value = self._value(asked, shift, width)
            if masks is None:
                question, at = np.nonzero(np.bitwise_count(value[:, None] ^ held) <= r)
            else:
                probe = (value[:, None] ^ masks).ravel()
                at = np.minimum(np.searchsorted(held, probe), len(held) - 1)
                hit = np.flatnonzero(held[at] == probe)
                question, at = hit // len(masks), at[hit]
            first, n = bounds[at], bounds[at + 1] - bounds[at]
            place = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            seen[np.repeat(question, n), order[place]] = True
        question, row = np.nonzero(seen)
        near = np.bitwise_count(asked[question] ^ self.codes[row]) <= self.radius
        return question[near], row[near]


def _best(rows: np.ndarray, ids: np.ndarray, known: np.ndarray, others: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each row: by similarity, then id with null last, then row."""
    order = np.lexsort((others, ids, ~known, -sims, rows))
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, int)
    nth = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
    return order[nth < k]


def _floats(blobs: pd.Series, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dims)


def _search(parts: list[tuple[int, int, int]], radius: int, k: int, dims: int):
    """The k best answers of one shard to one block of questions."""

    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(shard):
            index = Index(shard["code"].to_numpy(np.int64).view(np.uint64), parts, radius)
            x, rows = _floats(shard["vec"], dims), shard["row"].to_numpy()
            known, ids = shard["vec_id"].notna().to_numpy(), shard["vec_id"].fillna(0).to_numpy(np.int64)
            y, codes, own = _floats(asked["vec"], dims), asked["code"].to_numpy(np.int64).view(np.uint64), asked["row"].to_numpy()
            for s in range(0, len(asked), STEP):
                i, j = index.within(codes[s : s + STEP])
                i += s
                other = own[i] != rows[j]
                i, j = i[other], j[other]
                sims = np.empty(len(i))
                for p in range(0, len(i), PAIRS):
                    one, two = y[i[p : p + PAIRS]].astype(np.float64), x[j[p : p + PAIRS]].astype(np.float64)
                    sims[p : p + PAIRS] = np.round(np.einsum("ij,ij->i", one, two), 6)
                b = _best(i, ids[j], known[j], rows[j], sims, k)
                other_id = pd.array(ids[j[b]], "Int64")
                other_id[~known[j[b]]] = pd.NA
                out.append(pd.DataFrame({"row": own[i[b]], "other": rows[j[b]], "other_id": other_id, "sim": sims[b]}))
        return pd.concat(out) if out else pd.DataFrame({"row": [], "other": [], "other_id": [], "sim": []})

    return run


def learn_radius(coded: DataFrame, coder: Coder, rows: np.ndarray, x: np.ndarray, k: int, target: float) -> int:
    """Least radius that holds the share target of the k nearest of each row of x among all rows."""
    shared = coded.sparkSession.sparkContext.broadcast((rows, x.astype(np.float32).astype(np.float64), coder.codes(x)))
    dims = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y, codes = shared.value
        at = np.arange(len(y))[:, None]
        sims, distance = np.full((len(y), k), -np.inf), np.zeros((len(y), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            got = y @ np.frombuffer(b"".join(b.column("vec").to_pylist()), np.float32).reshape(-1, dims).astype(np.float64).T
            got[own[:, None] == b.column("row").to_numpy()] = -np.inf
            c = b.column("code").to_numpy().view(np.uint64)
            got, far = np.concatenate([sims, got], 1), np.concatenate([distance, np.bitwise_count(codes[:, None] ^ c)], 1)
            top = np.argpartition(-got, k - 1, axis=1)[:, :k]
            sims, distance = got[at, top], far[at, top]
        i, j = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(sims[i, j]), pa.array(distance[i, j])], names=["q", "sim", "distance"])

    near = coded.select("row", "code", "vec").mapInArrow(run, "q bigint, sim double, distance bigint")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "distance"))
    got = near.withColumn("nth", nth).where(F.col("nth") <= k).agg(F.percentile("distance", target)).first()[0]
    return coder.bits if got is None else int(np.ceil(got))


def neighbours(vectors: DataFrame, k: int = K, target: float = TARGET, every: int = EVERY, shard_rows: int = SHARD_ROWS, width: int = WIDTH) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the k nearest of every row that asks, by the rows within
    the radius of its code."""
    spark = vectors.sparkSession
    arrow_batches(spark)
    v = project(vectors, "vec_id", "embedding").where("embedding is not null and size(embedding) > 0")
    empty = spark.createDataFrame([], "vec_id bigint, rank int, neighbour_id bigint, cosine double")
    usual = v.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return empty
    dims = usual.dims
    v = v.where(F.size("embedding") == dims)
    table = cut(v.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"))
    sample = table.orderBy(hash52(F.lit(SEED), F.col("vec_id")), F.hash("embedding"), "row").limit(TRAIN_ROWS).select("row", "embedding").toArrow().combine_chunks()
    x, ok = _vectors(sample.column(1).combine_chunks(), dims)
    if not ok.any():
        return empty
    coder = learn(x[ok].astype(np.float64))
    coded = cut(_coded(table, coder))
    drop_cut(table)
    rows = coded.count()
    radius = learn_radius(coded, coder, sample.column(0).to_numpy()[ok][:QUERIES], x[ok][:QUERIES], k, target)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-rows // shard_rows), min(tasks, -(-rows // LEAST_ROWS)), 1)
    asks = coded.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asks.count() // shard_rows))

    def spread(n: int) -> F.Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def each(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asks.select(each(shards).alias("shard"), spread(blocks).alias("block"), "row", "code", "vec")
    right = coded.select(spread(shards).alias("shard"), each(blocks).alias("block"), "row", "vec_id", "code", "vec")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search(plan(coder.bits, radius, width), radius, k, dims), FOUND)
    w = Window.partitionBy("row").orderBy(F.desc("sim"), F.col("other_id").asc_nulls_last(), "other")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.join(asks.select("row", "vec_id"), "row").select("vec_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("neighbour_id"), F.col("sim").alias("cosine"))
