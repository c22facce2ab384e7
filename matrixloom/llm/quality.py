"""Quality rules: gradient-boosted trees over document statistics.

The statistics are worked out from the bytes of whole batches. Trees are grown on histograms of a
bounded sample of labelled rows, with logistic loss and monotonic constraints: a feature marked
+1 (-1) can only raise (lower) the score as it grows, as splits that would break this are refused
and the bounds of a split hold for all nodes below it. The finished trees are flattened into
arrays of feature, threshold, children and value, and a batch descends all trees together.

Cases: null and empty texts have the statistics of an empty document and are scored as such.
A null id is carried; labels without an id, with a null quality, or for no document, train
nothing; of several labels for an id the lowest counts. Without labels every score is 0.5.
Repeated rows get equal scores. Texts are read whole, however long. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, hash52, lowered, mix64, project, word_hashes

#: Bound on the labelled rows that the trees are fitted on; scoring has none.
TRAIN_ROWS = 20_000
TREES = 60
DEPTH = 4
RATE = 0.15
BINS = 64
LEAST_ROWS = 20
KEEP = 0.5
SEED = "quality-1"

FEATURES = ["log_bytes", "log_words", "mean_word", "alpha", "digit", "symbol", "upper", "space", "distinct_words", "marked_words", "long_words", "distinct_lines", "mean_line", "top_byte"]
#: Wording that repeats less can't lower quality; symbols and words that end in them can't raise it.
MONOTONE = {"symbol": -1, "marked_words": -1, "distinct_words": 1, "distinct_lines": 1}

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[:33] = True
_SYMBOL = ~(_ALPHA | _DIGIT | _SPACE)
_SYMBOL[list(b".,;:'\"()?-")] = False


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n).astype(float)


def statistics(data: np.ndarray, offsets: np.ndarray, folded: np.ndarray, folded_offsets: np.ndarray) -> np.ndarray:
    """documents x FEATURES. folded: the same texts in lower case."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    w, starts, ends, doc = word_hashes(folded, folded_offsets)
    count = np.bincount(doc, minlength=n).astype(float)
    words = np.maximum(count, 1)
    length = ends - starts
    marked = _SYMBOL[folded[ends - 1]] if len(ends) else np.zeros(0, bool)
    # lines: words up to a newline, hashed as the sum of their mixed hashes and places
    newline = np.concatenate([[0], np.cumsum(folded == 10, dtype=np.int64)])
    line = newline[starts] + doc if len(starts) else np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(line) else np.zeros(0, np.int64)
    place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line)))) if len(line) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(mix64(w + place.astype(np.uint64)), head) if len(head) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[head], minlength=n).astype(float)
    letters = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * 256 + data, minlength=n * 256).reshape(n, 256)
    letters[:, :33] = 0
    return np.stack(
        [
            np.log1p(size), np.log1p(count), np.bincount(doc, length, minlength=n) / words,
            _sums(_ALPHA[data], offsets) / some, _sums(_DIGIT[data], offsets) / some, _sums(_SYMBOL[data], offsets) / some, _sums(_UPPER[data], offsets) / some, _sums(_SPACE[data], offsets) / some,
            _distinct(w, doc, n) / words, np.bincount(doc, marked, minlength=n) / words, np.bincount(doc, length > 20, minlength=n) / words,
            _distinct(line_hash, doc[head], n) / np.maximum(lines, 1), count / np.maximum(lines, 1), letters.max(1) / some,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """All nodes of all trees; a leaf is its own child on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Newton boosting of histogram trees."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)

            def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
                G, H = g[rows].sum(), h[rows].sum()
                value = float(np.clip(-G / (H + 1), low, high))
                me = len(nodes)
                nodes.append([0, np.inf, me, me, value * rate])
                if level == depth or len(rows) < 2 * LEAST_ROWS:
                    margin[rows] += value * rate
                    return me
                best = (1e-6, None)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    m = len(e) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, wt, minlength=m))[:-1] for wt in (g[rows], h[rows], None))
                    vl, vr = np.clip(-gl / (hl + 1), low, high), np.clip(-(G - gl) / (H - hl + 1), low, high)
                    # the loss removed, for values within the bounds
                    gain = -(gl * vl + 0.5 * (hl + 1) * vl**2) - ((G - gl) * vr + 0.5 * (H - hl + 1) * vr**2) + (G * value + 0.5 * (H + 1) * value**2)
                    bad = (nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | (monotone[f] * (vr - vl) < 0)
                    gain[bad] = -np.inf
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], (f, i, vl[i], vr[i]))
                if best[1] is None:
                    margin[rows] += value * rate
                    return me
                f, i, vl, vr = best[1]
                mid = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[f]]
                to_left = binned[rows, f] <= i
                nodes[me][:2] = [f, float(edges[f][i])]
                nodes[me][2] = grow(rows[to_left], level + 1, *bounds[0])
                nodes[me][3] = grow(rows[~to_left], level + 1, *bounds[1])
                return me

            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    cols = list(zip(*nodes, strict=True)) or [[], [], [], [], []]
    kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
    return Trees(np.array(roots, np.int32), *(np.array(c, k) for c, k in zip(cols, kinds, strict=True)), base, depth)


def _features(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row."""
    arrow_batches(docs.sparkSession)
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, x in batch_statistics(b.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), lists], names=["doc_id", "stats"])

    return project(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, stats array<double>")


def batch_statistics(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for first, last, data, offsets in chunks(texts):
        low = lowered(texts.slice(first, last - first))
        (_, _, folded, folded_offsets), *_ = chunks(low, 1 << 62)
        yield first, last, statistics(data, offsets, folded, folded_offsets)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled documents with the rows lowest hashes, rows at most; rows that repeat
    an id count once unless their texts differ."""
    known = project(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(hash52(F.lit(SEED), F.col("doc_id")), "doc_id").limit(rows)
    picked = dict(known.collect())
    monotone = [MONOTONE.get(f, 0) for f in FEATURES]
    if not picked:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), monotone)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in picked], "doc_id bigint"))  # rows at most
    got = _features(project(docs, "doc_id", "text").join(wanted, "doc_id")).distinct()
    got = got.orderBy(hash52(F.lit(SEED), F.col("doc_id")), "doc_id", "stats").limit(rows).collect()
    got.sort(key=lambda r: (r.doc_id, r.stats))
    x = np.array([r.stats for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(picked[r.doc_id] > 0) for r in got]), monotone)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, score, keep) of each row: the probability of good quality."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for first, last, x in batch_statistics(b.column(1)):
                p = np.round(model.predict(x), 9)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(p), pa.array(p >= KEEP)], names=["doc_id", "score", "keep"])

    return project(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, score double, keep boolean")
