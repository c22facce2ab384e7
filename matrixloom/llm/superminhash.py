"""Near duplicates by SuperMinHash (Ertl 2017), banding, exact verification and union-find.

1. Every document gives the signature of its word trigrams: element by element a random
   permutation of the slots is walked, step j offering j + r to one slot. All elements of a
   batch take a step at once; a document stops once each slot holds a value below j + 1, as no
   later step can lower one. The values are those of the sequential algorithm.
2. Equal texts become one node. Nodes that agree in a band of ROWS slots share a bucket.
3. In a bucket pairs are compared by their whole signatures, except pairs already joined by others.
   An estimate that is SURE above the threshold or below it decides, as it is wrong less than
   once in 30,000 times; nodes of pairs in between are compared by the exact Jaccard similarity
   of their sets of shingles.
4. A bucket of more than BUCKET nodes is first searched in parts. When the components so far are
   known, nodes outside the largest one of the bucket are compared with the nodes of all parts.
   So no task holds more than a few parts, and no pair of a bucket is left out.
5. The edges are united within partitions, then by rounds of large-star and small-star over the
   cluster. A group is named by its lowest id.

Words are runs of non-space bytes of the lower-cased text. Documents of one or two words have the
whole as their only shingle.

Cases: null texts and texts without words stand alone, one group a row; rows that repeat id and
text are one document. A null id sorts after all others; a group of null ids alone has a null
name. Groups never depend on the order of rows. Texts are read whole, however long. Empty tables
give empty results. Other columns are ignored by near_duplicates and carried through by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, chunks, complete_groups, cut, drop_cut, lowered, mix64, position, project, small, with_columns_apart, word_hashes

SLOTS = 128
ROWS = 3
BANDS = 42
SHINGLE = 3
THRESHOLD = 0.4
SURE = 0.2
BUCKET = 4096
_GOLD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_ODD = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25)]


def _draw(e: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th uniform and the j-th choice among slots j.. of each element."""
    x = mix64(e + np.uint64(_GOLD * (2 * j + 1) & _ALL))
    y = mix64(e ^ np.uint64(_GOLD * (2 * j + 2) & _ALL))
    k = j + ((y >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, k


def signatures(elements: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """n_docs x slots values; inf throughout for a document without elements."""
    h = np.full(n_docs * slots, np.inf)
    live = np.bincount(doc, minlength=n_docs) > 0
    e, d, perm = elements, doc.astype(np.int64), None
    for j in range(slots):
        if not len(e):
            break
        r, k = _draw(e, j, slots)
        if j == 0:
            slot = first = k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(e), 1))
                rows = np.arange(len(e))
                perm[rows, first] = 0
                perm[rows, 0] = first
            rows = np.arange(len(e))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
            perm[rows, j] = slot
        np.minimum.at(h, d * slots + slot, r + j)
        live &= ~(h.reshape(n_docs, slots) < j + 1).all(axis=1)
        keep = live[d]
        if not keep.all():
            e, d = e[keep], d[keep]
            if j == 0:
                first = first[keep]
            else:
                perm = perm[keep]
    return h.reshape(n_docs, slots)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of size words; of all words where there are fewer."""
    w, _, _, doc = word_hashes(data, offsets)
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    if not len(w):
        return w, doc
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    left = (first + count)[doc] - np.arange(len(w))  # words from here to the end
    starts = np.flatnonzero((left >= size) | (np.arange(len(w)) == first[doc]) & (count[doc] < size))
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        has = left[starts] > i
        at = np.minimum(starts + i, len(w) - 1)
        out += np.where(has, w[at] * _ODD[i % len(_ODD)] + np.uint64(i), np.uint64(0))
    return mix64(out), doc[starts]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sig, bands) of each document with a word. sig: SLOTS x 16 bits; bands:
    a key for each band."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in chunks(lowered(b.column(2))):
                n = last - first
                elements, doc = shingles(data, offsets)
                some = np.bincount(doc, minlength=n) > 0
                bits = mix64(signatures(elements, doc, n)[some].view(np.uint64))
                keys = np.zeros((len(bits), BANDS), np.uint64)
                for i in range(ROWS):
                    keys = keys * _ODD[2] + bits[:, i : BANDS * ROWS : ROWS]
                keys = mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(_GOLD))
                sig = (bits & np.uint64(0xFFFF)).astype(np.uint16).tobytes()
                width = 2 * SLOTS
                mask = pa.array(some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                binary = pa.Array.from_buffers(pa.binary(), len(bits), [None, pa.py_buffer(np.arange(len(bits) + 1, dtype=np.int32) * width), pa.py_buffer(sig)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n).filter(mask), b.column(1).slice(first, n).filter(mask), binary, lists], names=["doc_id", "digest", "sig", "bands"])

    d = project(docs, "doc_id", "text").where("text is not null")
    return d.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(run, "doc_id bigint, digest binary, sig binary, bands array<bigint>")


class _Labels:
    """Component of each node of a bucket."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def others(self, i: int) -> np.ndarray:
        return np.flatnonzero(self.label != self.label[i])

    def link(self, i: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Join the components of the nodes found to that of i: an edge to one node of each."""
        _, first = np.unique(self.label[found], return_index=True)
        joined = found[np.sort(first)]
        self.label[np.isin(self.label, self.label[joined])] = self.label[i]
        return [(i, j) for j in joined.tolist()]


def links(sig: np.ndarray, label: np.ndarray, asks: np.ndarray, low: int, high: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of the nodes that ask against all of the bucket: edges that join components by pairs that
    agree in high slots or more; the components then; nodes of different ones that agree in low."""
    held = _Labels(label)
    edges: list[tuple[int, int]] = []
    maybe = []
    for i in np.flatnonzero(asks).tolist():
        j = held.others(i)
        if len(j):
            same = (sig[j] == sig[i]).sum(axis=1)
            if (hit := j[same >= high]).size:
                edges += held.link(i, hit)
            maybe.append((i, j[(same >= low) & (same < high)]))
    open_ = np.zeros(len(sig), bool)
    for i, j in maybe:
        j = j[held.label[j] != held.label[i]]
        open_[j] = True
        open_[i] |= len(j) > 0
    return edges, held.label, open_


def exact_links(sets: list[np.ndarray], label: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that join components by pairs whose Jaccard similarity reaches the threshold."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(value, kind="stable")
    bounds = np.searchsorted(value[order], np.arange(value.max() + 2))
    ends = np.cumsum(size)
    held, edges = _Labels(label), []
    for i in range(len(sets)):
        if len(j := held.others(i)):
            mine = value[ends[i] - size[i] : ends[i]]
            first, n = bounds[mine], bounds[mine + 1] - bounds[mine]
            both = np.bincount(owner[order[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]], minlength=len(sets))[j]
            hit = j[both >= threshold * (size[i] + size[j] - both)]
            if hit.size:
                edges += held.link(i, hit)
    return edges


def _bounds(t: pa.Table, key: str = "bucket") -> np.ndarray:
    k = t.column(key).to_numpy()
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])


def _numbered(c: pa.ChunkedArray) -> np.ndarray:
    return c.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)


COMPARED = "bucket bigint, a binary, b binary, label bigint"


def _compare(low: int, high: int):
    """Edges (a, b) of each bucket, and nodes (a, label) of those pairs that the signatures leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, "bucket"):
            bounds, node, bucket = _bounds(t), t.column("node").combine_chunks(), t.column("bucket").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            label, asks = _numbered(t.column("root")), t.column("asks").to_numpy()
            sizes = np.diff(bounds)
            two = bounds[:-1][sizes == 2]
            two = two[label[two] != label[two + 1]]
            same = (sig[two] == sig[two + 1]).sum(axis=1)
            found = [np.stack([two, two + 1], 1)[same >= high]]
            left = np.stack([two, two + 1], 1)[(same >= low) & (same < high)].ravel()
            at, labels = [left], [left]
            for s, n in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                edges, after, open_ = links(sig[s : s + n], label[s : s + n], asks[s : s + n], low, high)
                if edges:
                    found.append(np.array(edges) + s)
                if open_.any():
                    at.append(np.flatnonzero(open_) + s)
                    labels.append(after[open_])
            pairs, at, labels = np.concatenate(found), np.concatenate(at), np.concatenate(labels)
            none = pa.nulls(len(at), pa.binary())
            for i, b, mark in ((pairs[:, 0], node.take(pa.array(pairs[:, 1])), pa.nulls(len(pairs), pa.int64())), (at, none, pa.array(labels))):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[i]), node.take(pa.array(i)), b, mark], names=["bucket", "a", "b", "label"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in complete_groups(batches, "bucket"):
            bounds, node = _bounds(t), t.column("node").combine_chunks()
            label = t.column("label").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            pairs = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                pairs += [(s + i, s + j) for i, j in exact_links(sets[s:e], label[s:e], threshold)]
            if pairs:
                a, b = (node.take(pa.array(x)) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    return run


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts whose digests are wanted: the distinct hashes, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in chunks(lowered(b.column(1))):
                elements, doc = shingles(data, offsets)
                bounds = np.searchsorted(doc, np.arange(last - first + 1))
                sets = [np.unique(elements[s:e]).tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(sets, pa.binary())], names=["node", "shingles"])

    d = project(docs, "text").where("text is not null").select(F.unhex(F.md5("text")).alias("node"), "text")
    return d.join(small(wanted), "node", "left_semi").mapInArrow(run, "node binary, shingles binary").dropDuplicates(["node"])


def _edges_of(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of verified pairs that join the components of each bucket. rows: bucket, node, sig,
    root, asks. Written."""
    low, high = (int(np.ceil(max(0.0, min(1.0, threshold + x)) * SLOTS)) for x in (-SURE, SURE))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "node")
    compared = cut(rows.mapInArrow(_compare(low, high), COMPARED))
    sure = compared.where("b is not null").select("a", "b")
    left = compared.where("b is null").select("bucket", F.col("a").alias("node"), "label")
    sets = cut(shingle_sets(docs, left.select("node").distinct()))
    left = left.join(sets, "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    both = sure.unionByName(left.mapInArrow(_verify(threshold), "a binary, b binary"))
    out = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_cut(compared, sets)
    return out


def roots_of(nodes: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of each digest that is similar to another, root the lowest of its component. Written."""
    keys = nodes.select(F.col("digest").alias("node"), F.explode("bands").alias("band")).repartition("band")
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keys.join(shared, "band")  # the exchange by band is used twice
    part = F.expr(f"pmod(xxhash64(node, 3), cast((n + {bucket - 1}) div {bucket} as int))")
    members = cut(members.select("band", "node", "n", part.alias("part")))
    sigs = nodes.select(F.col("digest").alias("node"), "sig")
    first = members.select("node", F.when(F.col("n") > bucket, F.xxhash64("band", "part")).otherwise(F.col("band")).alias("bucket"))
    rows = first.join(sigs, "node").select("bucket", "node", "sig", F.col("node").alias("root"), F.lit(True).alias("asks"))
    edges = _edges_of(rows, docs, threshold)
    roots = components(edges)

    # buckets searched in parts: what is outside the largest component asks all parts
    hot = members.where(F.col("n") > bucket).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = hot.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
    most = by_root.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), (F.sum("k") - F.max("k")).alias("minor")).where("roots > 1")
    hot = cut(hot.join(most.select("band", "most", "minor"), "band"))
    if hot.limit(1).count():
        minor_parts = F.expr(f"cast((minor + {bucket - 1}) div {bucket} as int)")
        parts = F.expr(f"cast((n + {bucket - 1}) div {bucket} as int)")
        held = hot.withColumn("i", F.explode(F.sequence(F.lit(0), minor_parts - 1))).select("band", "node", "root", "i", F.col("part").alias("j"), F.lit(False).alias("asks"))
        asks = hot.where("root <> most").withColumn("i", F.pmod(F.xxhash64("node", F.lit(5)), minor_parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), parts - 1))).select("band", "node", "root", "i", "j", F.lit(True).alias("asks"))
        both = held.unionByName(asks).groupBy(F.xxhash64("band", "i", "j").alias("bucket"), "node").agg(F.first("root").alias("root"), F.max("asks").alias("asks"))
        more = _edges_of(both.join(sigs, "node").select("bucket", "node", "sig", "root", "asks"), docs, threshold)
        again = components(edges.unionByName(more))
        drop_cut(roots, more)
        roots = again
    drop_cut(members, hot, edges)
    return roots


def _roots(pairs: list[tuple]) -> dict:
    up: dict = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: list[tuple] = []
    for b in batches:
        pairs += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
    got = _roots(pairs)
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], names=["node", "root"])


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of each node of an edge, root the lowest node of its component. Written."""
    # partitions unite their own edges first, so rounds are few
    star = cut(pairs.mapInArrow(_unite, "node binary, root binary").where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = sign(star)
    while True:
        both = star.select("a", "b").union(star.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        few = large.withColumnRenamed("b", "u").join(down, "u")
        nxt = few.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("u")).otherwise(F.col("a")).alias("b")).where("a <> b").distinct()
        nxt = cut(nxt)
        drop_cut(star)
        star, now = nxt, sign(nxt)
        if now == was:
            break
        was = now
    out = cut(star.select(F.col("b").alias("node"), F.col("a").alias("root")).union(star.select("a", "a").distinct()))
    drop_cut(star)
    return out


def _worded(text: Column) -> Column:
    """Whether the text has a word; as words() sees it, space is what is not above U+0020."""
    return F.coalesce(F.length(F.btrim(text, F.lit("".join(map(chr, range(33)))))), F.lit(0)) > 0


def _groups(docs: DataFrame, threshold: float) -> DataFrame:
    """(digest, group_id, rep_digest, rep_id, n_docs) of each text with words that has company:
    similar texts, or its own copies. rep: the document that stays. Written."""
    each = sketches(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id")).alias("low")
    nodes = cut(each.groupBy("digest").agg(first, F.count_distinct("doc_id").alias("ids"), F.max(F.col("doc_id").isNull().cast("int")).alias("nul"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    roots = roots_of(nodes, docs, threshold)
    named = nodes.select("digest", "low", (F.col("ids") + F.col("nul")).alias("ids")).join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.withColumn("root", F.coalesce("root", "digest"))
    by = named.groupBy("root").agg(F.min(F.struct("low", "digest")).alias("rep"), F.sum("ids").alias("group_size")).where("group_size > 1")
    out = cut(named.join(by, "root").select("digest", F.col("rep.low.doc_id").alias("group_id"), F.col("rep.digest").alias("rep_digest"), "group_size"))
    drop_cut(nodes, roots)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, group_size, is_kept) of each document: group_id is the lowest id of
    its near-duplicate group, and that document is the one to keep."""
    groups = _groups(docs, threshold)
    d = project(docs, "doc_id", "text")
    rows = d.select("doc_id", F.unhex(F.md5("text")).alias("digest"), _worded(F.col("text")).alias("worded"))
    once = rows.where("worded").select("doc_id", "digest").distinct()
    lone = rows.where("not worded").select("doc_id", F.lit(None).cast("binary").alias("digest"))
    every = once.unionByName(lone).join(groups, "digest", "left")
    kept = F.col("group_size").isNull() | (F.col("digest") == F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("group_id"))
    return every.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), kept.alias("is_kept"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one of each group. Rows without words stay.

    Of rows that repeat id and text the first by the hash of the whole row stays.
    """
    groups = _groups(docs, threshold)
    plain, names = with_columns_apart(docs)
    text_at, id_at = position(docs, "text"), position(docs, "doc_id")
    if text_at is None:
        return docs
    text = F.col(f"c{text_at}").cast("string")
    ident: Column = F.lit(None).cast("bigint") if id_at is None else F.col(f"c{id_at}").cast("bigint")
    whole = F.xxhash64(*plain.columns)
    # rows without words are spread by the hash of the row, and match no text
    digest = F.when(_worded(text), F.unhex(F.md5(text))).otherwise(F.unhex(F.hex(whole)))
    rows = plain.withColumn("digest", digest).withColumn("id", ident)
    company = groups.select("digest", "group_id", "rep_digest")
    losers = company.where("digest <> rep_digest").select("digest")
    winners = company.where("digest = rep_digest").select("digest", "group_id", F.lit(True).alias("won"))
    # one shuffle of the text, by digest, serves both joins and the ranking of repeated rows
    rows = rows.join(losers, "digest", "left_anti").join(winners, "digest", "left")
    rows = rows.where(F.col("won").isNull() | F.col("id").eqNullSafe(F.col("group_id")))
    again = Window.partitionBy("digest").orderBy(F.col("id").asc_nulls_last(), whole)
    rows = rows.withColumn("nth", F.row_number().over(again)).where((F.col("nth") == 1) | ~_worded(text))
    return rows.select(*plain.columns).toDF(*names)
