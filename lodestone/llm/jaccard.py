"""Similarity join on word shingles, with Bayesian pruning of candidates.

Texts are sets of their shingles of five words; two texts are linked if the Jaccard similarity of their sets is
0.8 or more. Equal texts are one node, so copies are never compared. Each node has VALUES MinHash values; nodes
that agree in a band of ROWS values meet in a bucket (a pair of similarity 0.8 misses all bands with a chance of
3e-6). In a bucket, a pair is looked at if no earlier band has brought it together: its MinHash values are compared
STEP at a time, and it is dropped as soon as the posterior probability of reaching the threshold, given the matches
so far, falls below TOLERANCE. The pairs that remain are verified on their whole shingle sets.

Buckets of any size are dealt out as pairs of blocks, bounded in nodes and in bytes of shingles; pairs are looked at in
chunks, and tasks return counts and components, not pairs, so a large group of near copies costs comparisons but no
rows. Nothing is capped.

Defined results: words are the runs of characters other than blanks, unchanged. A text of one to four words has
one shingle, all of it. A text without words (null, empty, blank) has no links to other texts. Rows with equal
text are of one class, whatever their ids; a null id takes part and is the smallest of a class only if all of its
ids are null. Rows that are equal in id and text are one document to one_of_each, which keeps one row of them. Texts
are told apart by a 64-bit hash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.repeats import release
from lodestone.llm.shared import each_once, keep
from lodestone.llm.text import gather, give_back, mixed, pieces, prefix_hash, span_hash, word_hashes, words

SHINGLE, TENTHS = 5, 8
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-6
#: Nodes of a bucket, and bytes of their shingles in the mean, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Cells of the matrix of two blocks that are looked at together.
CELLS = 1 << 20


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, and the rows' offsets."""
    starts, ends, first = words(data, at)
    p = prefix_hash(word_hashes(data, starts, ends))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    begin = gather(first[:-1], count)
    stop = np.minimum(begin + SHINGLE, np.repeat(first[1:], count))
    return span_hash(p, begin, stop), np.r_[0, np.cumsum(count)]


@cache
def functions() -> tuple[np.ndarray, np.ndarray]:
    r = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64))
    return (r[:VALUES] >> np.uint64(32)).astype(np.uint32), (r[VALUES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each function over each row's shingles; rows must not be empty."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, VALUES), np.uint16)
    for k, (c, a) in enumerate(zip(*functions())):
        low = np.minimum.reduceat((x ^ c) * a, at[:-1])
        out[:, k] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


@cache
def needed() -> np.ndarray:
    """The least matches after each STEP values for which the posterior, from a flat prior, that the similarity is 0.8 or more is TOLERANCE at least."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            with np.errstate(divide="ignore"):
                log = m * np.log(s) + (n - m) * np.log1p(-s)
            w = np.exp(log - log.max())
            if w[s >= TENTHS / 10].sum() / w.sum() >= TOLERANCE:
                out.append(m)
                break
    return np.array(out)


def candidates(sig: np.ndarray, band: int, left: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the bucket's rows that no earlier band has and that the values do not rule out, in chunks.

    left: 0 for all pairs of the rows; else pairs of one of the first `left` rows with one of the others.
    """
    keys = np.ascontiguousarray(sig).view(np.uint64)  # a band's four values are one number
    n = len(sig)
    wide = max(1, CELLS // max(1, n - left))
    for a in range(0, left or n, wide):
        b = min(a + wide, left or n)
        ok = np.ones((b - a, n - left), bool) if left else np.arange(n) > np.arange(a, b)[:, None]
        for k in range(band):
            ok &= keys[a:b, k, None] != keys[None, left:, k]
        i, j = (x.astype(np.int32) for x in np.nonzero(ok))
        i, j = i + a, j + left
        matches = np.zeros(len(i), np.uint8)
        for step, least in enumerate(needed()):
            for k in range(step * STEP, (step + 1) * STEP):
                column = np.ascontiguousarray(sig[:, k])
                matches += column[i] == column[j]
            stay = matches >= least
            i, j, matches = i[stay], j[stay], matches[stay]
        if len(i):
            yield i, j


class Common:
    """Sizes of the common parts of pairs of sets; left as in candidates().

    The first pairs are looked up one by one. Where many are asked for, all are counted together: shingles that many
    sets have by a product of 0/1 matrices, the others by their own pairs of sets.
    """

    def __init__(self, sets: list[np.ndarray], left: int):
        self.sets, self.left, self.asked, self.total = sets, left, 0, None

    def sizes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.asked += len(i)
        if self.total is None and self.asked <= 4 * len(self.sets):
            return np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
        if self.total is None:
            self.total = self._count()
        return self.total[i, j - self.left].astype(np.int64)

    def _count(self) -> np.ndarray:
        m, left = len(self.sets), self.left
        owner = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in self.sets])
        column = np.unique(np.concatenate(self.sets), return_inverse=True)[1].astype(np.int32)
        often = np.bincount(column)
        heavy = often > max(8, m // 16)
        total = np.zeros((left or m, m - left), np.float32)
        place = np.where(heavy, np.cumsum(heavy) - 1, -1)[column]
        for a in range(0, int(heavy.sum()), 1024):
            own = (place >= a) & (place < a + 1024)
            dense = np.zeros((m, 1024), np.float32)
            dense[owner[own], place[own] - a] = 1
            total += dense[: left or m] @ dense[left:].T
        light = ~heavy[column] & (often[column] > 1)
        column, owner = column[light], owner[light]
        order = np.argsort(column, kind="stable")
        owner, times = owner[order], often[column[order]]
        for n in np.unique(times):
            group = owner[times == n].reshape(-1, n)
            step = max(1, CELLS // (n * n))
            for a in range(0, len(group), step):
                x, y = np.broadcast_arrays(group[a : a + step, :, None], group[a : a + step, None, :])
                across = (x < left) & (y >= left) if left else x < y
                np.add.at(total, (x[across], y[across] - left), 1)
        return total


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def signatures(docs: DataFrame) -> DataFrame:
    """node, the number of its shingles and sig, a row for each text with words. docs: id, node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, at in pieces(b.column(1)):
                h, of = shingles(data, at)
                some = np.flatnonzero(np.diff(of))
                if len(some):
                    sig = minhashes(h, np.r_[of[some], len(h)])
                    body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), len(sig), [None, pa.py_buffer(sig.tobytes())])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some + first)), pa.array(np.diff(of)[some]), body.cast(pa.binary())], ["node", "size", "sig"])
        give_back()

    return docs.select("node", "text").mapInArrow(run, "node long, size long, sig binary").groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node and its distinct shingles as bytes. docs: node, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, at in pieces(b.column(1)):
                h, of = shingles(data, at)
                sets = [np.unique(h[of[k] : of[k + 1]]).tobytes() for k in range(stop - first)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, stop - first), pa.array(sets, pa.binary())], ["node", "shingles"])
        give_back()

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def buckets(sigs: DataFrame) -> DataFrame:
    """bucket, band, one, two, node, sig: the rows of each pair of blocks (one <= two) of each bucket with two nodes or more."""
    hex_band = lambda k: F.xxhash64(F.lit(k), F.substring("sig", 2 * ROWS * k + 1, 2 * ROWS))
    keys = F.array(*[F.struct(F.lit(k).alias("band"), hex_band(k).alias("bucket")) for k in range(BANDS)])
    spread = sigs.select("node", "size", F.explode(keys).alias("b")).select("node", "size", "b.band", "b.bucket")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    full = spread.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("size") * 8).alias("bytes")).filter("m > 1").select("bucket", "band", F.least(blocks, F.col("m").cast("int")).alias("blocks"))
    members = spread.drop("size").join(full, ["bucket", "band"]).join(sigs.drop("size"), "node")
    own = F.pmod(F.hash("node"), F.col("blocks"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("bucket", "band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), F.col("own").alias("block"), "node", "sig")


def by_bucket(rows: DataFrame, work, schema: str) -> DataFrame:
    """work(band, left, rows) for the rows of each pair of blocks, which come sorted, those of the first block in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            table = pa.Table.from_batches(held)
            marks = np.stack([table.column(c).to_numpy() for c in ("bucket", "one", "two")])
            edge = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)])
            yield from each(table.slice(0, edge[-1]), edge)
            held = table.slice(edge[-1]).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from each(table, np.array([0, table.num_rows]))
        give_back()

    def each(table: pa.Table, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        band, one, two, block = (table.column(c).to_numpy() for c in ("band", "one", "two", "block"))
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            left = int((block[a:b] == one[a]).sum()) if one[a] != two[a] else 0
            if b - a > 1 and left < b - a and (left or one[a] == two[a]):
                out.extend(work(int(band[a]), left, table.slice(a, b - a)))
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    spread = rows.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", F.col("block") != F.col("one"), "node")
    return spread.mapInArrow(run, schema)


def signature_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)


def promising(band: int, left: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that are in a pair which the values leave."""
    hit = np.zeros(table.num_rows, bool)
    for i, j in candidates(signature_rows(table), band, left):
        hit[i] = hit[j] = True
    if hit.any():
        yield from table.filter(pa.array(hit)).combine_chunks().to_batches()


def verified(band: int, left: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """node, root and links of the rows that are in a verified pair."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    size, n = np.array([len(s) for s in sets]), len(sets)
    common, links, root = Common(sets, left), np.zeros(n, np.int64), np.arange(n)
    for i, j in candidates(signature_rows(table), band, left):
        both = common.sizes(i, j)
        same = 10 * both >= TENTHS * (size[i] + size[j] - both)
        i, j = i[same], j[same]
        links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        root = components(n, np.r_[i, np.arange(n)], np.r_[j, root])
    hit = np.flatnonzero(links)
    if len(hit):
        node = table.column("node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[root[hit]]), pa.array(links[hit])], ["node", "root", "links"])


def connected(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component. edges: node, root. A round passes labels over all edges and follows each label once."""
    both = edges.select("node", "root").distinct()
    both = keep(both.union(both.select(F.col("root"), F.col("node"))).distinct())
    labels = keep(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "root"}), "root").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        hop = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = keep(step.join(hop, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        done = moved.filter("new <> label").isEmpty()
        labels = moved.select("node", F.col("new").alias("label"))
        if done:
            return labels


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, node (a hash of the text) and text of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(body).alias("node"), body.alias("text"))


def classified(rows: DataFrame) -> DataFrame:
    """node, first (its smallest id), class_id, chosen (whether it stands for its class), n_links, n_copies of every text. rows: as identified() gives them."""
    spark = rows.sparkSession
    nodes = keep(rows.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_copies")))
    sigs = keep(signatures(rows))
    release(spark)
    schema = "bucket long, band int, one int, two int, block int, node long, sig binary"
    left = keep(by_bucket(buckets(sigs), promising, schema))
    release(spark)
    needed_nodes = left.select("node").distinct().join(nodes, "node").select(F.col("node").alias("_node"), F.col("first").alias("_first"))
    one_each = rows.join(needed_nodes, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_first"))).select("node", "text")
    sets = keep(shingle_sets(one_each).groupBy("node").agg(F.first("shingles").alias("shingles")))
    found = keep(by_bucket(left.join(sets, "node").select(*left.columns, "shingles"), verified, "node long, root long, links long"))
    release(spark)
    labels = connected(found)
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = labels.join(links, "node").join(nodes.select("node", "first"), "node")
    best = F.min(F.struct(F.col("first").isNull(), "first", "node"))
    classes = linked.groupBy("label").agg(best.alias("best")).select("label", F.col("best.first").alias("class_id"), F.col("best.node").alias("stands"))
    in_class = linked.join(classes, "label").select("node", "class_id", "stands", "n_links")
    of = nodes.join(in_class, "node", "left")
    alone = F.col("stands").isNull()
    return of.select("node", "first", F.when(alone, F.col("first")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("stands") == F.col("node"))).alias("chosen"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")


def jaccard_classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id (the smallest id of all that links connect), n_links (other texts linked to this one) and n_copies (rows with this text) for every row."""
    rows = identified(docs, text, key)
    return rows.select("id", "node").join(classified(rows), "node").select(F.col("id").alias(key), "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each class the row with the smallest id, with all columns; of rows that are equal in id and text, one."""
    chosen = classified(identified(docs, text, key)).filter("chosen").select(F.col("first").alias("_first"), F.col("node").alias("_node"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_n"))
    kept = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_n") == F.col("_node")), "left_semi")
    return each_once(kept, rows, ["_id", "_n"]).select("_row.*")
