"""Finding every window of fixed length that occurs twice in a corpus: the parts that byte and word forms share.

Each window (of `width` symbols) has an anchor: the start of its smallest k-gram by hash, the last among equals.
Equal windows have equal anchors, so windows need only be compared within groups of one anchor k-gram. Neighbour
windows of one anchor make a run; its slice is the text that they cover. The steps:

1. scan: the runs of every document, as hashes of the k-gram and of the slice, and a position;
2. runs whose k-gram occurs once can hold no repeat and go;
3. equal slices become one with a weight, the number of its copies;
4. one copy of each slice is cut from its document and sent to its group's task, where an index (the caller's) says
   which of the windows occur twice, copies included;
5. what is repeated goes back to all copies by (k-gram, slice), and per document to spans.

A group whose slices take more than GROUP_BYTES, as those of a very frequent passage do, is divided before it is
indexed: its slices become the documents of the same steps, with a longer anchor. Windows of one anchor are parted
by the anchor's place in them, `level` places together, and what all windows of such a part have in common, all but
level - 1 of their symbols, is the new anchor. Equal windows have equal places, so this again loses nothing; what
is alone with its new anchor goes, and at the last level, of one place, the anchor is the window itself and a group
holds one slice. Groups of any size are thus settled by the index, in tasks of bounded memory.

Nothing is capped or sampled. Each step's result is written to the shared folder, so lost executors cost a step
at most. Rows are told apart by key and a 64-bit hash of the text; equal rows share their result and repeat each other.
Texts are read in stretches of STRETCH symbols, so positions stay within their bits however long a text is.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import drop_path, fresh_path, keep
from lodestone.llm.text import gather, give_back, mixed, pieces, prefix_hash, span_hash, window_hash

#: Bytes of the distinct slices of a group beyond which it is divided, and of slices that are indexed together.
GROUP_BYTES, BATCH_BYTES = 1 << 19, 1 << 20
#: Windows whose anchors are found together.
STRETCH = 1 << 20
PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Form:
    """What tells byte and word forms apart.

    width and gram in symbols of type kind; symbols(bytes, offsets) gives the symbols and their row offsets;
    index(slices, weights) which windows occur twice; levels are the places that longer anchors take together, 1 at last.
    """

    width: int
    gram: int
    kind: np.dtype
    levels: tuple[int, ...]
    symbols: Callable
    index: Callable

    def stored(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of slices."""
        return np.frombuffer(data.tobytes(), self.kind), at // self.kind.itemsize


def anchors(p: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The anchor of every window of a run of symbols with prefix hashes p."""
    starts = np.arange(len(p) - gram, dtype=np.uint64)
    low = (window_hash(p, gram) & ~PLACE) | (PLACE - starts)
    many, span = width - gram + 1, 1
    while 2 * span <= many:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    count = len(p) - width
    low = np.minimum(low[:count], low[many - span : many - span + count])
    return (PLACE - (low & PLACE)).astype(np.int64)


def runs(p: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, first window, number of windows and anchor of every run, for rows of symbols with prefix hashes p and offsets at."""
    size = np.maximum(np.diff(at) - width + 1, 0)  # windows never cross rows
    first = gather(at[:-1], size)
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    anchor = anchors(p, width, gram)[first]
    row = np.repeat(np.arange(len(size)), size)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    return row[head], first[head], np.diff(np.r_[head, len(first)]), anchor[head]


def stretches(symbols: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, symbols, offsets) of overlapping stretches: each window of the rows lies in one of them."""
    for a in range(0, max(1, len(symbols) - width + 1), STRETCH):
        own = symbols[a : a + STRETCH + width - 1]
        yield a, own, np.clip(at - a, 0, len(own))


def scan(docs: DataFrame, form: Form) -> DataFrame:
    """a, b, h, d, pos of every run; pos is the first window's place * 1024 + the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, _, data, at in pieces(x.column(2)):
                symbols, at = form.symbols(data, at)
                for base, own, own_at in stretches(symbols, at, form.width):
                    p = prefix_hash(own)
                    row, start, n, anchor = runs(p, own_at, form.width, form.gram)
                    if len(row):
                        h, d = span_hash(p, anchor, anchor + form.gram), span_hash(p, start, start + n + form.width - 1)
                        where, pos = pa.array(row + first), (base + start - at[row]) * 1024 + n
                        yield pa.RecordBatch.from_arrays([x.column(0).take(where), x.column(1).take(where), pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), pa.array(pos)], ["a", "b", "h", "d", "pos"])
        give_back()

    return docs.select("a", "b", "text").mapInArrow(run, f"a {docs.schema['a'].dataType.simpleString()}, b long, h long, d long, pos long")


def divided(p: np.ndarray, at: np.ndarray, width: int, gram: int, level: int) -> tuple[np.ndarray, ...]:
    """For slices, each the windows of one anchor: slice, first window, number of windows, part and start of the longer anchor of every run of `level` places."""
    row, first, n, anchor = runs(p, at, width, gram)
    window = gather(first, n)
    row, anchor = np.repeat(row, n), np.repeat(anchor, n)
    part = (anchor - window) // level
    head = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
    return row[head], window[head], np.diff(np.r_[head, len(window)]), part[head], anchor[head] - level * part[head]


def scan_slices(slices: DataFrame, form: Form, level: int) -> DataFrame:
    """a, b, h, d, c, pos of every run of `level` places of slices (a, b, c, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for first, _, data, at in pieces(x.column(3)):
                symbols, at = form.stored(data, at)
                p = prefix_hash(symbols)
                row, start, n, part, core = divided(p, at, form.width, form.gram, level)
                group = x.column(0).to_numpy()[row + first].view(np.uint64)
                h = mixed(span_hash(p, core, core + form.width - level + 1) ^ mixed(group + part.astype(np.uint64)))
                d = span_hash(p, start, start + n + form.width - 1)
                where, pos = pa.array(row + first), (start - at[row]) * 1024 + n
                yield pa.RecordBatch.from_arrays([x.column(0).take(where), x.column(1).take(where), pa.array(h.view(np.int64)), pa.array(d.view(np.int64)), x.column(2).take(where), pa.array(pos)], ["a", "b", "h", "d", "c", "pos"])
        give_back()

    return slices.select("a", "b", "c", "text").mapInArrow(run, "a long, b long, h long, d long, c long, pos long")


def place(pos):
    return F.shiftright(pos, 10)


def many(pos):
    return pos.bitwiseAND(1023)


def cut(docs: DataFrame, wanted: DataFrame, symbols: Callable, width: int) -> DataFrame:
    """h, d, c, large and the slice (the bytes of its symbols) of every wanted row (those and a, b, pos)."""
    lists = wanted.groupBy("a", "b").agg(F.collect_list(F.struct("h", "d", "c", "large", "pos")).alias("runs"))
    joined = docs.join(lists.withColumnsRenamed({"a": "_a", "b": "_b"}), F.col("a").eqNullSafe(F.col("_a")) & (F.col("b") == F.col("_b"))).select("text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists = x.column(1)
            inner = lists.flatten()
            of = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            where = inner.field(4).to_numpy()
            for first, stop, data, at in pieces(x.column(0)):
                held, at = symbols(data, at)
                own = np.arange(of[first], of[stop])
                start = np.repeat(at[:-1], np.diff(of[first : stop + 1])) + (where[own] >> 10)
                size = (where[own] & 1023) + width - 1
                # slices overlap: they are handed on in parts of about a piece's size
                for part in np.split(np.arange(len(own)), np.flatnonzero(np.diff(np.cumsum(size) * held.itemsize >> 20)) + 1):
                    if len(part):
                        body = held[gather(start[part], size[part])]
                        ends = np.r_[0, np.cumsum(size[part])] * held.itemsize
                        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
                        yield pa.RecordBatch.from_arrays([*(inner.field(k).slice(own[part[0]], len(part)) for k in range(4)), binary.cast(pa.binary())], ["h", "d", "c", "large", "body"])
        give_back()

    return joined.mapInArrow(run, "h long, d long, c long, large boolean, body binary")


def batches_of_groups(table: pa.Table, ended: bool) -> Iterator[tuple[int, int]]:
    """Row ranges of whole groups of one h with BATCH_BYTES at most, or of one larger group; the last rows stay unless the input has ended."""
    h = table.column("h").to_numpy()
    size = np.r_[0, np.cumsum(pc.binary_length(table.column("body")).to_numpy().astype(np.int64))]
    edge = np.r_[np.flatnonzero(np.r_[True, h[1:] != h[:-1]]), len(h)]
    if not ended:
        edge = edge[:-1]
    k = 0
    while k + 1 < len(edge):
        to = max(k + 1, int(np.searchsorted(size[edge], size[edge[k]] + BATCH_BYTES, "right")) - 1)
        if to == len(edge) - 1 and not ended and size[edge[to]] - size[edge[k]] < BATCH_BYTES // 2:
            return
        yield int(edge[k]), int(edge[to])
        k = to


def settle(slices: DataFrame, form: Form) -> DataFrame:
    """h, d and the first and last windows of the repeated stretches, by the index over each batch of groups."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        marks = np.stack([rows.column(c).to_numpy() for c in ("h", "d")])
        rows = rows.filter(pa.array(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)])).combine_chunks()  # equal rows of the input give a slice each
        flags, at = form.index(rows.column("body").combine_chunks(), rows.column("c").to_numpy())
        return covers(rows.column("h"), rows.column("d"), flags, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for x in batches:
            held.append(x)
            if sum(b.nbytes for b in held) >= BATCH_BYTES:
                rows, stop = pa.Table.from_batches(held), 0
                for start, stop in batches_of_groups(rows, False):
                    yield done(rows.slice(start, stop - start))
                held = rows.slice(stop).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            for start, stop in batches_of_groups(rows, True):
                yield done(rows.slice(start, stop - start))
        give_back()

    return slices.select("h", "d", "c", "body").repartition("h").sortWithinPartitions("h", "d").mapInArrow(run, "h long, d long, cover array<struct<f:bigint,t:bigint>>")


def covers(h, d, flags: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """A row for each slice with a repeated window: the stretches of true flags between its offsets."""
    head = np.zeros(len(flags) + 1, bool)
    head[at] = True
    f = np.flatnonzero(flags & ~(np.r_[False, flags[:-1]] & ~head[:-1]))
    t = np.flatnonzero(flags & ~(np.r_[flags[1:], False] & ~head[1:]))
    row = np.searchsorted(at, f, "right") - 1
    n = np.bincount(row, minlength=len(at) - 1)
    hit = np.flatnonzero(n)
    inner = pa.StructArray.from_arrays([pa.array(f - at[row]), pa.array(t - at[row])], ["f", "t"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[hit])].astype(np.int32)), inner)
    where = pa.array(hit)
    one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.RecordBatch.from_arrays([one(h).take(where), one(d).take(where), lists], ["h", "d", "cover"])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def identified(docs: DataFrame, text: str, key: str) -> DataFrame:
    """a (the key), b (a hash of the text) and text of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("a"), F.xxhash64(body).alias("b"), body.alias("text"))


def repeated_windows(docs: DataFrame, scanned: DataFrame, form: Form, symbols: Callable, levels: tuple[int, ...]) -> DataFrame:
    """a, b and cover, the first and last windows of the repeated stretches (not merged), of each document with any.

    docs: a, b, text; scanned: their runs, with the weight c of each.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "runs")
    scanned.write.parquet(path)
    every = spark.read.schema(scanned.schema).parquet(path)
    every = every if "c" in every.columns else every.withColumn("c", F.lit(1).cast("long"))
    often = keep(every.groupBy("h").agg(F.sum("c").alias("n")).filter("n > 1").select("h"))  # written first: a join of two plain exchanges can split a hot key
    found = keep(every.join(often, "h", "left_semi"))
    drop_path(spark, path)
    del often, every
    release(spark)
    slices = keep(found.groupBy("h", "d").agg(F.sum("c").alias("c"), F.min(F.struct("a", "b", "pos")).alias("at")))
    release(spark)
    size = (many(F.col("at.pos")) + form.width - 1) * form.kind.itemsize
    large = keep(slices.groupBy("h").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > GROUP_BYTES).select("h", F.lit(True).alias("large")))
    any_large = bool(levels) and not large.isEmpty()
    told = slices.join(large, "h", "left") if any_large else slices.withColumn("large", F.lit(None).cast("boolean"))
    bodies = cut(docs, told.select("h", "d", "c", F.coalesce("large", F.lit(False)).alias("large"), "at.a", "at.b", "at.pos"), symbols, form.width)
    if any_large:
        at = fresh_path(spark, "slices")
        bodies.write.parquet(at)  # documents move once for small and large groups
        bodies = spark.read.schema(bodies.schema).parquet(at)
        release(spark)
    cover = keep(settle(bodies.filter(~F.col("large")), form))
    if any_large:
        parts = bodies.filter("large").select(F.col("h").alias("a"), F.col("d").alias("b"), "c", F.col("body").alias("text"))
        more = repeated_windows(parts, scan_slices(parts, form, levels[0]), form, form.stored, levels[1:])
        cover = cover.unionByName(more.withColumnsRenamed({"a": "h", "b": "d"}))
        drop_path(spark, at)
    del bodies, slices, told, large
    release(spark)
    start = place(F.col("pos"))
    moved = F.transform("cover", lambda x: F.struct((start + x["f"]).alias("f"), (start + x["t"]).alias("t")))
    out = found.join(cover, ["h", "d"]).select("a", "b", moved.alias("s"))
    out = keep(out.groupBy("a", "b").agg(F.flatten(F.collect_set("s")).alias("cover")))
    release(spark)
    return out


def repeated_spans(docs: DataFrame, form: Form) -> DataFrame:
    """a, b and spans (first and end of the symbols to go, not merged) of each document with a repeated window. docs: as identified() gives them."""
    found = repeated_windows(docs, scan(docs, form), form, form.symbols, form.levels)
    return found.select("a", "b", F.transform("cover", lambda x: F.struct(x["f"].alias("f"), (x["t"] + form.width).alias("t"))).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (a, b, text and others) with the spans of each; null where nothing repeats."""
    s = spans.withColumnsRenamed({"a": "_a", "b": "_b"})
    return docs.join(s, F.col("a").eqNullSafe(F.col("_a")) & (F.col("b") == F.col("_b")), "left").drop("_a", "_b")


def marked(lists: pa.Array, rows: slice, at: np.ndarray) -> np.ndarray:
    """True for the symbols that the rows' spans cover; at: the rows' symbol offsets."""
    own = lists.slice(rows.start, rows.stop - rows.start)
    n = own.value_lengths().fill_null(0).to_numpy()
    inner = own.flatten()
    base = np.repeat(at[:-1], n)
    size = int(at[-1]) + 1
    step = np.bincount(base + inner.field(0).to_numpy(), minlength=size) - np.bincount(base + inner.field(1).to_numpy(), minlength=size)
    return np.cumsum(step[:-1]) > 0
