"""Removing long repeated byte strings, by merged Burrows-Wheeler transforms.

repeats.py brings together the slices whose windows can be equal. Here, a batch of slices is cut into shards;
each shard gets its suffix order and Burrows-Wheeler transform, and the transforms of all shards are merged by
refining their interleave: the interleave that is right for the first k symbols of the suffixes, read through
the transforms and distributed stably by symbol, is right for the first k + 1. Suffixes of different shards are
never compared or sorted again. Where neighbours part after k symbols, their common prefix is k, so after as
many rounds as a window has symbols the blocks that have not parted are the repeated intervals. A slice that stands
for several copies weighs as many.

A symbol is a block of STRIDE bytes, named by its 64-bit hash, and a slice is STRIDE strings, one for each
phase, so a window of 200 bytes is five symbols wherever it starts.

Defined results: a null text is empty and keeps nothing; texts under 200 bytes are kept whole; equal rows remove
each other wherever they are 200 bytes long; an empty table gives an empty result; extra columns are ignored,
or passed through by drop_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.repeats import Form, identified, marked, repeated_spans, with_spans
from lodestone.llm.text import flat, gather, give_back, pieces, prefix_hash, window_hash

WIDTH, GRAM, STRIDE = 200, 64, 40
#: Bytes of slices in a shard.
SHARD_BYTES = 1 << 18


def ordered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the tuples of keys, none negative, and for each in that order whether it differs from the one before.

    Keys and position are packed into one number each, which is much faster to sort than positions by their keys. Where they
    take over 64 bits, the last bits of the key are left out; if different tuples agree in the others, positions are sorted.
    """
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    wide, low = [int(k.max()).bit_length() for k in keys], (n - 1).bit_length()
    if sum(wide) <= 64:
        whole = keys[0].astype(np.uint64)
        for k, w in zip(keys[1:], wide[1:]):
            whole = whole << np.uint64(w) | k.astype(np.uint64)
        lost = max(sum(wide) + low - 64, 0)
        packed = whole >> np.uint64(lost) << np.uint64(low) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order = (packed & np.uint64((1 << low) - 1)).view(np.int64)
        packed >>= np.uint64(low)
        new = changes(packed)
        if not lost or (changes(whole[order]) == new).all():
            return order, new
    order = np.lexsort(keys[::-1])
    return order, np.logical_or.reduce([changes(k[order]) for k in keys])


def changes(x: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the tuples of keys, equal for equal tuples."""
    order, new = ordered(*keys)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


class Transform:
    """Suffix order and Burrows-Wheeler transform of a shard of strings over the symbols 1, 2, ...; 0 ends each string.

    Each run of equal entries of string holds step strings, one for each phase: position i goes on at i + step, if that is
    in the run. Rows are the ends of all strings, in the order of their first positions, and then the suffixes in order,
    ties by that of their strings.
    """

    def __init__(self, symbols: np.ndarray, string: np.ndarray, step: int):
        n = len(symbols)
        edge = np.flatnonzero(changes(string))
        run = np.diff(np.r_[edge, n])
        heads = gather(edge, np.minimum(run, step))
        size = -(-(np.repeat(edge + run, np.minimum(run, step)) - heads) // step)
        stop = np.cumsum(size)
        place = np.repeat(heads - step * (stop - size), size) + step * np.arange(n)  # string by string, so ties are by position
        own = symbols[place].astype(np.int64)
        left = np.repeat(stop, size) - np.arange(n)
        rank, order, reach = own, np.zeros(0, np.int64), 1
        longest = int(size.max()) if n else 0
        while reach < longest or len(order) < n:  # prefix doubling inside the shard
            after = np.zeros(n, np.int64)
            after[:-reach] = np.where(left[:-reach] > reach, rank[reach:], 0)
            order, new = ordered(rank, after)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            reach *= 2
        self.strings = len(heads)
        self.suffix = np.r_[np.full(len(heads), -1), place[order]]
        before = np.zeros(n, np.int64)
        before[1:] = own[:-1]
        before[stop - size] = 0
        self.bwt = np.r_[own[stop - 1], before[order]]


def slots(z: np.ndarray) -> np.ndarray:
    """The slots of an interleave by shard: the k-th slot of a shard holds its k-th row."""
    return np.argsort(z, kind="stable")  # of small numbers: by digits, in linear time


def merge(shards: list[Transform], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' rows after `rounds` refinements, and the block of each row: rows of a block share their first `rounds` symbols."""
    number = np.arange(len(shards), dtype=np.min_scalar_type(len(shards)))
    ends = np.repeat(number, [s.strings for s in shards])
    z = np.concatenate([ends, np.repeat(number, [len(s.bwt) - s.strings for s in shards])])
    bwt = np.concatenate([s.bwt for s in shards])
    block = np.zeros(len(z), np.int64)
    for _ in range(rounds):
        symbol = np.empty(len(z), np.int64)
        symbol[slots(z)] = bwt
        order, new = (x[len(ends) :] for x in ordered(symbol))  # string starts lead to no row
        z[len(ends) :] = z[order]
        block[len(ends) :] = np.cumsum(new | changes(block[order]))
        block[: len(ends)] = 0
    return z, block


def index(body: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the slices, each there `weight` times, occur twice, and the windows' offsets by slice."""
    data, at = flat(body)
    size = np.diff(at)
    count = size - WIDTH + 1
    out_at = np.r_[0, np.cumsum(count)]
    if len(data) < STRIDE:
        return np.zeros(int(out_at[-1]), bool), out_at
    spots = size - STRIDE + 1
    start = gather(at[:-1], spots)
    names = dense(window_hash(prefix_hash(data), STRIDE)[start]) + 1
    of = np.repeat(np.arange(len(size)), spots)
    cuts = np.unique(np.r_[0, np.searchsorted(at, np.arange(SHARD_BYTES, len(data), SHARD_BYTES)), len(size)])
    spot_at = np.r_[0, np.cumsum(spots)]
    shards, base = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = slice(spot_at[a], spot_at[b])
        shards.append(Transform(names[own], of[own] - a, STRIDE))
        base.append(spot_at[a])
    z, block = merge(shards, WIDTH // STRIDE)
    suffix = np.concatenate([np.where(s.suffix >= 0, s.suffix + b, -1) for s, b in zip(shards, base)])
    spot = np.empty(len(z), np.int64)
    spot[slots(z)] = suffix
    offset = np.arange(len(start)) - spot_at[of]
    whole = offset < count[of]  # a window of full width starts here
    row = np.flatnonzero(spot >= 0)
    row = row[whole[spot[row]]]
    times = np.bincount(block[row], weights=weight[of[spot[row]]])
    flags = np.zeros(int(out_at[-1]), bool)
    hit = spot[row[times[block[row]] > 1]]
    flags[out_at[of[hit]] + offset[hit]] = True
    return flags, out_at


FORM = Form(WIDTH, GRAM, np.dtype(np.uint8), (16, 4, 1), lambda data, at: (data, at), index)


def _spans(docs: DataFrame, text: str, key: str) -> DataFrame:
    rows = identified(docs, text, key)
    return with_spans(rows, repeated_spans(rows, FORM)).select("a", "text", "spans")


def repeat_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], []]
            for first, stop, data, at in pieces(b.column(1)):
                gone = marked(b.column(2), slice(first, stop), at)
                edge = gone & ~np.r_[False, gone[:-1]][: len(gone)]
                edge[at[:-1][at[:-1] < len(data)]] = gone[at[:-1][at[:-1] < len(data)]]
                removed, spans = np.r_[0, np.cumsum(gone)][at], np.r_[0, np.cumsum(edge)][at]
                kept = data[~gone].tobytes()
                cut = at - removed
                out[0].extend(np.diff(at))
                out[1].extend(np.diff(removed))
                out[2].extend(np.diff(spans))
                out[3].extend(hashlib.sha256(kept[cut[i] : cut[i + 1]]).hexdigest() for i in range(stop - first))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return _spans(docs, text, key).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the repeated bytes taken out of the text; characters that a cut goes through go too. n_chars, where there is such a column, is set anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, stop, data, at in pieces(b.column(1)):
                gone = marked(b.column(2), slice(first, stop), at)
                kept, cut = data[~gone].tobytes(), at - np.r_[0, np.cumsum(gone)][at]
                out.extend(kept[cut[i] : cut[i + 1]].decode("utf-8", "ignore") for i in range(stop - first))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rest", "text"])
        give_back()

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(rest.alias("rest"), F.col(key).alias("a"), F.xxhash64(body).alias("b"), body.alias("text"))
    spans = repeated_spans(rows.select("a", "b", "text"), FORM)
    done = with_spans(rows, spans).select("rest", "text", "spans").mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, text string")
    return done.select([F.col("text").alias(c) if c == text else F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"rest.`{c}`").alias(c) for c, kind in docs.dtypes])
