"""Removing long repeated runs of words, by a compressed FM-index with wavelet trees.

repeats.py brings together the slices whose windows can be equal. Here, a batch of slices is cut into shards of
bounded size; each shard becomes an FM-index: the Burrows-Wheeler transform of its strings in a wavelet matrix,
whose levels are packed bits with a running count for every 64 of them. All slices are streamed against every shard's index: backward
search extends each window's match to the left, symbol by symbol, with two rank queries a level, and gives the
interval of suffixes that begin with it. The number of symbols matched more than once is the matching statistic;
windows matched over their whole width by two suffixes or more are reported. The suffixes of a slice that stands for
several copies weigh as many, by running sums over the order of the suffixes.

A symbol is STRIDE consecutive words, named by the 64-bit hash of the hashes of its words, and a slice is STRIDE
strings, one for each phase, so a window of 35 words is five symbols wherever it starts.

Defined results: a null text has no words; texts under 35 words are kept whole; equal rows remove each other
wherever they are 35 words long; an empty table gives an empty result; extra columns are ignored, or passed
through by drop_substrings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.repeats import Form, identified, marked, repeated_spans, with_spans
from lodestone.llm.suffixes import Transform, dense
from lodestone.llm.text import flat, gather, give_back, pieces, prefix_hash, window_hash, word_hashes, words

WIDTH, GRAM, STRIDE = 35, 8, 7
#: Symbols in a shard.
SHARD_SYMBOLS = 1 << 18


class Bits:
    """Packed bits with rank queries: a running count for every word of 64."""

    def __init__(self, bit: np.ndarray):
        n = len(bit) // 64 + 1
        padded = np.zeros(64 * n, np.uint8)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words[:-1]))].astype(np.int32)

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Ones before x."""
        word = x >> 6
        mask = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class Wavelet:
    """A sequence of numbers under 2**bits with rank queries: bits by level, each stably parted by its bit."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.bits = max(1, int(values.max()).bit_length()) if self.n else 1
        self.levels, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(self.n - int(bit.sum()))
            values = np.r_[values[~bit], values[bit]]

    def rank(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often value stands before lo, and before hi."""
        begin = np.zeros(len(value), np.int64)  # where value's own rows begin, level by level
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((value >> level) & 1).astype(bool)
            bits, zeros = self.levels[k], self.zeros[k]
            ones = [bits.rank(x) for x in (begin, lo, hi)]
            begin, lo, hi = (np.where(one, zeros + r, x - r) for x, r in zip((begin, lo, hi), ones))
        return lo - begin, hi - begin

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


class FMIndex:
    """Backward search over the strings of one shard; weight: how many copies each string stands for."""

    def __init__(self, symbols: np.ndarray, string: np.ndarray, step: int, weight: np.ndarray):
        t = Transform(symbols, string, step)
        self.tree = Wavelet(t.bwt)
        self.rows = len(t.bwt)
        # rows that begin with a smaller symbol: the ends of the strings stand first
        self.before = t.strings + np.r_[0, 0, np.cumsum(np.bincount(symbols))[1:]] if len(symbols) else np.zeros(2, np.int64)
        self.top = len(self.before) - 2
        own = np.where(t.suffix >= 0, weight[string[np.maximum(t.suffix, 0)]], 1) if len(symbols) else np.zeros(0, np.int64)
        self.mass = None if (own == 1).all() else np.r_[0, np.cumsum(own)]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the rows that begin with symbol followed by what the rows from lo to hi begin with."""
        known = symbol <= self.top
        s = np.where(known, symbol, 0)
        a, b = self.tree.rank(s, lo, hi)
        a, b = self.before[s] + a, self.before[s] + b
        return np.where(known, a, 0), np.where(known, b, 0)

    def weight(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many suffixes the intervals stand for, copies included."""
        return hi - lo if self.mass is None else self.mass[hi] - self.mass[lo]


def matching(indexes: list[FMIndex], symbols: np.ndarray, ends: np.ndarray, step: int, depth: int) -> np.ndarray:
    """For each end, how many symbols, up to depth, going back from it in steps, match twice or more over all shards."""
    out = np.zeros(len(ends), np.int64)
    lo = [np.zeros(len(ends), np.int64) for _ in indexes]
    hi = [np.full(len(ends), x.rows) for x in indexes]
    live = np.arange(len(ends))
    for k in range(depth):
        s, total = symbols[ends[live] - k * step], np.zeros(len(live), np.int64)
        for i, x in enumerate(indexes):
            lo[i], hi[i] = x.extend(s, lo[i], hi[i])
            total += x.weight(lo[i], hi[i])
        more = total > 1
        out[live[more]] += 1
        live = live[more]
        lo, hi = [x[more] for x in lo], [x[more] for x in hi]
    return out


def index(body: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the slices, each there `weight` times, occur twice, and the windows' offsets by slice."""
    data, at = flat(body)
    hashes, at = np.frombuffer(data.tobytes(), np.uint64), at // 8
    size = np.diff(at)
    count = size - WIDTH + 1
    out_at = np.r_[0, np.cumsum(count)]
    if not len(hashes):
        return np.zeros(int(out_at[-1]), bool), out_at
    spots = size - STRIDE + 1
    start = gather(at[:-1], spots)
    names = dense(window_hash(prefix_hash(hashes), STRIDE)[start]) + 1
    spot_at = np.r_[0, np.cumsum(spots)]
    of = np.repeat(np.arange(len(size)), spots)
    cuts = np.unique(np.r_[0, np.searchsorted(spot_at, np.arange(SHARD_SYMBOLS, spot_at[-1], SHARD_SYMBOLS)), len(size)])
    indexes = [FMIndex(names[spot_at[a] : spot_at[b]], of[spot_at[a] : spot_at[b]] - a, STRIDE, weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    depth = WIDTH // STRIDE
    ends = gather(spot_at[:-1], count) + (depth - 1) * STRIDE  # each window's last symbol
    return matching(indexes, names, ends, STRIDE, depth) == depth, out_at


def word_symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the rows' word offsets."""
    starts, ends, first = words(data, at)
    return word_hashes(data, starts, ends), first


FORM = Form(WIDTH, GRAM, np.dtype(np.uint64), (4, 1), word_symbols, index)


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each row, its words that stay, joined by one blank."""
    s, n = starts[~gone], (ends - starts)[~gone]
    at = np.cumsum(n + 1) - (n + 1)
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    out[gather(at, n)] = data[gather(s, n)]
    edge = np.r_[at, len(out)][(first - np.r_[0, np.cumsum(gone)][first])]
    body = out.tobytes()
    return [body[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:])]


def substring_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_removed and kept_sha256 for every row."""
    rows = identified(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], []]
            for first, stop, data, at in pieces(b.column(1)):
                starts, ends, word = words(data, at)
                gone = marked(b.column(2), slice(first, stop), word)
                out[0].extend(np.diff(word))
                out[1].extend(np.diff(np.r_[0, np.cumsum(gone)][word]))
                out[2].extend(hashlib.sha256(x).hexdigest() for x in kept_words(data, starts, ends, gone, word))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, pa.int64()) for o in out[:2]), pa.array(out[2], pa.string())], [key, "n_words", "n_removed", "kept_sha256"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return with_spans(rows, repeated_spans(rows, FORM)).select("a", "text", "spans").mapInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string")


def drop_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and text, the words that stay joined by one blank, of every row."""
    rows = identified(docs, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first, stop, data, at in pieces(b.column(1)):
                starts, ends, word = words(data, at)
                gone = marked(b.column(2), slice(first, stop), word)
                out.extend(x.decode() for x in kept_words(data, starts, ends, gone, word))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [key, "text"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return with_spans(rows, repeated_spans(rows, FORM)).select("a", "text", "spans").mapInArrow(run, f"`{key}` {kind}, text string")
