"""Mixing sources to target weights.

The words of a source form one stream, in the order of a hash of the key, packed into blocks of BLOCK words
(the last is shorter). A mix is a sequence of slots, SHARD to an output shard. The counts of a shard's sources are
drawn from multinomials in proportion to what each source has still to give: once for each halving of the sequence
of shards that leads to it, so that each task finds the counts of its own shards, all tasks agree, and totals meet
the targets to within a block. The j-th slot of a source reads block perm(j mod n) of its n blocks, with
a pseudorandom permutation of its own for each pass j div n; slots and blocks are joined by this index.

Defined results: sources are ordered by code point, null last, and an empty text or null text has size 0 and
is never taken. No row is taken more than MAX_PASSES times. Rows that are equal in the key, or in all columns, are
rows of their own: they are told apart by the key and a hash of all columns, and equal ones take what is given to
either. An empty table gives an empty result. Extra columns pass through `mix_texts` unchanged.
The number of sources is taken to be small enough for the driver; rows, blocks, slots and shards are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rules import let, words_of
from lodestone.llm.shared import each_once, keep

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Words a block, slots an output shard, slots that are filled together, rows a run of the running sums.
BLOCK, SHARD, DEAL, RUN = 64, 1 << 18, 1 << 13, 4096
#: Tasks that fill slots, at most.
TASKS = 4096
SEED = 20


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> list[float]:
    """What each source shall give: by weight, at most `most` times its size; what is above goes to the others by weight."""
    total, w = float(sum(sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = sum(w[i] for i in free)
        over = [i for i in free if rest * w[i] / share > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * w[i] / share
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= set(over)
    return out


def counts_of(quota: np.ndarray, number: int, shard: int = SHARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For an output shard, how many slots of each source lie before it, and its own counts."""
    low, high = 0, -(-int(quota.sum()) // shard)
    left, before = quota.astype(np.int64), np.zeros(len(quota), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng, n = np.random.default_rng([seed, low, high]), (middle - low) * shard
        own = np.zeros(len(quota), np.int64)
        while n:
            more = np.minimum(rng.multinomial(n, (left - own) / (left - own).sum()), left - own)
            own += more
            n -= int(more.sum())
        if number < middle:
            left, high = own, middle
        else:
            left, before, low = left - own, before + own, middle
    return before, left


def draw_counts(quota: list[int], shard: int = SHARD, seed: int = SEED) -> Iterator[tuple[int, int, int, int]]:
    """(shard, source, first rank, count) of all output shards."""
    quota = np.array(quota, np.int64)
    for number in range(-(-int(quota.sum()) // shard)):
        before, counts = counts_of(quota, number, shard, seed)
        for i in np.flatnonzero(counts):
            yield number, int(i), int(before[i]), int(counts[i])


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at index, by a Feistel network over the next even power of two and walking its cycles."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for r in range(4):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def ident(docs: DataFrame, key: str) -> Column:
    """What tells rows apart: the key and a hash of all columns."""
    every = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    return F.struct(F.col(key).alias("key"), every.alias("hash"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


class Mix:
    """The plan of a mix: placed rows, the sources' figures, and slots."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block: int = BLOCK):
        self.spark, self.block = docs.sparkSession, block
        size = word_count(F.col(text))
        rows = keep(docs.select(ident(docs, key).alias("key"), F.col(source).alias("source"), size.cast("long").alias("size")))
        found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
        found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in found]
        goals = targets(sizes)
        self.blocks = [-(-s // block) for s in sizes]
        self.quota = np.array([min(MAX_PASSES * n, round(g * n / s)) if s else 0 for s, g, n in zip(sizes, goals, self.blocks)], np.int64)
        self.sources = self.spark.createDataFrame(
            [(i, r["source"], s, g, n) for i, (r, s, g, n) in enumerate(zip(found, sizes, goals, self.blocks))], "no int, source string, source_size long, target double, blocks long"
        )
        self.rows = keep(self._placed(rows, max(1, sum(r["n"] for r in found) // RUN)))

    def _placed(self, rows: DataFrame, runs: int) -> DataFrame:
        """no, key, size and start, the row's first word in its source's stream: sums over short runs, then over the runs' totals."""
        rows = rows.join(F.broadcast(self.sources), rows["source"].eqNullSafe(self.sources["source"])).select("no", "key", "size", "source_size", "target")
        h = F.xxhash64("key.key", F.lit(SEED))
        rows = rows.withColumn("h", h).withColumn("run", F.pmod("h", F.lit(runs)))
        before = Window.partitionBy("no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
        heads = rows.groupBy("no", "run").agg(F.sum("size").alias("t")).select("no", "run", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("head"))
        inside = Window.partitionBy("no", "run").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = rows.withColumn("upto", F.sum("size").over(inside)).join(heads, ["no", "run"])
        return placed.select("no", "key", "size", "source_size", "target", (F.col("head") + F.col("upto") - F.col("size")).alias("start"))

    def slots(self) -> DataFrame:
        """shard, slot, no and block for every slot of the mix. Each task draws the counts of the shards that it fills."""
        quota, blocks = self.quota, np.array(self.blocks or [0], np.int64)
        deals = -(-SHARD // DEAL)
        all_deals = -(-int(quota.sum()) // SHARD) * deals

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, ends = None, None
            for b in batches:
                for deal in b.column(0).to_pylist():
                    shard, part = divmod(deal, deals)
                    if shard != at:
                        before, counts = counts_of(quota, shard)
                        at, ends = shard, np.cumsum(counts)
                    slot = np.arange(part * DEAL, min((part + 1) * DEAL, ends[-1]))
                    if not len(slot):
                        continue
                    no = np.searchsorted(ends, slot, "right")
                    passes, index = np.divmod(before[no] + slot - (ends - counts)[no], blocks[no])
                    block = permuted(index, blocks[no], (passes + 1) * 1_000_003 + no + SEED)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), shard)), pa.array(slot), pa.array(no.astype(np.int32)), pa.array(block)], ["shard", "slot", "no", "block"])

        return self.spark.range(0, all_deals, 1, max(1, min(TASKS, all_deals))).mapInArrow(fill, "shard long, slot long, no int, block long")

    def segments(self) -> DataFrame:
        """no, block, key, start and words: the part of each row in each block that it touches."""
        b = F.lit(self.block)
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        spread = self.rows.filter(F.col("size") > 0).withColumn("block", F.explode(F.sequence(first, last)))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        return spread.select("no", "block", "key", "start", "size", words.alias("words"))

    def taken(self) -> DataFrame:
        """no, key, start, size, words taken, and the list of (block, times) of each row of which something is taken."""
        times = self.slots().groupBy("no", "block").agg(F.count(F.lit(1)).alias("times"))
        # the planner takes slots for as small as the few rows that they are made from; they grow with the input
        joined = self.segments().join(times.hint("merge"), ["no", "block"])
        return joined.groupBy("no", "key", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.collect_list(F.struct("block", "times")).alias("blocks"))


def mix_report(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken for every row."""
    mix = Mix(docs, text, key, source)
    got = mix.taken().select("no", F.col("key").alias("_key"), F.col("start").alias("_start"), "taken")
    same = (F.col("no") == F.col("_no")) & F.col("key").eqNullSafe(F.col("_key")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    out = mix.rows.join(got.withColumnRenamed("no", "_no"), same, "left")
    return out.select(F.col("key.key").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: shard, slot, source, block, key, and the first word and number of words that the slot takes from the row."""
    mix = Mix(docs, text, key, source)
    part = mix.slots().hint("merge").join(mix.segments(), ["no", "block"]).join(F.broadcast(mix.sources.select("no", "source")), "no")
    return part.select("shard", "slot", "source", "block", F.col("key.key").alias(key), F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0)).alias("first_word"), "words")


def mix_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """docs as the mix takes them, with the same columns: a row for each of the passes that takes something of it.

    A pass that takes all words of a row keeps its text as it is; otherwise the words that it takes are joined by
    blanks. n_chars, where there is such a column, is set anew.
    """
    mix = Mix(docs, text, key, source)
    got = mix.taken().select(F.col("key").alias("_key"), F.col("start").alias("_start"), F.col("size").alias("_size"), "blocks")
    b = F.lit(BLOCK)
    passes = got.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.array_max(F.col("blocks.times")).cast("int"))))
    in_pass = F.array_sort(F.transform(F.filter("blocks", lambda x: x["times"] >= F.col("_pass")), lambda x: x["block"]))
    passes = passes.select("_key", "_start", "_size", in_pass.alias("_in"))
    whole = F.size("_in") == F.floor((F.col("_start") + F.col("_size") - 1) / b) - F.floor(F.col("_start") / b) + 1
    first = lambda block: F.greatest(block * b - F.col("_start"), F.lit(0))
    part = lambda w, block: F.array_join(F.slice(w, (first(block) + 1).cast("int"), ((block + 1) * b - F.col("_start") - first(block)).cast("int")), " ")
    some = let(words_of(F.col("_text")), lambda w: F.array_join(F.transform("_in", lambda block: part(w, block)), " "))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), ident(docs, key).alias("_id"), F.col(text).alias("_text"))
    rows = each_once(rows, mix.rows.select(F.col("key").alias("_id")), ["_id"])
    joined = rows.join(passes, F.col("_id").eqNullSafe(F.col("_key"))).withColumn("_out", F.when(whole, F.col("_text")).otherwise(some))
    return joined.select([F.col("_out").alias(c) if c == text else F.length("_out").cast(kind).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c, kind in docs.dtypes])
