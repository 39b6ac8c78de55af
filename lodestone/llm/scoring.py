"""Language-model scores of whole documents.

Counts of all training tokens give a smoothed unigram base. The most frequent words have numbers of their own in a
gated recurrent model (recurrent.py); all other words are in buckets by their first two bytes, and each bucket has a
number. A word of a bucket has the model's probability of the bucket times the word's share of the base's mass in it,
so probabilities sum to one over all training tokens and one unseen token a bucket.

Training takes every token of every training document once. The documents are dealt by a hash of id and text to ROUNDS
rounds, and in each to replicas of about REPLICA_WORDS tokens, whatever the table's partitions; each replica trains its
own copy of the weights by truncated backpropagation, the state carried through each document (a later part of a long
one, which trains beside the first, begins with the state of the words before it), and after a round the copies are
averaged by words. Scoring takes every word of every document, with the state carried from window to window.

Words are known by 64-bit hashes whose last bits are the bucket. The most frequent, HEAD of them in the mean at most, are
looked up in a table of fixed size that goes to all workers; the documents' other words are joined with the counts.

Defined results: A-Z are lower-cased; a null or empty text is one end token; a null id counts as an empty text, so
such rows are held out. Repeated rows are learnt from and scored each. An empty table gives an empty result. Without any
training document, N and V are 0: the base is then 1 for each token and the model spreads evenly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.recurrent import CLASSES, SLOTS, Adam, Gru, held, lanes_for
from lodestone.llm.repeats import release
from lodestone.llm.shared import drop_path, fresh_path, keep
from lodestone.llm.text import gather, give_back, mixed, pieces, word_hashes, words

HEAD, NUMBERED = 1 << 18, CLASSES * SLOTS
#: Numbers of buckets come first, then those of words. BUCKET masks the bucket in a word's hash.
BUCKETS = 128
BUCKET = np.uint64(BUCKETS - 1)
#: Rounds of training; tokens a replica, in the mean; tasks that train, at most.
ROUNDS, REPLICA_WORDS, TASKS = 3, 1 << 21, 8192
#: Tasks that add up weights before one does.
ADDERS = 64
#: Distinct words counted in a worker, and words scored together.
COUNTED, SCORED = 1_000_000, 4_000_000
END = np.uint64(0x656E6400)
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each row and an end, one after the other, and the rows' offsets."""
    starts, ends, first = words(data, at)
    low = LOWER[data]
    one, two = low[starts], np.where(ends - starts > 1, low[np.minimum(starts + 1, max(0, len(low) - 1))], 0) if len(low) else low
    bucket = mixed((one.astype(np.uint64) << np.uint64(8)) | two.astype(np.uint64)) & BUCKET
    h = (word_hashes(low, starts, ends) & ~BUCKET) | bucket
    out_at = first + np.arange(len(first))
    out = np.empty(int(out_at[-1]), np.uint64)
    out[out_at[1:] - 1] = END
    n = np.diff(first)
    out[gather(out_at[:-1], n)] = h
    return out, out_at


def prepared(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, held_out, text."""
    rest = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10
    return docs.select(F.col(key).alias("doc_id"), (rest == 0).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def count_tokens(training: DataFrame) -> DataFrame:
    """w and c of every training token; workers add up before anything is shuffled."""

    def add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        w, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return w, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]).astype(float), minlength=len(w)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in batches:
            for *_, data, at in pieces(b.column(0)):
                parts.append(np.unique(tokens(data, at)[0], return_counts=True))
                n += len(parts[-1][0])
                if n > COUNTED:
                    parts = [add(parts)]
                    n = len(parts[0][0])
                    if n > COUNTED // 2:
                        yield made(parts.pop())
                        n = 0
        if parts:
            yield made(add(parts))
        give_back()

    def made(p: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1])], ["w", "c"])

    return training.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Table:
    """Places of words in a sorted array of hashes, found by their first bits."""

    def __init__(self, w: np.ndarray):
        self.w, bits = w, max(1, len(w)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(w >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max())

    def look(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the array, and whether the word is there."""
        at, there = np.zeros(len(w), np.int32), np.zeros(len(w), bool)
        if len(self.w):
            begin = self.first[w >> self.shift]
            for k in range(self.longest):
                place = np.minimum(begin + k, len(self.w) - 1)
                hit = self.w[place] == w
                at[hit], there = place[hit], there | hit
        return at, there


@dataclass
class Vocabulary:
    """The head of the counts, sorted by hash: count of each word and its number, or its bucket; totals; c + 0.1 summed by bucket."""

    w: np.ndarray
    c: np.ndarray
    number: np.ndarray
    n: int
    v: int
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.n + 0.1 * (self.v + 1))

    def mass(self) -> np.ndarray:
        """The base's mass of each number, with one unseen token a bucket; buckets hold what has no number of its own."""
        out = np.zeros(NUMBERED)
        own = self.number >= BUCKETS
        out[self.number[own]] = self.base(self.c[own])
        inside = np.bincount((self.w[own] & BUCKET).astype(np.int64), weights=self.c[own] + 0.1, minlength=BUCKETS)
        out[:BUCKETS] = (np.maximum(self.buckets - inside, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        return out

    @cached_property
    def head(self) -> Table:
        return Table(self.w)

    @cached_property
    def own(self) -> tuple[Table, np.ndarray]:
        """The words with a number of their own, and the numbers."""
        some = self.number >= BUCKETS
        return Table(self.w[some]), self.number[some].astype(np.int32)

    def numbers(self, w: np.ndarray) -> np.ndarray:
        table, number = self.own
        at, there = table.look(w)
        out = (w & BUCKET).astype(np.int32)
        out[there] = number[at[there]]
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The most frequent words, HEAD of them in the mean at most: by a histogram of counts in steps of a sixteenth of a doubling, and by hash inside the last step."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(16 * F.log2("c"))
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # under 1,000 rows
    held_, last, share = 0, None, 1.0
    for r in sorted(steps, key=lambda r: -r["level"]):
        last, share = r["level"], min(1.0, (HEAD - held_) / r["n"])
        held_ += r["n"]
        if held_ >= HEAD:
            break
    some = (level == F.lit(last)) & (F.pmod(F.xxhash64("w"), F.lit(1 << 40)) < int(share * (1 << 40)))
    wanted = (level > F.lit(last)) | some | (F.col("w") == F.lit(int(END)))  # the end always has a number
    top = counts.filter(wanted).toPandas().sort_values(["c", "w"], ascending=[False, True])
    w, c = top.w.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    rank = np.argsort(w != END, kind="stable").argsort(kind="stable")  # the end first, then by count
    number = np.where(rank < NUMBERED - BUCKETS, rank + BUCKETS, (w & BUCKET).astype(np.int64))
    buckets = np.zeros(BUCKETS)
    for r in counts.groupBy(F.col("w").bitwiseAND(BUCKETS - 1).alias("b")).agg(F.sum(F.col("c") + 0.1).alias("m")).collect():  # a row a bucket
        buckets[r["b"]] = r["m"]
    order = np.argsort(w)
    return Vocabulary(w[order], c[order], number[order], int(total["n"] or 0), int(total["v"]), buckets)


def coded(training: DataFrame, vocab, rounds: int, replicas: int) -> DataFrame:
    """turn, replica, h (a hash that orders the documents) and the numbers of all tokens, two bytes each, of every training document."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, stop, data, at in pieces(b.column(1)):
                w, of = tokens(data, at)
                body = vocab.value.numbers(w).astype("<u2")
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - first, [None, pa.py_buffer((2 * of).astype(np.int64)), pa.py_buffer(body)])
                own = b.column(0).slice(first, stop - first)
                dealt = mixed(own.to_numpy().view(np.uint64).copy()) % np.uint64(rounds * replicas)
                yield pa.RecordBatch.from_arrays([pa.array((dealt % np.uint64(rounds)).astype(np.int32)), pa.array((dealt // np.uint64(rounds)).astype(np.int64)), own, ids.cast(pa.binary())], ["turn", "replica", "h", "ids"])
        give_back()

    return training.select(h.alias("h"), "text").mapInArrow(run, "turn int, replica long, h long, ids binary")


def fit(training: DataFrame, vocab, rounds: int = ROUNDS, replica_words: int = REPLICA_WORDS) -> Gru:
    """Averages of the replicas' weights after each round."""
    spark = training.sparkSession
    model = Gru.fresh(vocab.value.mass())
    start = int(vocab.value.numbers(np.array([END]))[0])
    replicas = max(1, -(-vocab.value.n // (rounds * replica_words)))
    path = fresh_path(spark, "coded")
    coded(training, vocab, rounds, replicas).write.parquet(path)
    every = spark.read.schema("turn int, replica long, h long, ids binary").parquet(path)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model.w)

        def train(batches: Iterator[pa.RecordBatch], turn: int = turn, sent=sent) -> Iterator[pa.RecordBatch]:
            total, learnt = 0.0, 0
            for replica, ids, at in replicas_of(batches):
                own = Gru(sent.value.copy())
                n = own.train(ids, at, start, Adam(len(own.w), turn), lanes_for(len(ids)))
                total, learnt = total + n * own.w.astype(np.float64), learnt + n
            if learnt:
                yield pa.RecordBatch.from_arrays([pa.array([int(replica)]), pa.array([learnt]), pa.array([total.tobytes()], pa.binary())], ["g", "n", "w"])
            give_back()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in batches:
                for k, w in zip(b.column(0).to_pylist(), b.column(1)):
                    total, n = total + np.frombuffer(w.as_buffer(), np.float64), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["n", "w"])

        dealt = every.filter(F.col("turn") == turn).select("replica", "h", "ids").repartition(min(replicas, TASKS), "replica").sortWithinPartitions("replica", "h", "ids")
        copies = dealt.mapInArrow(train, "g long, n long, w binary")
        # sums of a task's replicas, then of a number of tasks, then of all
        sums = copies.repartition(ADDERS, "g").select("n", "w").mapInArrow(add, "n long, w binary").repartition(1).mapInArrow(add, "n long, w binary")
        if found := sums.collect():  # one row
            model = Gru((np.frombuffer(found[0]["w"], np.float64) / found[0]["n"]).astype(np.float32))
        sent.unpersist()
    drop_path(spark, path)
    return model


def replicas_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(replica, numbers, document offsets) of rows that are sorted by replica."""
    now, ids, sizes = None, [], []

    def done() -> tuple[int, np.ndarray, np.ndarray]:
        return now, np.frombuffer(b"".join(ids), "<u2").astype(np.int32), np.r_[0, np.cumsum(sizes)] // 2

    for b in batches:
        for k, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != now and ids:
                yield done()
                ids, sizes = [], []
            now = k
            ids.append(body)
            sizes.append(len(body))
    if ids:
        yield done()


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = prepared(docs, text, key)
    context = rows.sparkSession.sparkContext
    training = rows.filter(~F.col("held_out"))
    counts = keep(count_tokens(training))
    release(rows.sparkSession)
    vocab = context.broadcast(vocabulary(counts))
    weights = context.broadcast(fit(training, vocab).w)
    v = vocab.value
    mass = np.log10(np.maximum(v.mass(), 1e-300))  # numbers that no word has
    start = int(v.numbers(np.array([END]))[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, v = Gru(weights.value), vocab.value
        base = np.log10(v.base(v.c))

        def texts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for b in batches:
                for first, stop, data, at in pieces(b.column(2)):
                    w, of = tokens(data, at)
                    place, there = v.head.look(w)
                    number, value = (w & BUCKET).astype(np.int32), np.zeros(len(w))
                    number[there], value[there] = v.number[place[there]], base[place[there]]
                    by = lambda x: np.diff(np.r_[0, np.cumsum(x)][of])
                    tail_n = by(~there)
                    tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tail_n)].astype(np.int32)), pa.array(w[~there].view(np.int64)))
                    known_part = np.add.reduceat(value, of[:-1])
                    spare = np.add.reduceat(np.where(number < BUCKETS, value - mass[number], 0.0), of[:-1])
                    waiting.append((b.column(0).slice(first, stop - first), b.column(1).slice(first, stop - first), np.diff(of), by(there), known_part, spare, tail))
                    yield number, of

        waiting: list[tuple] = []
        for sizes, ids, at in held(texts(), SCORED):
            score = model.score(ids, at, start) / np.log(10)
            k = 0
            for n, (doc, out, total, known, known_part, spare, tail) in zip(sizes, waiting):
                yield pa.RecordBatch.from_arrays([doc, out, pa.array(total), pa.array(known), pa.array(known_part), pa.array(score[k : k + n] + spare), tail], ["doc_id", "held_out", "n_tokens", "n_head", "base_head", "score_head", "tail"])
                k += n
            waiting.clear()
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = keep(rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_head long, base_head double, score_head double, tail array<long>"))
    scored = scored.withColumn("_row", F.monotonically_increasing_id())  # of written rows: the same whenever it is read
    spread = scored.select("_row", F.explode("tail").alias("w"))
    joined = spread.join(counts, "w", "left").groupBy("_row").agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(v.n + 0.1 * (v.v + 1)))).alias("tail_score"), F.count("c").alias("tail_known"))
    out = scored.drop("tail").join(joined, "_row", "left")
    more = F.coalesce("tail_score", F.lit(0.0))
    return out.select(F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"), (F.col("base_head") + more).alias("base_score"), (F.col("score_head") + more).alias("score"))
