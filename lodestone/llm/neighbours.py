"""Nearest neighbours by largest inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on the driver on a sample of at most FIT_ROWS vectors, with leaves that hold about LEAF_ROWS vectors
of the table or LEAF of the sample, whichever is fewer; every vector is then put into a leaf.
A query walks the tree with a priority queue of nodes, the one whose centre has the largest inner product with it
first, and so meets the leaves in the order in which they promise most. How many leaves are visited is calibrated:
the exact neighbours of CALIBRATION queries, which the tree has not been fitted on, among all vectors show how many leaves must be widened to until the
recall aimed at is reached; a query whose leaves hold fewer candidates than asked for goes on until they hold enough.
The vectors in visited leaves are compared exactly, in double precision.

Leaves of any size are dealt out in chunks, and so are the queries that visit them, so no task holds a whole one.

Defined results: vectors that are null, all zero, hold a null or non-finite component, or have another length than
most of the sample take no part, neither as query nor as candidate. Rows with a query's own id are not its candidates;
where several rows have it, they are one query, whose score with a candidate is that of the best of them, and each is a
candidate of other queries. Ties go to the smaller id; equal vectors have equal scores. A null id is no query and is never found. With fewer
candidates than asked for, all are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import keep

FIT_ROWS, CALIBRATION, RECALL = 20_000, 256, 0.97
#: Children a node, sampled vectors a leaf, vectors and queries a chunk.
BRANCH, LEAF, CHUNK = 12, 200, 4096
#: Vectors of the table a leaf, in the mean, as far as LEAST vectors of the sample are left for it.
LEAF_ROWS, LEAST = 50_000, 16


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & sound & F.exists(v, lambda x: x != 0)


class Tree:
    """Centres of all nodes; children by node, leaves numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 7):
        self.centres, self.children, self.leaf_of = [], [], []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(sample, rng, leaf, branch)
        self.centres = np.array(self.centres)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, leaf: int, branch: int) -> int:
        node = len(self.centres)
        self.centres.append(x.mean(axis=0))
        self.children.append([])
        self.leaf_of.append(-1)
        of = kmeans(x, branch, rng) if len(x) > leaf else np.zeros(len(x), int)
        groups = [x[of == k] for k in np.unique(of)]
        if len(groups) == 1:
            self.leaf_of[node] = self.leaves
            self.leaves += 1
        else:
            self.children[node] = [self._grow(g, rng, leaf, branch) for g in groups]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child's at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf_of[node] >= 0:
                out[rows] = self.leaf_of[node]
                continue
            kids = np.array(self.children[node])
            near = distances(x[rows], self.centres[kids]).argmin(axis=1)
            todo.extend((kid, rows[near == k]) for k, kid in enumerate(kids))
        return out

    def visits(self, q: np.ndarray, limit: int, sizes: np.ndarray | None = None, needs: np.ndarray | None = None) -> list[list[int]]:
        """For each query the first `limit` leaves, best bin first; with the leaves' sizes, more until they hold what the query needs."""
        promise = q @ self.centres.T
        out = []
        for p, lacks in zip(promise, needs if sizes is not None else np.zeros(len(q), int)):
            queue, found = [(-p[0], 0)], []
            while queue and (len(found) < limit or lacks > 0):
                _, node = heapq.heappop(queue)
                if self.leaf_of[node] >= 0:
                    found.append(self.leaf_of[node])
                    lacks -= 0 if sizes is None else sizes[found[-1]]
                for kid in self.children[node]:
                    heapq.heappush(queue, (-p[kid], kid))
            out.append(found)
        return out


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances up to a term of the row alone."""
    return (c * c).sum(axis=1) - 2 * (x @ c.T)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return np.zeros(len(x), int)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        of = distances(x, centres).argmin(axis=1)
        centres = np.array([x[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(len(centres))])
    return distances(x, centres).argmin(axis=1)


def best(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, rows of v, scores) of the k best of v for each query, by score and then id.

    A matrix product finds who can be among them; their scores are then summed in one fixed order, so that equal
    vectors have equal scores wherever they stand.
    """
    for a in range(0, len(q), 256):
        rough = q[a : a + 256] @ v.T
        for i, r in enumerate(rough, a):
            slack = 1e-9 * (np.abs(r).max() + 1e-300)
            own = vid != qid[i]
            n = int(own.sum())
            if not n:
                continue
            r = np.where(own, r, -np.inf)
            floor = np.partition(r, len(r) - k)[len(r) - k] if n > k else -np.inf
            near = np.flatnonzero(own & (r >= floor - slack))
            score = (v[near] * q[i]).sum(axis=1)
            top = np.lexsort((vid[near], -score))[:k]
            yield i, near[top], score[top]


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


class Index:
    """A tree over `vectors` (id and vector columns), every vector in its leaf, and the calibrated number of visits."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL):
        self.k = k
        # vectors move in their own type where that is float, and are doubles in all arithmetic
        self.kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
        rows = vectors.select(F.col(key).cast("long").alias("vid"), F.col(vector).cast(self.kind).alias("v")).filter(usable(F.col("v")) & F.col("vid").isNotNull())
        # by hash, thinned to twice the sample before it is put in order
        dice, all_ = F.pmod(F.xxhash64("vid"), F.lit(1 << 40)), max(1, rows.count())
        sample = rows.filter(dice < int(min(1.0, 2 * FIT_ROWS / all_) * (1 << 40))).orderBy(dice, "vid").limit(FIT_ROWS + CALIBRATION).toPandas()
        self.size = int(sample.v.map(len).mode().iloc[0]) if len(sample) else 0
        rows = rows.filter(F.size("v") == self.size)
        if not self.size:
            self.tree, self.rows, self.recall_at, self.limit = None, rows.withColumn("leaf", F.lit(0).cast("long")), [], 0
            return
        sample = sample[sample.v.map(len) == self.size]
        asked = min(CALIBRATION, len(sample) // 4)
        tree = self.tree = Tree(stacked(sample.v[asked:]), leaf=max(LEAST, min(LEAF, FIT_ROWS * LEAF_ROWS // all_)))

        def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(leaf=tree.assign(stacked(pdf.v)))

        self.rows = keep(rows.mapInPandas(put, f"vid long, v {self.kind}, leaf long"))
        self.recall_at = self._calibrate(sample.head(max(1, asked)).reset_index(drop=True))
        self.limit = int(np.searchsorted(self.recall_at, recall)) + 1
        self.limit = min(self.limit, tree.leaves)

    def exact(self, queries: pd.DataFrame) -> DataFrame:
        """row (of queries), query_id, vec_id, score and leaf of the k exact neighbours of a stated, small set of queries against all rows."""
        q, qid, k = stacked(queries.v), queries.vid.to_numpy(), self.k

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                leaf, vid = pdf.leaf.to_numpy(), pdf.vid.to_numpy()
                found = [(i, qid[i], vid[x], s, leaf[x]) for i, near, scores in best(q, qid, stacked(pdf.v), vid, k) for x, s in zip(near, scores)]
                yield pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score", "leaf"])

        return first_k(self.rows.mapInPandas(scan, "row long, query_id long, vec_id long, score double, leaf long"), k)

    def _calibrate(self, queries: pd.DataFrame) -> np.ndarray:
        """The mean recall of the calibration queries after 1, 2, ... visited leaves."""
        truth = self.exact(queries).toPandas()
        order = self.tree.visits(stacked(queries.v), self.tree.leaves)
        place = {(q, leaf): i for q, leaves in enumerate(order) for i, leaf in enumerate(leaves)}
        at = [place[q, leaf] for q, leaf in zip(truth.row, truth.leaf)]
        return np.cumsum(np.bincount(at, minlength=self.tree.leaves)) / max(1, len(at))

    def search(self, chosen: Column) -> DataFrame:
        """query_id, rank, vec_id, score: the k best found for every row that `chosen`, a condition on vid, picks as query."""
        if self.tree is None:
            return self.rows.select(F.col("vid").alias("query_id"), F.lit(1).alias("rank"), F.col("vid").alias("vec_id"), F.lit(0.0).alias("score"))
        tree, limit, k = self.tree, self.limit, self.k
        sizes = np.zeros(tree.leaves, np.int64)
        for r in self.rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a leaf
            sizes[r["leaf"]] = r["n"]

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), 512):
                    own = pdf.iloc[a : a + 512]
                    leaves = tree.visits(stacked(own.v), limit, sizes, k + own.n.to_numpy())
                    n = [len(x) for x in leaves]
                    yield pd.DataFrame({"row": np.repeat(own.row.to_numpy(), n), "qid": np.repeat(own.vid.to_numpy(), n), "q": np.repeat(own.v.to_numpy(), n), "leaf": np.concatenate(leaves).astype(np.int64)})

        same = F.count(F.lit(1)).over(Window.partitionBy("vid"))  # rows with the query's own id are not its candidates
        own_rows = self.rows.filter(chosen).select(F.monotonically_increasing_id().alias("row"), "vid", "v")  # of written rows: the same whenever it is read
        repeated = not own_rows.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
        asked = own_rows.repartition("vid").withColumn("n", same).mapInPandas(walk, f"row long, qid long, q {self.kind}, leaf long")
        asked = keep(asked)
        chunks = lambda df, n: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias(n))  # noqa: E731  a row a leaf
        dealt = F.broadcast(chunks(self.rows, "nv").join(chunks(asked, "nq"), "leaf"))
        v = self.rows.withColumn("at", F.monotonically_increasing_id()).join(dealt, "leaf").withColumn("cv", F.pmod(F.xxhash64("vid"), "nv")).withColumn("cq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)))
        q = asked.join(dealt, "leaf").withColumn("cq", F.pmod(F.xxhash64("row"), "nq")).withColumn("cv", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nv") - 1)))

        def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(q) and len(v):
                qid, vid, at = q.qid.to_numpy(), v.vid.to_numpy(), v["at"].to_numpy()
                found = [(np.full(len(near), qid[i]), at[near], vid[near], scores) for i, near, scores in best(stacked(q.q), qid, stacked(v.v), vid, k)]
            return pd.DataFrame({n: np.concatenate(x) if found else [] for n, x in zip(("row", "at", "vec_id", "score"), zip(*found) if found else [()] * 4)})

        by = ["leaf", "cv", "cq"]
        near = q.select(*by, "qid", "q").groupBy(*by).cogroup(v.select(*by, "vid", "v", "at").groupBy(*by)).applyInPandas(compare, "row long, at long, vec_id long, score double")
        if repeated:  # a candidate is found by several rows of one query
            near = near.groupBy("row", "at", "vec_id").agg(F.max("score").alias("score"))
        return first_k(near, k).select(F.col("row").alias("query_id"), "rank", "vec_id", "score")


def first_k(found: DataFrame, k: int) -> DataFrame:
    """The k first for each query (row), by score and then id, with their rank. A query has at most k rows from each task that looked for it."""
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`."""
    return Index(vectors, key, vector, k).search(F.col("vid") % every == 0)
