"""WARC round trips, language-model scores and nearest neighbours."""

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours, recurrent, scoring, warc
from lodestone.llm.shared import fresh_path

PAGES = "page_id long, url string, html string, key string, digest string"


# -- WARC


def page_rows():
    big = "<html>" + "é" * 100 + "</html>"
    rows = [(1, "http://a.example/x y", big), (2, "https://www.A.example:443/x%20y#f", big), (3, None, big), (4, "not a url %", "short"), (5, "http://a.example/", "short"), (6, "", None), (7, "http://[bad", ""), (8, "http://b.example/\r\nq", "z" * 100), (9, "http://b.example/\r\nq", "z" * 99), (10, "http://b.example/", "z" * 99)]
    rows += [(20 + i, f"http://h{i % 7}.example.org/p?{i}", f"page {i} " * 30) for i in range(40)]
    rows += [(100 - i, "http://same.example/", "copy " * 50) for i in range(20)]
    return [*rows, (200, "http://twice.example/", "t" * 300), (200, "http://twice.example/", "t" * 300), (-5, "http://neg.example/", "page 3 " * 30)]


def brute_pages(rows):
    body = [((h or "").encode(), i) for i, _, h in rows]
    first = {}
    for b, i in body:
        first[b] = min(i, first.get(b, i))
    return [(i, len(b), hashlib.sha256(b).hexdigest(), *(("revisit", first[b]) if len(b) >= 100 and first[b] != i else ("response", None))) for b, i in body]


def test_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES)
    got = warc.round_trip(spark, pages).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_pages(rows)))
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_null_page_ids(spark):
    pages = spark.createDataFrame([(None, "http://x.example/", "n" * 200, "", ""), (5, None, "n" * 200, "", ""), (None, None, None, "", "")], PAGES)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    assert got == {(None, 200, "revisit", 5), (5, 200, "response", None), (None, 0, "response", None)}


def test_large_ids_beside_null_ones(spark):
    base = 9_007_199_254_740_993
    rows = [(base + k, f"http://h{k % 4}.org/{k}", ("copy " * 40) if k % 3 else f"own {k} " * 30) for k in range(40)] + [(None, "http://none.org/", "copy " * 40), (None, None, None)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first = base + 1
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = html == "copy " * 40 and i != first
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_reading_back_is_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    pages = spark.createDataFrame([(k, f"http://h{k}.org/", f"text {k} " * 50) for k in range(100)], "page_id long, url string, html string")
    folder = warc.fresh_path(spark, "warc")
    back = warc.read_blocks(warc.write_archives(warc.with_revisits(pages), folder, 2), folder)
    assert back.rdd.getNumPartitions() > 4 and sorted(r.page_id for r in back.collect()) == list(range(100))


def test_index_blocks_and_lookups(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = page_rows()
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(warc.with_revisits(spark.createDataFrame([(*r, "k", "d") for r in rows], PAGES)), folder, parts=3)
    parts = manifest.collect()
    assert sum(p.records for p in parts) == len(rows) and sum(p.blocks for p in parts) > 3
    wanted = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(999, "http://nowhere.example/")], "page_id long, url string")
    got = {(r.page_id, r.url) for r in warc.lookup(manifest, folder, wanted).collect()}
    assert got == {(i, u) for i, u, _ in rows}
    part = warc.Part(folder, parts[0].part)
    assert part.firsts == sorted(part.firsts, key=warc.sortable)
    assert part.find("zzz)/", 1) is None and part.find("", 1) is None
    files, base = warc.open_fs(folder)
    with files.open_input_stream(f"{base}/{parts[0].part}-0.warc.gz", compression=None) as f:
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_url_keys():
    assert warc.surt("https://www.Example.com:443/A?b=1#c") == "com,example)/a?b=1"
    assert warc.surt("http://x.org:8080") == "org,x:8080)/" and warc.surt(None) == ")/"


# -- scores


def plain_scores(rows):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)), None] for _, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in rows]
    c = Counter(w for t, held in zip(toks, out) if not held for w in t)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (i, _), t, held in zip(rows, toks, out)]


def check_scores(got, rows):
    want = sorted(plain_scores(rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=repr)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: repr(x[:5])), sorted(want, key=lambda x: repr(x[:5]))):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and g[6] <= 0


def test_scores_of_odd_rows(odd, odd_rows, none, monkeypatch):
    check_scores(scoring.score_documents(odd).collect(), [r[:2] for r in odd_rows])
    monkeypatch.setattr(scoring, "HEAD", 12)
    check_scores(scoring.score_documents(odd).collect(), [r[:2] for r in odd_rows])
    assert scoring.score_documents(none).count() == 0


def test_held_out_documents_gain_on_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = scoring.score_documents(docs).toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and held.score.sum() > held.base_score.sum()


def random_model(seed=0):
    m = recurrent.Gru.fresh(np.full(scoring.NUMBERED, 1 / scoring.NUMBERED))
    m.w += np.random.default_rng(seed).standard_normal(len(m.w)).astype(np.float32) * 0.2
    return m


def test_probabilities_sum_to_one():
    m, state = random_model(), np.random.default_rng(1).standard_normal((1, recurrent.HIDDEN)).astype(np.float32)
    logp, _ = m.outputs(np.repeat(state, scoring.NUMBERED, axis=0), np.arange(scoring.NUMBERED))
    assert abs(np.exp(logp).sum() - 1) < 1e-4


def test_scores_do_not_depend_on_lanes_or_windows(monkeypatch):
    rng = np.random.default_rng(2)
    ids, at = rng.integers(0, scoring.NUMBERED, 700).astype(np.int32), np.array([0, 300, 301, 301, 420, 700])
    m = random_model()
    alone = [m.score(ids[a:b], np.array([0, b - a]), 3)[0] for a, b in zip(at[:-1], at[1:])]
    monkeypatch.setattr(recurrent, "SCORE_STEPS", 7)
    assert np.allclose(m.score(ids, at, 3), alone, rtol=1e-4)


def test_gradients():
    rng = np.random.default_rng(4)
    m = random_model()
    w, t = rng.integers(0, 60, (6, 3)).astype(np.int32), np.zeros((6, 3), np.int32)
    t[0] = t[3, 1] = -1
    w[4:, 2] = -1
    h, before = rng.standard_normal((3, recurrent.HIDDEN)).astype(np.float32) * 0.1, np.zeros(3, np.int32)

    class Caught(Exception):
        pass

    class Catch:
        def update(self, w, g):
            self.g = g * int((words >= 0).sum())

    words, catch = w, Catch()
    m.window(w, t, h, before, 5, catch)

    def loss(weights):
        x, state, total = recurrent.Gru(weights), h, 0.0
        read = x.inputs(w, t, before, 5)
        for i in range(len(w)):
            state = x.step(np.where(t[i][:, None] < 0, np.float32(0), state), x.x[read[i]] + x.b)[0]
            real = w[i] >= 0
            total -= x.outputs(state[real], w[i][real])[0].sum()
        return total

    checked = 0
    for k in np.argsort(-np.abs(catch.g))[:40:4]:
        up, down = m.w.astype(np.float64), m.w.astype(np.float64)
        up[k] += 1e-4
        down[k] -= 1e-4
        want = (loss(up) - loss(down)) / 2e-4
        assert abs(catch.g[k] - want) < 2e-2 * max(1, abs(want))
        checked += 1
    assert checked == 10


# -- neighbours


def brute_neighbours(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 4]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scores = sorted(((-float((v * x).sum()), i) for i, v in ok if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(300, None), (301, []), (302, [0.0] * 4), (303, [1.0, None, 1.0, 1.0]), (304, [1.0, float("nan"), 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0, 1.0]), (306, [1.0, 2.0]), (None, [9.0] * 4), (307, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, leaf int, vid int")
    got = neighbours.neighbours(df, every=5).toPandas()
    want = brute_neighbours(rows, 5, 20)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, len(own) + 1))
        assert own.score.is_monotonic_decreasing
        assert all(a < b for (a, s), (b, r) in zip(zip(own.vec_id, own.score), list(zip(own.vec_id, own.score))[1:]) if s == r)
        exact = dict(want[q])
        hits += len(set(own.vec_id) & set(exact))
        assert all(abs(exact[i] - s) < 1e-9 * max(1, abs(s)) for i, s in zip(own.vec_id, own.score) if i in exact)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert neighbours.neighbours(spark.createDataFrame([], schema)).count() == 0
    got = neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], schema)).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert neighbours.neighbours(spark.createDataFrame([(0, [1.0, 0.0], 1)], schema)).count() == 0


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = neighbours.Index(df)
    found = index.search(F.col("vid") % 20 == 0).toPandas()
    queries = index.rows.filter("vid % 20 = 0").select("vid", "v").toPandas()
    exact = index.exact(queries).toPandas()
    both = found.merge(exact, on=["query_id", "vec_id"])
    assert len(both) >= 0.9 * len(exact)
    assert np.allclose(both.score_x, both.score_y)
    assert index.limit < index.tree.leaves
