"""Encoding against the sentencepiece library; the similarity join against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import jaccard, sentencepieces
from lodestone.llm.queries import tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_odd_characters(library):
    rng = random.Random(1)
    texts = [None, "", " ", "  a  b\n c\t", "▁x", "a▁▁ b ▁", "\xa0x", "<s></s><unk><0x0A>", " " * 50 + "x" + " " * 31, "aaaaaaa  aaaaaaaaaaaaa", "\r\n\t", "=" * 99, "them hem them them", "ﬁ ｆ"]
    texts += ["".join(rng.choice(" ▁ab\n\t€é中\U0001f600.,=-\x00\x7f​퟿") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    texts += ["".join(rng.choice("thenmi ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    for text, (ids, body) in zip(texts, sentencepieces.load(MODEL).encode_column(pa.array(texts, pa.string()))):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert ids.tolist() == want, repr(text)
        assert body.decode() == library.decode(want)


def test_small_stores_are_begun_anew(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "STORE", 10)
    texts = [f"word{i} and more {i * 7}" for i in range(200)]
    for n in range(0, 200, 20):
        got = [ids.tolist() for ids, _ in sentencepieces.load(MODEL).encode_column(pa.array(texts[n : n + 20]))]
        assert got == library.encode(texts[n : n + 20], add_bos=True, add_eos=True)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    got = sentencepieces.encode_documents(docs, MODEL, digests=True).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, odd_rows, none, library):
    got = sentencepieces.encode_documents(odd, MODEL, keep=("doc_id", "h")).collect()
    want = [(i, "h", library.encode(t or "", add_bos=True, add_eos=True)) for i, t, *_ in odd_rows]
    assert sorted(map(repr, ((r.doc_id, r.h, r.ids) for r in got))) == sorted(map(repr, want))
    assert all(r.decoded == library.decode(r.ids) for r in got)
    assert sentencepieces.encode_documents(none, MODEL).count() == 0


# -- similarity join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    ids = {t: [i for i, x in rows if (x or "") == t] for t in texts}
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = {}
    for a, t in enumerate(texts):
        known = [i for i in ids[t] if i is not None]
        least[top(a)] = min([*known, least.get(top(a), float("inf"))])
    out = []
    for a, t in enumerate(texts):
        c = least[top(a)]
        out += [(i, None if c == float("inf") else c, links[a], len(ids[t])) for i in ids[t]]
    return out


def test_classes_of_odd_rows(odd, odd_rows, none):
    got = jaccard.jaccard_classes(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_classes([(i, t) for i, t, *_ in odd_rows])))
    assert jaccard.jaccard_classes(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns


def test_large_buckets_are_cut(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    got = jaccard.jaccard_classes(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_classes([(i, t) for i, t, *_ in odd_rows])))


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(common, 150), rng.integers(0, 400, 60).astype(np.uint64)]) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    common = jaccard.Common(sets, 0)
    assert common.sizes(i[:30], j[:30]).tolist() == want[:30] and common.total is None
    assert common.sizes(i, j).tolist() == want and common.total is not None
    across = (i < 15) & (j >= 15)
    assert jaccard.Common(sets, 15).sizes(i[across], j[across]).tolist() == np.array(want)[across].tolist()


def test_candidates_in_chunks_are_those_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 16, jaccard.VALUES)
    sig = np.where(rng.random((50, jaccard.VALUES)) < 0.2, rng.integers(0, 1 << 16, (50, jaccard.VALUES)), base).astype(np.uint16)
    pairs = lambda left: sorted((int(a), int(b)) for i, j in jaccard.candidates(sig, 3, left) for a, b in zip(i, j))
    all_pairs = pairs(0)
    assert len(all_pairs) > 100 and pairs(20) == [(a, b) for a, b in all_pairs if a < 20 <= b]
    monkeypatch.setattr(jaccard, "CELLS", 64)
    assert pairs(0) == all_pairs


def test_blocks_are_bounded_in_bytes(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 2000)
    got = jaccard.jaccard_classes(odd).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_classes([(i, t) for i, t, *_ in odd_rows])))


def test_one_row_of_each_class_stays(spark):
    near = [" ".join(f"w{k}" for k in range(a, a + 100)) for a in (0, 3)]
    rows = [(1, near[0]), (1, near[0]), (2, near[1]), (3, "alone"), (3, "alone"), (None, "no id"), (None, "no id"), (None, near[0]), (5, None), (4, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(1, near[0]), (3, "alone"), (None, "no id"), (4, "")]))


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.needed()
    assert (np.diff(least) >= 0).all() and least[-1] < 0.8 * jaccard.VALUES
    rng = np.random.default_rng(5)
    matches = rng.binomial(1, 0.8, (20_000, jaccard.VALUES)).cumsum(axis=1)[:, jaccard.STEP - 1 :: jaccard.STEP]
    assert (matches < least).any(axis=1).mean() < 1e-3


def test_minhash_agreement_is_the_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    a, b = pool[:1000], pool[200:1200]  # 800 of 1200
    sig = jaccard.minhashes(np.r_[a, b], np.array([0, 1000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 2 / 3) < 0.2


def test_long_chains_are_connected(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (101, 99)], "node long, root long")
    got = {r.node: r.label for r in jaccard.connected(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[99], got[100], got[101]} == {99}
