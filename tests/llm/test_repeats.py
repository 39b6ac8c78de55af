"""Suffix and substring dedup against brute force; the parts they are made of."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import fmindex, repeats, suffixes
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def windows_gone(symbols: list, width: int) -> list[list[bool]]:
    key = lambda s, i: s[i : i + width] if isinstance(s, bytes) else tuple(s[i : i + width])
    seen = Counter(key(s, i) for s in symbols for i in range(len(s) - width + 1))
    out = []
    for s in symbols:
        gone = [False] * len(s)
        for i in range(len(s) - width + 1):
            if seen[key(s, i)] > 1:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def brute_bytes(texts):
    data = [(t or "").encode() for t in texts]
    out = []
    for b, gone in zip(data, windows_gone(data, 200)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def brute_words(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    return [(len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()) for w, gone in zip(words, windows_gone(words, 35))]


def same(got, ids, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, ((i, *w) for i, w in zip(ids, want))))


def test_bytes_on_odd_rows(odd, odd_rows, none):
    same(suffixes.repeat_report(odd).collect(), [r[0] for r in odd_rows], brute_bytes([r[1] for r in odd_rows]))
    assert suffixes.repeat_report(none).count() == 0


def test_words_on_odd_rows(odd, odd_rows, none):
    same(fmindex.substring_report(odd).collect(), [r[0] for r in odd_rows], brute_words([r[1] for r in odd_rows]))
    assert fmindex.substring_report(none).count() == 0


def test_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    same(suffixes.repeat_report(docs).collect(), [r.doc_id for r in rows], brute_bytes([r.text for r in rows]))
    same(fmindex.substring_report(docs).collect(), [r.doc_id for r in rows], brute_words([r.text for r in rows]))


def test_large_groups_are_divided_down_to_single_windows(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1)
    same(suffixes.repeat_report(odd).collect(), [r[0] for r in odd_rows], brute_bytes([r[1] for r in odd_rows]))
    same(fmindex.substring_report(odd).collect(), [r[0] for r in odd_rows], brute_words([r[1] for r in odd_rows]))


def test_a_frequent_passage_in_many_contexts(spark, monkeypatch):
    """Its groups are divided at some levels only; batches are smaller than groups."""
    monkeypatch.setattr(repeats, "GROUP_BYTES", 2000)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 1500)
    rng = np.random.default_rng(11)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    passage = word(50)
    texts = [f"{word(int(rng.integers(1, 60)))} {passage} {word(int(rng.integers(1, 60)))}" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    same(suffixes.repeat_report(docs).collect(), range(60), brute_bytes(texts))
    same(fmindex.substring_report(docs).collect(), range(60), brute_words(texts))


def test_long_texts_in_short_stretches(monkeypatch):
    symbols, at = np.arange(1000) % 97, np.array([0, 10, 400, 1000])
    monkeypatch.setattr(repeats, "STRETCH", 64)
    seen = [base + i for base, own, own_at in repeats.stretches(symbols, at, 30) for a, b in zip(own_at[:-1], own_at[1:]) for i in range(a, b - 29)]
    assert seen == [*range(10, 371), *range(400, 971)]


def test_rows_repeated_in_key_and_text(spark):
    texts = [prose(random.Random(k), 100) for k in (1, 1, 2, 3)]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[3])], "doc_id long, text string")
    every = [*texts, texts[3]]
    same(suffixes.repeat_report(docs).collect(), [1, 1, 2, None, None], brute_bytes(every))
    same(fmindex.substring_report(docs).collect(), [1, 1, 2, None, None], brute_words(every))


@pytest.mark.parametrize("module, kind", [(suffixes, np.uint8), (fmindex, np.uint64)])
def test_copies_are_found_by_the_index_itself(module, kind):
    body = pa.array([np.arange(k, k + module.WIDTH + 3).astype(kind).tobytes() for k in (0, 300, 600)], pa.binary())
    flags, at = module.index(body, np.array([1, 3, 1]))
    assert [flags[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [[k == 1] * 4 for k in range(3)]


def test_the_index_is_smaller_than_its_text():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 18, 200_000)
    assert fmindex.Wavelet(values).nbytes < 8 * len(values) / 2


def test_texts_without_repeats(odd, odd_rows):
    out = suffixes.drop_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    texts = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    for (i, t, *_), gone in zip(odd_rows, windows_gone([(r[1] or "").encode() for r in odd_rows], 200)):
        if i is not None:
            assert texts[i].text == bytes(x for x, g in zip((t or "").encode(), gone) if not g).decode("utf-8", "ignore")
            assert texts[i].n_chars == len(texts[i].text)
    words = {r.doc_id: r.text for r in fmindex.drop_substrings(odd).collect()}
    assert words[4] == "one two three four" and words[14] == ""


def random_slices(rng, n, width, kind):
    base = rng.integers(0, 3, 400)
    out = []
    for _ in range(n):
        a = rng.integers(0, 100)
        s = base[a : a + width + int(rng.integers(0, 60))].copy()
        if rng.random() < 0.6:
            s[rng.integers(0, len(s))] = 7
        out.append(s.astype(kind).tobytes())
    return pa.array(out, pa.binary())


@pytest.mark.parametrize("module, kind, shards", [(suffixes, np.uint8, "SHARD_BYTES"), (fmindex, np.uint64, "SHARD_SYMBOLS")])
@pytest.mark.parametrize("seed", range(4))
def test_indexes_over_many_shards(module, kind, shards, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    body = random_slices(rng, 40, module.WIDTH, kind)
    strings = [np.frombuffer(x, kind).tolist() for x in body.to_pylist()]
    seen = Counter(tuple(s[i : i + module.WIDTH]) for s in strings for i in range(len(s) - module.WIDTH + 1))
    want = [seen[tuple(s[i : i + module.WIDTH])] > 1 for s in strings for i in range(len(s) - module.WIDTH + 1)]
    for size in (1 << 20, 700, 50):
        monkeypatch.setattr(module, shards, size)
        assert module.index(body, np.ones(len(body), int))[0].tolist() == want


def test_merged_transforms_equal_one(rng=np.random.default_rng(9)):
    symbols, string = rng.integers(1, 4, 300), np.sort(rng.integers(0, 12, 300))
    whole = suffixes.Transform(symbols, string, 1)
    cut = np.searchsorted(string, [0, 4, 9, 12])
    parts = [suffixes.Transform(symbols[a:b], string[a:b] - string[a], 1) for a, b in zip(cut[:-1], cut[1:])]
    z, block = suffixes.merge(parts, 40)
    merged, at = np.empty(len(z), int), np.argsort(z, kind="stable")
    merged[at] = np.concatenate([p.bwt for p in parts])
    assert merged.tolist() == whole.bwt.tolist()


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 37, 500)
    tree = fmindex.Wavelet(values)
    v, lo = rng.integers(0, 37, 60), rng.integers(0, 250, 60)
    hi = lo + rng.integers(0, 250, 60)
    a, b = tree.rank(v, lo, hi)
    assert a.tolist() == [int((values[:x] == y).sum()) for x, y in zip(lo, v)]
    assert b.tolist() == [int((values[:x] == y).sum()) for x, y in zip(hi, v)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 900).astype(np.uint8)
    text[500:800] = text[100:400]
    from lodestone.llm.text import prefix_hash

    _, first, n, anchor = repeats.runs(prefix_hash(text), np.array([0, 900]), 50, 12)
    of = np.repeat(anchor, n) - np.arange(851)
    assert n.sum() == 851 and (of[100:351] == of[500:751]).all()
