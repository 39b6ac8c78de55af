"""Quality rules, sharding and mixing against plain Python and against their laws."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import mixing, rules, shards
from lodestone.llm.queries import LLM_QUERIES, LLM_SQL
from tests.compare import oracle, rows

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_against_sql(spark, name):
    got, want = LLM_QUERIES[name](spark, SF).toPandas(), oracle(SF, LLM_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def brute_quality(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    kept = not (failed or 10 * symbols > len(w) or chars < 2 * len(w) or chars > 16 * len(w) or 10 * dup > len(w))
    return len(w), chars, symbols, dup, len(repeated), failed, kept


def test_quality_of_odd_rows(odd, odd_rows, none):
    got = rules.quality_report(odd).drop("rejected_by").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute_quality(t))) for i, t, *_ in odd_rows)
    kept = rules.quality_filter(odd)
    assert kept.columns == odd.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(i) for i, t, *_ in odd_rows if brute_quality(t)[-1])
    assert rules.quality_report(none).count() == 0 and rules.quality_filter(none).count() == 0


def test_order_of_rules():
    figures = {"short": (2.0, 0.1), "repeats": (60.0, 0.3), "symbols": (1.0, 0.2), "word_length": (1.0, 0.0), "lines": (2.0, 0.1)}
    assert [r.name for r in rules.ordered(rules.BASE + rules.FURTHER, figures)] == ["symbols", "lines", "short", "repeats", "word_length"]


def test_good_documents_are_kept(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    judged = rules.quality_report(docs).join(labels, "doc_id").toPandas()
    good = judged[(judged.quality == 1) & ~judged.base_failed]
    assert good.kept.all()
    assert judged[judged.quality == 0].kept.mean() < 0.1


def check_shards(got, docs, n):
    assert len(got) == len(docs)
    sizes = Counter()
    for s, own in got.groupby("shard"):
        assert 0 <= s < n and sorted(own.slot) == list(range(len(own)))
        sizes[s] = own["size"].sum()
    assert (got.law == "bytes").all() and got.grown_shard.isna().all()
    biggest, total = max(got["size"], default=0), got["size"].sum()
    for s in range(n):
        assert abs(sizes[s] - total / n) <= biggest


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = shards.shard_by_bytes(docs).toPandas()
    check_shards(got, docs.toPandas(), 40)
    texts = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())


def test_shards_of_odd_rows(odd, odd_rows, none):
    got = shards.shard_by_bytes(odd, 5).toPandas()
    check_shards(got, odd_rows, 5)
    assert sorted(got["size"]) == sorted(len((t or "").encode()) + 16 for _, t, *_ in odd_rows)
    assert shards.shard_by_bytes(none).count() == 0


def test_overfull_ranges_are_subdivided(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('t', id)) as text")
    rows = shards.sized(docs).withColumn("place", shards.spot(shards.F.col("text_crc32"), shards.F.col("doc_id")))
    assert len(shards.subdivide(rows, [-(1 << 62)])) > 1  # all rows are above the one cut
    check_shards(shards.shard_by_bytes(docs).toPandas(), range(3000), 40)


def test_targets():
    assert mixing.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 100, 100])
    assert got[0] == 30 and abs(sum(got) - 210) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert mixing.targets([0, 50, 0]) == [0.0, 50.0, 0.0] and mixing.targets([]) == []
    assert mixing.targets([5]) == [5.0]


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        got = [mixing.permuted(np.arange(n), np.full(n, n), np.full(n, k)) for k in (1, 2)]
        assert all(sorted(g) == list(range(n)) for g in got)
        assert n < 17 or (got[0] != got[1]).any()


def test_counts_meet_quotas():
    got = list(mixing.draw_counts([70, 0, 11, 300], shard=50))
    for s, q in enumerate([70, 0, 11, 300]):
        own = [(first, n) for _, k, first, n in got if k == s]
        assert sum(n for _, n in own) == q
        assert [f for f, _ in own] == np.cumsum([0, *[n for _, n in own]])[: len(own)].tolist()
    assert all(sum(n for shard, _, _, n in got if shard == k) == 50 for k in range(7))


def test_mix_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_report(docs).toPandas()
    again = mixing.mix_report(docs.repartition(3)).toPandas()
    order = lambda x: x.sort_values("doc_id").reset_index(drop=True)
    assert order(got).equals(order(again))
    source = dict(docs.select("doc_id", "source").toPandas().itertuples(index=False))
    sums = got.assign(source=got.doc_id.map(source)).groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums.said).all() and (got.taken <= 3 * got["size"]).all()
    names = sorted(sums.index)
    assert np.allclose([sums.target[n] for n in names], mixing.targets([int(sums["size"][n]) for n in names]))
    assert ((sums.taken - sums.target).abs() <= 64).all()


def test_mix_of_odd_rows(odd, odd_rows, none):
    got = mixing.mix_report(odd).toPandas()
    assert len(got) == len(odd_rows) and (got.taken <= 3 * got["size"]).all()
    assert sorted(got["size"]) == sorted(len(re.findall(WORD, t or "")) for _, t, *_ in odd_rows)
    assert mixing.mix_report(none).count() == 0 and mixing.mix_texts(none).count() == 0


def test_mixed_texts_have_the_words_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts, report = mixing.mix_texts(docs), mixing.mix_report(docs).toPandas()
    assert texts.columns == docs.columns
    words = Counter()
    for r in texts.collect():
        words[r.doc_id] += len(re.findall(WORD, r.text))
        assert r.n_chars == len(r.text)
    assert all(words[r.doc_id] == r.taken for r in report.itertuples())
    slots = mixing.mix_blocks(docs).toPandas()
    assert slots.words.sum() == report.taken.sum()
    assert slots.groupby("doc_id").words.sum().to_dict() == {r.doc_id: r.taken for r in report.itertuples() if r.taken}


def test_taken_words_are_those_of_the_slots(spark):
    """The whole mix once more in plain Python: streams, blocks, quotas, permutations."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.Mix(docs)
    placed = mix.rows.toPandas().sort_values(["no", "start"])
    for _, own in placed.groupby("no"):
        assert own.start.tolist() == np.r_[0, own["size"].cumsum()[:-1]].tolist()
    uses = Counter()
    for _, no, first, n in mixing.draw_counts(mix.quota.tolist()):
        for rank in range(first, first + n):
            size = mix.blocks[no]
            key = (rank // size + 1) * 1_000_003 + no + mixing.SEED
            uses[no, int(mixing.permuted(np.array([rank % size]), np.array([size]), np.array([key]))[0])] += 1
    want = {r.key["key"]: sum(uses[r.no, w // mixing.BLOCK] for w in range(r.start, r.start + r.size)) for r in placed.itertuples()}
    assert dict(mixing.mix_report(docs).select("doc_id", "taken").toPandas().itertuples(index=False)) == want


def test_rows_that_are_equal_take_their_own_parts(spark):
    text = lambda k: " ".join(f"w{k}_{i}" for i in range(150))
    rows = [(1, text(1), "a"), (1, text(1), "a"), (2, text(2), "b"), (2, text(3), "b"), (None, text(4), None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = Counter(w for r in mixing.mix_texts(docs).collect() for w in r.text.split(" "))
    report = mixing.mix_report(docs).toPandas()
    assert sum(words.values()) == report.taken.sum() and max(words.values()) <= 6
    for k, i in ((1, 1), (4, None)):
        own = report[report.doc_id.isna() if i is None else report.doc_id == i].taken.sum()
        assert sum(n for w, n in words.items() if w.startswith(f"w{k}_")) == own


def test_long_texts_are_mixed_in_one_pass(spark):
    docs = spark.createDataFrame([(1, " ".join(["abc"] * 400_000), "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    assert sum(len(r.text.split()) for r in mixing.mix_texts(docs).collect()) == mixing.mix_report(docs).toPandas().taken.sum()
