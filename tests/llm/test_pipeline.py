"""Each stage of the pipeline, on its own input, against plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from lodestone.llm import mixing
from lodestone.llm.queries import tokenizer
from tests.llm.test_pieces_jaccard import brute_classes
from tests.llm.test_repeats import windows_gone
from tests.llm.test_rules_shards_mixing import WORD, brute_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """documents and what each stage makes of it, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_dedup", "mixing", "sentencepiece"]


def test_rules(steps):
    assert set(steps[1].doc_id) == {r.doc_id for r in steps[0].itertuples() if brute_quality(r.text)[-1]}
    assert list(steps[1].columns) == list(steps[0].columns)


def test_one_of_each_group(steps):
    classes = brute_classes(list(steps[1][["doc_id", "text"]].itertuples(index=False, name=None)))
    assert set(steps[2].doc_id) == {c for _, c, _, _ in classes}


def test_repeats_go(steps):
    rows = list(steps[2].itertuples())
    want = {}
    for r, gone in zip(rows, windows_gone([r.text.encode() for r in rows], 200)):
        want[r.doc_id] = bytes(x for x, g in zip(r.text.encode(), gone) if not g).decode("utf-8", "ignore")
    assert dict(steps[3][["doc_id", "text"]].itertuples(index=False, name=None)) == want


def test_mixture(steps):
    before, after = steps[3], steps[4]
    words = lambda t: len(re.findall(WORD, t))
    size, taken = Counter(), Counter()
    for r in before.itertuples():
        size[r.source] += words(r.text)
    for r in after.itertuples():
        taken[r.source] += words(r.text)
    names = sorted(size)
    for n, goal in zip(names, mixing.targets([size[n] for n in names])):
        assert abs(taken[n] - goal) <= 64
    assert list(after.columns) == list(before.columns) and after.groupby("doc_id").size().max() <= 3


def test_ids(steps):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer(corpus_pipeline.MODEL))
    want = sorted((r.doc_id, library.encode(r.text, add_bos=True, add_eos=True)) for r in steps[4].itertuples())
    assert sorted((r.doc_id, list(r.ids)) for r in steps[5].itertuples()) == want
    assert (steps[5].n_tokens == steps[5].ids.map(len)).all()


def test_run_gives_the_same_rows(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    order = lambda x: sorted((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in x.itertuples())
    assert order(got) == order(steps[5])


# -- each stage on null, empty, repeated and long rows, with columns whose names operators use


def as_rows(df, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_rules_on_odd_rows(spark, odd):
    got = corpus_pipeline.quality_rules(spark, odd, SF)
    assert as_rows(got, odd.columns) == sorted(repr(tuple(r)) for r in odd.collect() if brute_quality(r.text)[-1])


def test_one_of_each_group_on_odd_rows(spark, odd, odd_rows):
    got = corpus_pipeline.jaccard_join(spark, odd, SF)
    assert got.columns == odd.columns
    classes = {}
    for (i, c, _, _), t in zip(brute_classes([(i, t) for i, t, *_ in odd_rows]), sorted_texts(odd_rows)):
        classes.setdefault(c if c is not None else ("none", t), []).append(i)
    assert sorted(map(repr, (r.doc_id for r in got.collect()))) == sorted(repr(min((i for i in ids if i is not None), default=None)) for ids in classes.values())


def sorted_texts(rows):
    """The texts in the order in which brute_classes gives its rows."""
    return [t for t in sorted({t or "" for _, t, *_ in rows}) for _, x, *_ in rows if (x or "") == t]


def test_repeats_go_on_odd_rows(spark, odd):
    before = odd.collect()
    want = []
    for r, gone in zip(before, windows_gone([(r.text or "").encode() for r in before], 200)):
        text = bytes(x for x, g in zip((r.text or "").encode(), gone) if not g).decode("utf-8", "ignore")
        want.append(repr((r.doc_id, text, r.lang, r.source, len(text), r.h, r["size"], r.node, r._key, r._row, r.spans)))
    assert as_rows(corpus_pipeline.suffix_dedup(spark, odd, SF), odd.columns) == sorted(want)


def test_mixture_on_odd_rows(spark, odd):
    size, taken, before = Counter(), Counter(), odd.collect()
    for r in before:
        size[r.source] += len(re.findall(WORD, r.text or ""))
    after = corpus_pipeline.mixing(spark, odd, SF)
    assert after.columns == odd.columns
    for r in after.collect():
        taken[r.source] += len(re.findall(WORD, r.text))
        assert r.n_chars == len(r.text) and r["size"] == 1
    names = sorted(size, key=lambda x: (x is None, x or ""))
    for n, goal in zip(names, mixing.targets([size[n] for n in names])):
        assert abs(taken[n] - goal) <= 64


def test_ids_on_odd_rows(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer(corpus_pipeline.MODEL))
    want = sorted(repr((r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True))) for r in odd.collect())
    assert as_rows(corpus_pipeline.sentencepiece(spark, odd, SF), ["doc_id", "ids"]) == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, none, name, stage):
    got = stage(spark, none, SF)
    assert got.count() == 0 and ("n_tokens" if name == "sentencepiece" else "n_chars") in got.columns
