"""Training of op8 reads every token of every training document."""

import numpy as np

from lodestone.llm import recurrent, scoring


def test_every_word_is_learnt_from(spark, monkeypatch):
    first = recurrent.Gru.fresh

    def awake(mass):
        m = first(mass)
        m.wc[:] = 0.1 * np.random.default_rng(5).standard_normal(m.wc.shape)  # at 0, the first window moves no row
        return m

    monkeypatch.setattr(recurrent.Gru, "fresh", awake)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(n))) for k, n in enumerate([300, 1, 90, 0, 17, 400])] + [(None, "lone words"), (9, None)]
    training = scoring.prepared(spark.createDataFrame(rows, "doc_id long, text string"), "text", "doc_id").repartition(2)
    vocab = spark.sparkContext.broadcast(scoring.vocabulary(scoring.count_tokens(training)))
    v = vocab.value
    assert v.n == 300 + 1 + 90 + 17 + 400 + 2 + len(rows) and v.v == 300 + 1 + 90 + 17 + 400 + 2 + 1
    moved = (np.abs(scoring.fit(training, vocab).x - awake(v.mass()).x) > 1e-5).any(axis=1)  # averages round
    assert moved[v.number].all() and moved.sum() == v.v  # each word's row has been read; no other has


def test_each_document_is_in_one_round_with_all_its_tokens(spark, odd):
    training = scoring.prepared(odd, "text", "doc_id")
    vocab = spark.sparkContext.broadcast(scoring.vocabulary(scoring.count_tokens(training)))
    dealt = scoring.coded(training.repartition(3), vocab, 3, 4).toPandas()
    want = []
    for r in training.collect():
        w, _ = scoring.tokens(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))
        want.append(vocab.value.numbers(w).astype("<u2").tobytes())
    assert sorted(map(bytes, dealt.ids)) == sorted(want)
    assert set(dealt.turn) == {0, 1, 2} and set(dealt.replica) == {0, 1, 2, 3}


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = [scoring.score_documents(d).toPandas().set_index("doc_id").score.sort_index() for d in (docs, docs.repartition(7))]
    assert np.allclose(*scores, rtol=1e-3)


def test_replicas_are_averaged_by_words(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = scoring.prepared(docs, "text", "doc_id").filter("not held_out")
    vocab = spark.sparkContext.broadcast(scoring.vocabulary(scoring.count_tokens(training)))
    got = scoring.fit(training, vocab, rounds=1, replica_words=20_000)
    replicas = -(-vocab.value.n // 20_000)
    rows = sorted(scoring.coded(training, vocab, 1, replicas).collect(), key=lambda r: (r.h, r.ids))
    total, n = 0.0, 0
    for k in range(replicas):
        own = [np.frombuffer(r.ids, "<u2").astype(np.int32) for r in rows if r.replica == k]
        model = recurrent.Gru.fresh(vocab.value.mass())
        ids = np.concatenate(own)
        model.train(ids, np.r_[0, np.cumsum([len(x) for x in own])], int(vocab.value.numbers(np.array([scoring.END]))[0]), recurrent.Adam(len(model.w)), recurrent.lanes_for(len(ids)))
        total, n = total + len(ids) * model.w.astype(float), n + len(ids)
    assert replicas > 2 and np.allclose(got.w, total / n, atol=1e-5)


def test_scores_are_those_of_a_plain_scorer(spark, odd, odd_rows, monkeypatch):
    """Token by token: a step of the network, then class, number in the class, and the word's share of its bucket."""
    fits = []
    fit = scoring.fit
    monkeypatch.setattr(scoring, "fit", lambda training, vocab: fits.append((fit(training, vocab), vocab.value)) or fits[-1][0])
    monkeypatch.setattr(scoring, "HEAD", 300)  # most words are looked up in the counts
    got = {}
    for r in scoring.score_documents(odd).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    model, v = fits[0]
    counts = {int(np.int64(r.w)): r.c for r in scoring.count_tokens(scoring.prepared(odd, "text", "doc_id").filter("not held_out")).collect()}
    mass = v.mass()
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = {}
    for i, text, *_ in odd_rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w, _ = scoring.tokens(data, np.array([0, len(data)]))
        h, last, total = np.zeros(recurrent.HIDDEN), int(v.numbers(np.array([scoring.END]))[0]), 0.0
        size = recurrent.HIDDEN
        for token, number in zip(w, v.numbers(w)):
            x, a = model.x[last].astype(float) + model.b, h @ model.u.astype(float)
            z, r = sig(x[:size] + a[:size]), sig(x[size : 2 * size] + a[size : 2 * size])
            n = np.tanh(x[2 * size :] + r * a[2 * size :])
            h = n + z * (h - n)
            c, slot = divmod(int(number), recurrent.SLOTS)
            for logits, k in ((h @ model.wc + model.bc, c), (h @ model.wm[c] + model.bm[c], slot)):
                total += (logits[k] - np.log(np.exp(logits).sum())) / np.log(10)
            if number < scoring.BUCKETS:
                total += np.log10(v.base(counts.get(int(token.view(np.int64)), 0)) / mass[number])
            last = int(number)
        want.setdefault(i, []).append(total)
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(sorted(got[i]), sorted(want[i]), rtol=1e-3, atol=1e-3)


def test_the_head_is_never_empty(spark, monkeypatch):
    """More words of one count than the head holds: a share of them, by hash, and always the end."""
    monkeypatch.setattr(scoring, "HEAD", 50)
    counts = spark.createDataFrame([(k * 7919 << 7, 1) for k in range(1, 400)] + [(int(scoring.END), 1)], "w long, c long")
    v = scoring.vocabulary(counts)
    assert 20 < len(v.w) < 90 and v.numbers(np.array([scoring.END]))[0] == scoring.BUCKETS
    mass = v.mass()
    assert abs(mass.sum() - (v.n + 0.1 * (v.v + scoring.BUCKETS)) / (v.n + 0.1 * (v.v + 1))) < 1e-9


def test_long_texts_are_learnt_in_parts_each_word_once(monkeypatch):
    monkeypatch.setattr(recurrent, "PART", 10)
    monkeypatch.setattr(recurrent, "WARM", 4)
    ids, at = np.arange(100, 145, dtype=np.int32), np.array([0, 7, 7, 40, 45])
    own, own_at, first, learn = recurrent.parted(ids, at, 3)
    assert own[learn].tolist() == ids.tolist()
    assert first.tolist() == [3, 3, 112, 122, 132, 3] and np.diff(own_at).tolist() == [7, 10, 14, 14, 7, 5]
    word, text, counts = recurrent.matrices(own, own_at, 3, learn)
    assert sorted(word[counts].tolist()) == ids.tolist()
