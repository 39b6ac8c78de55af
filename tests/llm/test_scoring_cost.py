"""What keeps the CPU time of op8 within its budget, and that the results stay those of plain sums."""

import numpy as np

from lodestone.llm import recurrent


def model():
    return recurrent.Gru.fresh(np.full(recurrent.CLASSES * recurrent.SLOTS, 1 / (recurrent.CLASSES * recurrent.SLOTS)))


def test_few_lanes_are_scored_in_few_windows(monkeypatch):
    """Two long texts, so two lanes: windows of SCORE_STEPS steps would hold 128 words each."""
    m, calls = model(), []
    m.w += np.random.default_rng(0).standard_normal(len(m.w)).astype(np.float32) * 0.2
    ids, at = np.random.default_rng(1).integers(0, recurrent.CLASSES * recurrent.SLOTS, 4000).astype(np.int32), np.array([0, 2000, 4000])
    outputs = recurrent.Gru.outputs
    monkeypatch.setattr(recurrent.Gru, "outputs", lambda self, states, word, grad=None: calls.append(len(word)) or outputs(self, states, word, grad))
    got = m.score(ids, at, 3)
    assert sum(calls) == 4000 and len(calls) <= 4
    monkeypatch.setattr(recurrent, "SCORE_LANES", 1)  # windows as short as they were
    assert np.allclose(got, m.score(ids, at, 3), rtol=1e-5) and len(calls) > 30


def test_sums_by_number_are_those_of_a_loop():
    rng = np.random.default_rng(2)
    number = np.r_[rng.integers(0, 1600, 900), np.full(777, 5), 1599]
    rows = rng.standard_normal((len(number), 96)).astype(np.float32)
    some, sums = recurrent.sums_by(number, rows)
    assert some.tolist() == sorted(set(number.tolist()))
    for k, s in zip(some, sums):
        assert np.allclose(s, rows[number == k].astype(float).sum(axis=0), atol=1e-3)


def test_words_that_do_not_count_have_no_part_in_outputs():
    m, rng = model(), np.random.default_rng(3)
    states, word = rng.standard_normal((3000, recurrent.HIDDEN)).astype(np.float32), rng.integers(0, recurrent.CLASSES * recurrent.SLOTS, 3000)
    m.w += rng.standard_normal(len(m.w)).astype(np.float32) * 0.2
    counts = rng.random(3000) < 0.7
    one, two = recurrent.Gru(np.zeros_like(m.w)), recurrent.Gru(np.zeros_like(m.w))
    logp, back = m.outputs(states, np.where(counts, word, -1), one)
    want, want_back = m.outputs(states[counts], word[counts], two)
    assert not logp[~counts].any() and not back[~counts].any()
    assert np.allclose(logp[counts], want, atol=1e-4) and np.allclose(back[counts], want_back, atol=1e-4) and np.allclose(one.w, two.w, atol=1e-2)


def test_gates_far_out_reach_their_limits():
    """exp overflows there: a gate is 0 or 1 and the candidate -1 or 1, never nan."""
    m = model()
    x = np.zeros((2, 3 * recurrent.HIDDEN), np.float32)
    x[0], x[1] = -1000, 1000
    with np.errstate(over="ignore"):
        new = m.step(np.full((2, recurrent.HIDDEN), 0.5, np.float32), x)[0]
    assert np.allclose(new[0], -1) and np.allclose(new[1], 0.5)
