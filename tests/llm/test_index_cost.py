"""What keeps the CPU time of op2's index within its budget, and that the orders stay those of plain sorts."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import suffixes


def test_the_index_sorts_packed_numbers(monkeypatch):
    """Positions are sorted by keys of one byte only, the shards' numbers, and nothing as long as the text is made unique."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, 300).astype(np.uint8)
    body = pa.array([base[a : a + 260].tobytes() for a in rng.integers(0, 40, 120)], pa.binary())
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 1 << 12)
    want, bytes_sorted, sorts, uniques, argsort, unique = suffixes.index(body, np.ones(120, int))[0], [], [], [], np.argsort, np.unique
    monkeypatch.setattr(np, "argsort", lambda a, **b: bytes_sorted.append(a.dtype.itemsize) or argsort(a, **b))
    monkeypatch.setattr(np, "unique", lambda a, **b: uniques.append(len(a)) or unique(a, **b))
    monkeypatch.setattr(np, "lexsort", lambda keys: pytest.fail("positions sorted by wide keys"))
    assert (suffixes.index(body, np.ones(120, int))[0] == want).all() and want.any()
    assert set(bytes_sorted) == {1} and max(uniques) < 120


@pytest.mark.parametrize(
    "keys",
    [
        [np.random.default_rng(1).integers(0, 9, 500)],
        [np.random.default_rng(2).integers(0, 1 << 40, 500), np.random.default_rng(3).integers(0, 3, 500)],
        [np.random.default_rng(4).integers(0, 1 << 64, 400, dtype=np.uint64).repeat(2)],  # wider than 64 bits with the position
        [np.array([5, 4, 4, 5, 7, 4] * 50, np.uint64) | np.uint64(1 << 63)],  # and equal but for the bits left out
        [np.array([3, 1 << 40, 3] * 30), np.array([1, 0, 1 << 40] * 30)],  # wider than 64 bits without it
        [np.zeros(7, np.int64)],
        [np.array([0])],
        [np.zeros(0, np.int64), np.zeros(0, np.int64)],
    ],
)
def test_packed_orders_are_those_of_plain_sorts(keys):
    rows = list(zip(*(k.tolist() for k in keys)))
    want = sorted(range(len(rows)), key=rows.__getitem__)
    order, new = suffixes.ordered(*keys)
    assert order.tolist() == want
    assert new.tolist() == [not i or rows[a] != rows[want[i - 1]] for i, a in enumerate(want)]
    assert suffixes.dense(*keys).tolist() == [sorted(set(rows)).index(r) for r in rows]


@pytest.mark.parametrize("step", [1, 4, 40])
def test_a_transform_is_that_of_its_strings(step):
    """Strings of every phase, also where a run is shorter than a step."""
    rng = np.random.default_rng(step)
    string = np.repeat(np.arange(9), [1, 3, 90, 41, 2, 40, 130, 39, 7])
    symbols = rng.integers(1, 3, len(string))
    chains = [np.flatnonzero(string == k)[phase::step].tolist() for k in range(9) for phase in range(min(step, (string == k).sum()))]
    suffix = sorted(((symbols[c[i:]].tolist(), k, c[i], symbols[c[i - 1]] if i else 0) for k, c in enumerate(chains) for i in range(len(c))), key=lambda x: x[:2])
    got = suffixes.Transform(symbols, string, step)
    assert got.strings == len(chains)
    assert got.suffix.tolist() == [-1] * len(chains) + [x[2] for x in suffix]
    assert got.bwt.tolist() == [symbols[c[-1]] for c in chains] + [x[3] for x in suffix]
