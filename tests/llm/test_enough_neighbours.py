"""op9 goes on past the calibrated number of leaves until a query has its 20 rows."""

import numpy as np

from lodestone.llm import neighbours


def test_small_leaves_do_not_cut_the_answer(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 8))
    rows = [(i, (centres[i % 60] + 1e-3 * rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [(0, rows[0][1])] * 30  # an id of 31 rows, none of them its own candidate
    index = neighbours.Index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert index.tree.leaves > 4
    index.limit = 1
    got = index.search(neighbours.F.col("vid") % 3 == 0).toPandas()
    n = got.groupby("query_id").size()
    assert set(n.index) == set(range(0, 300, 3)) and (n == 20).all()
    assert (got.query_id != got.vec_id).all()


def test_all_leaves_where_candidates_are_few():
    rng = np.random.default_rng(1)
    tree = neighbours.Tree(rng.standard_normal((60, 3)), leaf=5)
    q = rng.standard_normal((4, 3))
    sizes = np.ones(tree.leaves, np.int64)
    few = tree.visits(q, 2, sizes, np.array([0, 5, tree.leaves, 10**6]))
    assert [len(x) for x in few] == [2, 5, tree.leaves, tree.leaves]
    assert [x[:2] for x in few] == tree.visits(q, 2)


def test_rows_of_one_id_are_one_query(spark):
    """The 20 best rows over both vectors of the query, each once, though there are ids with two rows among the candidates."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(6).tolist()) for i in [0, 0, *range(1, 60), 7, 8]]
    rows[-1] = (8, rows[9][1])  # equal to the other row of its id
    got = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for query in (0, 20, 40):
        score = np.max([(x * q).sum(axis=1) for q in x[ids == query]], axis=0)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != query][:20]
        own = got[got.query_id == query].sort_values("rank")
        assert own.vec_id.tolist() == ids[order].tolist() and own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own.score, score[order])
