import numpy as np
import pytest

from tillcast.llm.ann import Index, fit, neighbours


def brute(rows, k, every):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for i, v in rows:
        if i % every == 0:
            far = sorted((float(np.sqrt(((np.array(w, np.float32).astype(float) - np.array(v, np.float32).astype(float)) ** 2).sum())), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, d) for d, j in far]
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v int")


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    good = [(i, [float(x) for x in draw.normal(size=4).astype(np.float32)]) for i in range(60)]
    good += [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)] + [(100, [1.0, 1.0, 1.0, 1.0])]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows = neighbours(table(spark, [(i, v, 0, 0) for i, v in good + bad]), 10, 10).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(good, 10, 10)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, None), (100, [1.0, 2.0]), (200, [1.0, 2.5])]])
def test_few_candidates(spark, rows):
    found = neighbours(table(spark, [(i, v, 0, 0) for i, v in rows])).collect()
    assert len(found) == (2 if len(rows) == 3 else 0)


def test_recall_on_a_deep_tree_with_hot_leaf(spark):
    draw = np.random.default_rng(2)
    points = draw.normal(size=(3000, 16)).astype(np.float32)
    points[::3] = points[0] + draw.normal(size=(1000, 16)).astype(np.float32) * 0.01  # a third in one place
    rows = [(i, [float(x) for x in p], 0, 0) for i, p in enumerate(points)]
    index = Index(table(spark, rows), k=10, leaf_rows=32, sample_rows=1000)
    assert index.tree.leaves > 20 and index.recall >= 0.97 and index.visits < index.tree.leaves
    found = index.search(index.vectors.where("vec_id % 50 = 0"), group_rows=64).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    wide = points.astype(float)
    for q in range(0, 3000, 50):
        d = ((wide - wide[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & got[q])
    assert hits / (60 * 10) >= 0.9


def test_tree_of_equal_points_is_one_leaf():
    tree = fit(np.ones((50, 3)), 10)
    assert tree.leaves >= 1 and len(set(tree.assign(np.ones((5, 3))).tolist())) == 1
    assert sorted(tree.visit(np.ones(3), 99)) == sorted(i for i, c in enumerate(tree.children) if not len(c))
