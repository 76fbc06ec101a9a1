import numpy as np
import pytest

from paperloom.llm.neighbours import NeighbourOptions, Tree, neighbours

OPTIONS = NeighbourOptions(dim=8, leaf=20, bucket=100, calibration=64)


def frame(spark, rows):
    return spark.createDataFrame([(i, n, None if v is None else [None if x is None else float(x) for x in v], "x") for i, n, v in rows], "id string, n bigint, e array<float>, v string")


def brute(ids, x, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit[q]
    s[q] = -9
    return [ids[j] for j in np.lexsort((ids, -np.round(s, 7)))[:k]]


def test_recall_and_order(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)) + 4 * rng.normal(size=(12, 8))[rng.integers(0, 12, 900)]
    ids = np.array([f"p{i:04}" for i in range(900)])
    wanted = spark.createDataFrame([(f"p{i:04}", 10) for i in range(0, 900, 50)], "id string, k int")
    found, index = neighbours(frame(spark, zip(ids, range(900), x, strict=True)), "id", "n", "e", wanted, OPTIONS)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault(r.q, []).append(r.id)
    recall = [len(set(got[f"p{i:04}"]) & set(brute(ids, x, i, 10))) / 10 for i in range(0, 900, 50)]
    assert np.mean(recall) >= 0.9 and index.recall >= OPTIONS.recall and all(len(v) == 10 for v in got.values())
    assert index.visits < len(index.tree.leaf_of)


def test_unusable_repeated_and_tied_rows(spark):
    e = [1, 0, 0, 0, 0, 0, 0, 0]
    rows = [("a", 1, e), ("a", 2, e), ("b", 3, [2 * v for v in e]), ("c", 4, e), ("d", 5, [0] * 8), ("e", 6, e[:5]), ("f", 7, None), ("g", 8, [None] * 8), (None, 9, e), ("h", 10, [float("nan")] * 8), ("i", 11, [0, 1, 0, 0, 0, 0, 0, 0])]
    wanted = spark.createDataFrame([("a", 2), ("a", 5), ("d", 3), ("zz", 3), (None, 3), ("b", 0), ("c", None)], "id string, k int")
    found, _ = neighbours(frame(spark, rows), "id", "n", "e", wanted, OPTIONS)
    assert [(r.q, r.place, r.id, round(r.s, 6)) for r in found.orderBy("place").collect()] == [("a", 1, "b", 1.0), ("a", 2, "c", 1.0), ("a", 3, "i", 0.0)]


def test_a_leaf_of_one_vector_larger_than_a_bucket(spark):
    rows = [(f"p{i:04}", i, [1, 1, 0, 0, 0, 0, 0, 0]) for i in range(350)] + [(f"q{i:04}", i, [0, 0, 1, i, 0, 0, 0, 0]) for i in range(150)]
    found, _ = neighbours(frame(spark, rows), "id", "n", "e", spark.createDataFrame([("p0100", 4)], "id string, k int"), OPTIONS)
    assert [r.id for r in found.orderBy("place").collect()] == ["p0000", "p0001", "p0002", "p0003"]


def test_empty(spark):
    found, _ = neighbours(frame(spark, []), "id", "n", "e", spark.createDataFrame([("a", 3)], "id string, k int"), OPTIONS)
    assert found.count() == 0


def test_best_bin_first_is_complete_and_assignment_reaches_leaves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32)
    tree = Tree(x, 20, 4, 1)
    leaves = tree.assign(x)
    assert set(leaves) <= set(tree.leaf_of.values())
    assert sorted(tree.visit(x[0], 10**6)) == sorted(tree.leaf_of.values())
    near = tree.visit(x[0], 1)
    assert len(near) == 1


@pytest.mark.parametrize("n", [1, 2])
def test_tiny_collections(spark, n):
    rows = [(f"p{i}", i, [i + 1] * 8) for i in range(n)]
    found, _ = neighbours(frame(spark, rows), "id", "n", "e", spark.createDataFrame([("p0", 3)], "id string, k int"), OPTIONS)
    assert found.count() == n - 1


def test_queries_of_one_vector_are_one_search(spark):
    """A third of all rows share a vector and all of them ask: each leaves out itself only."""
    rows = [(f"p{i:03}", i, [1, 1, 0, 0, 0, 0, 0, 0]) for i in range(40)] + [(f"q{i:03}", i, [0, 0, 1, i + 1, 0, 0, 0, 0]) for i in range(80)]
    asked = spark.createDataFrame([(f"p{i:03}", 3) for i in range(40)] + [("q001", 2)], "id string, k int")
    found, _ = neighbours(frame(spark, rows), "id", "n", "e", asked, OPTIONS)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault(r.q, []).append(r.id)
    assert len(got) == 41 and len(got["q001"]) == 2
    assert all(got[f"p{i:03}"] == [f"p{j:03}" for j in range(4) if j != i][:3] for i in range(40))
