"""Nearest rows against all pairs, and the sizes that all pairs did not reach."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright.operators import graph, imputers, neighbours


def frame(spark, ids, x, mask):
    rows = [(int(i), [float(v) for v in a], [bool(v) for v in m]) for i, a, m in zip(ids, x, mask, strict=True)]
    return spark.createDataFrame(rows, "id long, x array<double>, mask array<boolean>")


def all_pairs(x, mask, either):
    have = ~mask
    both = have[:, None, :] & have[None, :, :]
    used = (have[:, None, :] | have[None, :, :] if either else both).sum(axis=2)
    squares = np.where(both, (x[:, None, :] - x[None, :, :]) ** 2, 0.0).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(used > 0, np.sqrt(squares * x.shape[1] / used), np.inf)


@pytest.mark.parametrize("dims, either", [(3, True), (3, False), (20, True)])
def test_search_equals_all_pairs(spark, monkeypatch, dims, either):
    monkeypatch.setattr(neighbours, "PATTERNS", 3)
    monkeypatch.setattr(neighbours, "SAMPLE", 120)
    monkeypatch.setattr(neighbours, "ASKING", 25)
    rng = np.random.default_rng(dims + either)
    n, k = 400, 5
    x = np.where(rng.random((n, dims)) < 0.5, rng.integers(0, 3, (n, dims)), np.round(rng.normal(0, 2, (n, dims)), 1))
    mask = rng.random((n, dims)) < (0.25 if dims == 3 else 0.02)
    x[300:340], mask[300:340] = x[0], mask[0]  # more copies than k
    ids = rng.permutation(n) * 7
    points, members = neighbours.distinct_points(frame(spark, ids, x, mask), k)
    found = members.join(neighbours.search(points, points, k, either=either, block=16), "point").select("id", "near", "dist").collect()
    want, dist = set(), np.round(all_pairs(x, mask, either), 9)
    for i in range(n):
        order = [j for j in np.lexsort((ids, dist[i]))[:k] if np.isfinite(dist[i, j])]
        want |= {(int(ids[i]), int(ids[j]), float(dist[i, j])) for j in order}
    assert {(r.id, r.near, r.dist) for r in found} == want and len(found) == len(want)


def test_rows_of_one_value_link_to_the_smallest_other_ids(spark):
    nodes = spark.range(9).select("id", F.array(F.lit(1.0)).alias("features"), F.array(F.col("id") > 6).alias("mask"))
    got = {}
    for r in graph.nearest(nodes, "id", 2).collect():
        got.setdefault(r.src, set()).add(r.dst)
    # the two without any value are at distance 0 from those with one, and infinitely far from each other
    assert got == {i: set([j for j in range(7) if j != i][:2]) for i in range(9)}


def test_many_rows(spark):
    """All pairs of 150,000 rows took minutes."""
    x = [F.pmod(F.xxhash64("id", F.lit(c)), F.lit(m)).cast("double") for c, m in ((1, 5), (2, 25), (3, 4000))]
    nodes = spark.range(150_000).select("id", F.array(*x).alias("features"), F.array(*(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10)) == 0 for c in (4, 5, 6))).alias("mask"))
    began = time.time()
    assert graph.nearest(nodes, "id", 5).count() == 750_000
    assert time.time() - began < 90


def test_impute_knn_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKING", 30)
    rng = np.random.default_rng(4)
    n, k = 300, 3
    x = np.column_stack([rng.integers(0, 4, n), np.round(rng.normal(0, 3, n), 1), rng.integers(0, 3, n)]).astype(float)
    x[200:] = x[:100]
    gone = rng.random((n, 3)) < 0.2
    dist, want = all_pairs(x, gone, False), x.copy()
    for i, c in zip(*np.nonzero(gone), strict=True):
        order = [j for j in np.lexsort((np.arange(n), dist[i])) if j != i and not gone[j, c] and np.isfinite(dist[i, j])][:k]
        d = dist[i, order]
        w = (d == 0).astype(float) if len(d) and d[0] == 0 else 1 / d
        want[i, c] = (w * x[order, c]).sum() / w.sum() if len(d) else np.nan
    rows = [(i, *(None if g else float(v) for v, g in zip(x[i], gone[i], strict=True))) for i in range(n)]
    got = imputers.impute_knn(spark.createDataFrame(rows, "id long, a double, b double, c double"), "id", [], ["a", "b", "c"], k=k, block=16).orderBy("id").collect()
    want = np.where(np.isnan(want), np.nanmedian(want, axis=0), want)
    found = np.array([[r.a, r.b, r.c] for r in got])
    assert np.allclose(found, want), [(i, x[i], gone[i], found[i], want[i]) for i in np.flatnonzero(~np.isclose(found, want).all(axis=1))]


def test_impute_knn_of_many_rows(spark):
    """Blocks of 120,000 rows were all compared with one another, each row written some hundred times."""
    x = [F.when(F.pmod(F.xxhash64("id", F.lit(c + 9)), F.lit(10)) > 0, F.pmod(F.xxhash64("id", F.lit(c)), F.lit(m)).cast("double")).alias(f"x{c}") for c, m in ((1, 6), (2, 50), (3, 100))]
    began = time.time()
    full = imputers.impute_knn(spark.range(120_000).select("id", *x), "id", [], ["x1", "x2", "x3"])
    assert full.dropna().count() == 120_000
    assert time.time() - began < 90


def test_similar_rows_of_copies_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(imputers, "STEP", 16)
    rng = np.random.default_rng(6)
    kinds, n, k = 60, 400, 7
    v = rng.integers(-2, 3, (kinds, 4)).astype(float)  # many ties
    of, ids = np.minimum(rng.geometric(0.08, n), kinds) - 1, rng.permutation(n) * 3
    rows = spark.createDataFrame([(int(i), [str(c)], True) for i, c in zip(ids, of, strict=True)], "id long, cells array<string>, own boolean")
    groups = imputers.grouped_rows(rows, k).cache()
    vectors = imputers.embedded_rows(groups, lambda texts: v[[int(t) for t in texts]])
    assert vectors.count() == len(set(of))
    found = {}
    for r in imputers.similar_rows(vectors, groups, groups.where("g % 2 = 0"), k, block=13).collect():
        found.setdefault(r.ask, []).append((r.place, r.id, r.sim))
    least = {c: ids[of == c].min() for c in set(of)}
    assert set(found) == {g for g in least.values() if g % 2 == 0}
    for c, g in least.items():
        if g % 2 == 0:
            sims = v[of] @ v[c]
            order = np.lexsort((ids, -sims))[:k]
            assert sorted(found[g]) == [(p + 1, ids[j], sims[j]) for p, j in enumerate(order)]


def test_a_row_does_not_count_itself_among_the_similar(spark):
    """With k = 3, each copy meets the two others and the row that has a value, the fourth in its order."""
    rows = [(1, None, 5.0), (2, None, 5.0), (3, None, 5.0), (4, "a", 5.0)]
    full = imputers.impute_semantic(spark.createDataFrame(rows, "id long, c string, x double"), "id", ["c"], ["x"], lambda texts: np.ones((len(texts), 1)), k=3, local=1)
    assert [r.c for r in full.orderBy("id").collect()] == ["a"] * 4


def test_an_asking_row_tells_its_most_similar_once(spark):
    """Each pair of blocks told the k nearest of its own."""
    rng = np.random.default_rng(8)
    n, k = 500, 4
    v = rng.normal(0, 1, (n, 8)) * rng.choice([1e-3, 1.0, 1e4], (n, 1))
    v[400:] = v[:100] + 1e-7 * rng.normal(0, 1, (100, 8))  # single precision does not tell these apart
    rows = [(i, 1, i % 3 == 0, bytearray(v[i].tobytes())) for i in range(n)]
    packed = imputers.packed_vectors(spark.createDataFrame(rows, "g long, n long, ask boolean, v binary"), 16)
    assert packed.count() > 30
    found = {}
    for r in imputers.similar_groups(packed, k, block=40).collect():
        found.setdefault(r.ask, []).append(r.near)
    assert {g: sorted(near) for g, near in found.items()} == {i: sorted(np.lexsort((np.arange(n), -np.round(v @ v[i], 9)))[:k].tolist()) for i in range(0, n, 3)}


def test_some_rows_ask_among_all(spark, monkeypatch):
    """All rows were searched and the links of some of them kept."""
    rng = np.random.default_rng(9)
    x, mask = np.round(rng.normal(0, 1, (200, 3)), 1), rng.random((200, 3)) < 0.2
    nodes = frame(spark, range(200), x, mask).withColumnRenamed("x", "features")
    links = lambda df: {tuple(r) for r in df.collect()}
    want = links(graph.nearest(nodes, "id", 5, block=16).where("src < 7"))
    searched, search = [], neighbours.search
    monkeypatch.setattr(neighbours, "search", lambda asks, *a, **b: (searched.append(asks.count()), search(asks, *a, **b))[1])
    assert links(graph.nearest(nodes, "id", 5, block=16, asked="id < 7")) == want and len(want) == 35
    assert searched[0] <= 7
