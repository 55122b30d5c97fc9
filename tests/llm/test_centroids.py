"""Clustering with bounds against rounds without any, and the query against its SQL."""

import hashlib

import numpy as np
import pytest

from compare import duck, duck_rows, spark_rows
from factline.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, v int"


def plain(v, k, rounds, ids):
    order = sorted(range(len(v)), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), v[i].tolist()))[:k]
    c = v[order].copy()
    for n in range(rounds + 1):
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        at = d.argmin(1)
        if n < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = v[at == j].sum(0) // int((at == j).sum())
    return at, d[np.arange(len(v)), at], c


def table(spark, x, ids):
    return spark.createDataFrame([(i, [float(y) for y in row], -1, "z", 0) for i, row in zip(ids, x, strict=True)], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "k", "d", "spread"), [(400, 40, 8, 0.02), (300, 12, 3, 0.3), (200, 7, 2, 0.004), (50, 40, 64, 1.0), (5, 9, 4, 1.0), (30, 1, 4, 1.0)])
def test_equals_plain_rounds(spark, n, k, d, spread):
    r = np.random.default_rng(n)
    x = (r.normal(size=(9, d))[r.integers(0, 9, n)] + spread * r.normal(size=(n, d))).astype(np.float32)
    x[: n // 4] = x[0]  # many equal rows
    ids = list(range(n))
    at, distance, c = plain(np.floor(x.astype(float) * 256).astype(np.int64), k, 5, ids)
    found, ours = centroids.clustered(table(spark, x, ids), k=k, length=d)
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(i, int(at[i]), int(distance[i])) for i in ids]
    assert (ours == c).all()


def test_bounds_save_scans_and_never_decide():
    r = np.random.default_rng(1)
    v = r.integers(-300, 300, (2000, 16))
    c = v[:20].copy()
    cluster, distance, near, bounds, rest = centroids._scan(v, c, 5)
    for step in range(8):
        new = c + r.integers(-3, 4, c.shape)
        moved = np.sqrt(((new - c) ** 2).sum(1).astype(float))
        c = new
        keep = max(2, 5 - step)
        near, bounds, rest = centroids._kept(near, bounds, rest, keep)
        cluster, distance, near, bounds, rest, used = centroids._advance(v, c, moved, (cluster, near.copy(), bounds.copy(), rest.copy()))
        exact = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        others = np.ones(exact.shape, bool)
        others[np.arange(len(v)), cluster] = False
        np.put_along_axis(others, near, False, 1)
        assert (np.where(others, np.sqrt(exact), np.inf).min(1) >= rest).all()
        assert (np.sqrt(np.take_along_axis(exact, near, 1)) >= bounds).all()
        assert (used == 0).any()


def test_defined_cases(spark):
    good = [1.0, -0.25]
    rows = [(1, good, 0, "", 0), (1, good, 0, "", 0), (None, [0.0, 0.0], 0, "", 0), (3, None, 0, "", 0), (4, [1.0], 0, "", 0), (5, [1.0, None], 0, "", 0)]
    rows += [(6, [float("nan"), 1.0], 0, "", 0), (7, [float("inf"), 1.0], 0, "", 0), (8, [-0.001, 0.0], 0, "", 0)]
    found, c = centroids.clustered(spark.createDataFrame(rows, SCHEMA), length=2)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.distance) for r in found.collect()) == [(False, 1, 0), (False, 1, 0), (False, 8, 0), (True, 0, 0)]
    assert len(c) == 4
    assert centroids.clustered(spark.createDataFrame([], SCHEMA))[0].collect() == []
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e9, 0.0], 0, "", 0)], SCHEMA), length=2)[0].collect()


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(queries.op12_centroid_clusters(spark, sf)) == duck_rows(duck(sf), queries.oracle_sql()["op12_centroid_clusters"])
