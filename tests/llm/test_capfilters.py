"""Near copies of vectors against brute force: groups, rings, cones, equal and odd vectors; and the share of links found."""

import numpy as np
import pytest

from compare import duck, duck_rows, spark_rows
from factline.llm import capfilters, queries

SCHEMA = "vec_id long, embedding array<float>, key string, node int, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "k", 1, 2) for i, x in rows], SCHEMA).repartition(4)


def brute(rows, threshold=0.95):
    """{id: (links, component)} by comparing all."""
    x = np.array([r for _, r in rows], np.float32).astype(float)
    ids = np.array([i for i, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    component = ids.copy()
    while True:
        new = np.minimum(component, np.where(linked, component[None], ids.max() + 1).min(1))
        if (new == component).all():
            break
        component = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), component, strict=True)}


def around(r, x, cosines):
    """A vector at each cosine of ``x``."""
    out = []
    for c in cosines:
        z = r.normal(size=len(x))
        z -= z @ x * x
        out.append(c * x + np.sqrt(max(0, 1 - c * c)) * z / np.linalg.norm(z))
    return out


def unit(r, d):
    x = r.normal(size=d)
    return x / np.linalg.norm(x)


def made(r, d):
    """Groups tight and loose, equal rows, chains, and vectors in a cone."""
    vectors = [unit(r, d) for _ in range(200)]
    tight, loose = unit(r, d), unit(r, d)
    vectors += around(r, tight, r.uniform(0.99, 1, 120)) + around(r, loose, r.uniform(0.955, 0.99, 120))
    vectors += [tight] * 30 + [3 * loose] * 5
    step = unit(r, d)
    for _ in range(20):
        step = around(r, step, [0.96])[0]
        vectors.append(step)
    return vectors


@pytest.mark.parametrize("d", [64, 24])
def test_against_brute_force(spark, d):
    r = np.random.default_rng(d)
    vectors = made(r, d)
    rows = list(zip(r.permutation(len(vectors)).tolist(), vectors, strict=True))
    found = {x.vec_id: x for x in capfilters.near_duplicates(table(spark, rows)).collect()}
    wanted = brute(rows)
    assert {i: (x.n_links, x.component_id) for i, x in found.items()} == wanted
    assert all(x.kept == (i == x.component_id) for i, x in found.items())


def test_filters_of_many_cells_and_open_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", 4)
    monkeypatch.setattr(capfilters, "MEMBERS", 16)
    r = np.random.default_rng(3)
    cone = unit(r, 16)
    vectors = around(r, cone, r.uniform(0.9, 1, 260)) + around(r, unit(r, 16), r.uniform(0.97, 1, 60))
    rows = list(enumerate(vectors))
    found = {x.vec_id: (x.n_links, x.component_id) for x in capfilters.near_duplicates(table(spark, rows)).collect()}
    wanted = brute(rows)
    assert sum(n for n, _ in found.values()) >= 0.999 * sum(n for n, _ in wanted.values())
    assert all(found[i][0] <= wanted[i][0] for i in found)


@pytest.mark.parametrize(("cosine", "least"), [(0.9502, 0.995), (0.97, 0.999)])
def test_share_of_pairs_that_share_a_filter(cosine, least):
    r = np.random.default_rng(8)
    n, side = 1500, 8 * int(np.sqrt(50_000))
    x = np.array([unit(r, 64) for _ in range(n)])
    y = np.array([around(r, v, [cosine])[0] for v in x])
    missing = np.ones(n, bool)
    for number in range(capfilters.CODES):
        rotation, halves, threshold = capfilters._code(64, side, number)
        p, q = capfilters._scores(x, rotation, halves), capfilters._scores(y, rotation, halves)
        mine, theirs = (set(zip(*(c.tolist() for c in capfilters._decoded(*s, threshold)), strict=True)) for s in (p, q))
        assert min(np.bincount([i for i, _ in mine])) >= capfilters.LISTED
        for i, _ in mine & theirs:
            missing[i] = False
    assert 1 - missing.mean() >= least


def test_a_vector_is_listed_under_all_filters_beyond_its_level():
    r = np.random.default_rng(2)
    for _ in range(50):
        first, second = r.normal(size=40), r.normal(size=40)
        sums = (first[:, None] + second[None]).ravel()
        for threshold in (2.0, 9.0):
            level = min(threshold, np.sort(sums)[::-1][capfilters.LISTED - 1])
            row, found = capfilters._decoded(first[None], second[None], threshold)
            assert not row.any() and sorted(found.tolist()) == np.flatnonzero(sums >= level).tolist()


def test_defined_cases(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, []), (6, [2.0, 0.0]), (7, [1.0, 0.01]), (7, [1.0, 0.01])]
    rows += [(None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [5.0]), (10, [0.5]), (11, [-1.0]), (12, [1e-38, 0.0])]
    found = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in capfilters.near_duplicates(table(spark, rows)).collect()), key=repr)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 8, 11)]
    assert found == sorted([*alone, (6, 3, 6, True), (7, 3, 6, False), (7, 3, 6, False), (12, 3, 6, False), (9, 1, 9, True), (10, 1, 9, False), (None, 0, None, False)], key=repr)
    assert capfilters.near_duplicates(table(spark, [])).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(queries.op13_embedding_near_copies(spark, sf)) == duck_rows(duck(sf), queries.OP13_SQL)
