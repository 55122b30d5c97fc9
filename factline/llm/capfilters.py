"""Near copies of vectors by cosine: spherical-cap filters from structured random product codes, joined and verified.

**Filters.** A code rotates the space at random and splits it in two halves, each with its own random directions; every pair of
a direction of each half is a filter, so ``SIDE`` directions a half make ``SIDE``² filters, of which those that a vector exceeds are
listed without looking at the others. A vector is listed under all filters with an inner product beyond the code's threshold, and
where fewer than ``LISTED`` are, the threshold gives way until so many are. ``CODES`` codes are independent. The number of filters
grows with the number of vectors, so that unlike vectors seldom share one; which vectors share one depends on their angle
alone, whatever the data look like. A pair at exactly 0.95 shares none of the filters with a probability of about 1e-4 at 50,000
vectors, a closer one less (measured in the tests).

**Groups.** Equal vectors are one node with a weight. Each filter's least node is a leader; a node within half of the threshold's
angle of a leader belongs to its cell, so that all pairs within a cell are links that nothing has to look at. A large group of near copies
is a cell or a few, and goes through every step as a single row.

**Links.** Cells that share a filter are compared: each member of the smaller one with the leader of the larger. By the larger
one's radius that links it with all members, or none, or leaves it open; open ones are compared with the members in blocks of
bounded size, and only counts leave a block. A filter with very many cells is dealt as pairs of bounded blocks, from which only pairs
within reach are written. Every pair is verified or certified by the triangle inequality with a margin, so no link is below the
threshold, and nothing is capped.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and are their own
component, as are vectors of unlike length to each other; rows with a null id link with nothing, have a null component and aren't kept; repeated
rows link with each other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import save, scratch
from factline.llm.components import components

THRESHOLD = 0.95
CODES = 4
LISTED = 8
#: Directions of a half at most: the codes are in every worker's memory. Beyond, filters hold more vectors each.
MOST_SIDE = 1 << 15
#: Cells of a filter that are paired directly; more are dealt in blocks of so many.
BLOCK = 64
#: Members and candidates of a cell that are compared in one block.
MEMBERS = 512
#: Angles are computed to within this.
MARGIN = 1e-6


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; none where one takes no part."""
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    if len(sizes) and sizes[0] > 0 and (sizes == sizes[0]).all() and not flat.null_count:
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
        takes = np.isfinite(x).all(1) & x.any(1)
        return [v if t else None for v, t in zip(x, takes.tolist(), strict=True)]
    whole = [None if row is None or any(c is None for c in row) else np.array(row, np.float64) for row in column.to_pylist()]
    return [x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None for x in whole]


def _unit(x: np.ndarray | None) -> np.ndarray | None:
    if x is None:
        return None
    x = x / np.abs(x).max()
    return x / math.sqrt(float(x @ x))


def _units(column: pa.Array | list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; none where a vector takes no part."""
    return [_unit(x) for x in _rows(column if isinstance(column, pa.Array) else pa.array(column))]


@lru_cache(maxsize=64)
def _code(length: int, side: int, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """A rotation, the directions of each half, and the threshold that random vectors exceed for half of ``LISTED`` filters."""
    r = np.random.default_rng([length, side, number])
    rotation = np.linalg.qr(r.normal(size=(length, length)))[0]
    halves = []
    for width in (length - length // 2, length // 2):
        w = r.normal(size=(side, max(1, width)))
        halves.append((w / np.linalg.norm(w, axis=1)[:, None] / math.sqrt(2)).astype(np.float32) * (1 if width else 0))
    x = r.normal(size=(128, length))
    scores = _scores(x / np.linalg.norm(x, axis=1)[:, None], rotation, halves)
    tops = [np.sort((np.sort(a)[::-1][: 4 * LISTED, None] + np.sort(b)[::-1][None, : 4 * LISTED]).ravel())[::-1] for a, b in zip(*scores, strict=True)]
    # the level that LISTED / 2 x 128 of all their scores exceed
    return rotation, halves, float(np.sort(np.concatenate(tops))[::-1][LISTED // 2 * 128 - 1])


def _scores(x: np.ndarray, rotation: np.ndarray, halves: list[np.ndarray]) -> list[np.ndarray]:
    y = (x @ rotation).astype(np.float32)
    cut = x.shape[1] - x.shape[1] // 2
    second = y[:, cut:] if cut < x.shape[1] else np.zeros((len(x), 1), np.float32)
    return [y[:, :cut] @ halves[0].T, second @ halves[1].T]


def _decoded(first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors by their scores with each half's directions: (vector, filter = first x side + second) where the sum exceeds the threshold.

    Of a vector with fewer than ``LISTED`` of them, the level is lowered to that of its ``LISTED`` best. Only directions that can reach the level
    with the other half's best are paired.
    """
    n, side = first.shape
    few = min(LISTED, side)
    best = [np.take_along_axis(s, np.argpartition(-s, few - 1, axis=1)[:, :few], 1) for s in (first, second)]
    sums = np.sort((best[0][:, :, None] + best[1][:, None, :]).reshape(n, -1), axis=1)[:, ::-1]
    level = np.minimum(threshold, sums[:, min(LISTED, sums.shape[1]) - 1]) - MARGIN  # more than sums are rounded by
    ra, ca = np.nonzero(first >= (level - second.max(1))[:, None])
    rb, cb = np.nonzero(second >= (level - first.max(1))[:, None])
    of = np.bincount(rb, minlength=n)
    many = of[ra]
    a = np.repeat(np.arange(len(ra)), many)
    b = np.arange(len(a)) + np.repeat((np.cumsum(of) - of)[ra] - (np.cumsum(many) - many), many)
    keep = first[ra, ca][a] + second[rb, cb][b] >= level[ra][a]
    a, b = a[keep], b[keep]
    return ra[a], ca[a] * side + cb[b]


def _filters(nodes: DataFrame, side: int) -> DataFrame:
    """``(filter, node)``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units = np.array(batch.column("node").to_pylist(), np.int64), _units(batch.column("v"))
            lengths = np.array([len(u) for u in units])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                for a in range(0, len(at), 512):
                    some = at[a : a + 512]
                    x = np.stack([units[i] for i in some])
                    for number in range(CODES):
                        rotation, halves, threshold = _code(length, side, number)
                        row, found = _decoded(*_scores(x, rotation, halves), threshold)
                        name, owner = (length * CODES + number) * side * side + found, ids[some][row]
                        yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(owner, pa.int64())], names=["filter", "node"])

    return nodes.select("node", "v").mapInArrow(decode, "filter long, node long")


def _cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their ``cosine``."""
    names = [c for c in pairs.columns if c not in ("a", "b")]
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = [float(p @ q) for p, q in zip(_units(batch.column("va")), _units(batch.column("vb")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", *names)] + [pa.array(cosine, pa.float64())], names=["a", "b", *names, "cosine"])

    more = "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in names)
    return both.select("a", "b", *names, "va", "vb").mapInArrow(measure, f"a long, b long{more}, cosine double")


def _nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, key)`` of all rows, the key null where a row takes no part; ``(node, key, vec_id, n, v)`` of unequal vectors."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if x is not None and i is not None else None for x, i in zip(_rows(batch.column("v")), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(keys, pa.binary())], names=["vec_id", "v", "key"])

    kind = embeddings.schema["embedding"].dataType.simpleString()
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).mapInArrow(name, f"vec_id long, v {kind}, key binary")
    named = save(named, "caps-rows")
    unlike = named.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    return named.select("vec_id", "key"), save(unlike.withColumn("node", F.monotonically_increasing_id()), "caps-nodes")


def _cells(filters: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """``(node, cell, radius)``: its leader within ``reach``, itself where there is none."""
    leaders = filters.groupBy("filter").agg(F.min("node").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    pairs = filters.join(leaders.select("filter", "leader"), "filter").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    near = F.acos(F.least(F.lit(1.0), F.col("cosine")))
    found = _cosines(pairs, nodes).select("a", "b", near.alias("angle")).filter(F.col("angle") <= reach)
    led = save(found.groupBy("a").agg(F.min_by("b", "b").alias("b"), F.min_by("angle", "b").alias("angle")), "caps-led")
    # A leader that has one itself passes its members on to that, if they are within its reach; else they are cells of their own.
    over = led.select(F.col("a").alias("b"), F.col("b").alias("next"))
    passed = led.join(over, "b").select("a", F.col("next").alias("b"))
    roots = passed.join(led.select(F.col("a").alias("b")), "b", "left_anti")
    moved = _cosines(roots, nodes).select("a", "b", near.alias("angle")).filter(F.col("angle") <= reach)
    stay = led.join(over.select("b"), "b", "left_anti").select("a", "b", "angle")
    settled = stay.unionByName(moved).select(F.col("a").alias("node"), F.col("b").alias("cell"), F.col("angle").alias("radius"))
    alone = nodes.select("node").join(settled.select("node"), "node", "left_anti").select("node", F.col("node").alias("cell"), F.lit(0.0).alias("radius"))
    return save(settled.unionByName(alone), "caps-cells")


def _cell_pairs(filters: DataFrame, cells: DataFrame, stats: DataFrame, nodes: DataFrame, angle: float) -> DataFrame:
    """``(a, b)``, a < b: cells that share a filter."""
    places = save(filters.join(cells.select("node", "cell"), "node").select("filter", "cell").distinct(), "caps-places")
    counts = places.groupBy("filter").agg(F.count("*").alias("c")).filter("c > 1")
    small = places.join(counts.filter(F.col("c") <= BLOCK).select("filter"), "filter")
    other = small.select("filter", F.col("cell").alias("b"))
    pairs = small.join(other, "filter").filter("cell < b").select(F.col("cell").alias("a"), "b")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    large = places.join(counts.filter(F.col("c") > BLOCK).withColumn("blocks", blocks), "filter")
    large = large.join(nodes.select(F.col("node").alias("cell"), "v"), "cell").join(stats.select("cell", "radius"), "cell")
    own = F.pmod(F.xxhash64("cell"), F.col("blocks"))
    dealt = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("filter", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "cell", "v", "radius")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(_units(group["v"].tolist()))
        radius, ids, own = group["radius"].to_numpy(), group["cell"].to_numpy(), group["own"].to_numpy()
        near = np.arccos(np.clip(x @ x.T, -1, 1)) <= angle + MARGIN + radius[:, None] + radius[None]
        across = own[:, None] != own[None] if group["p"].iloc[0] != group["q"].iloc[0] else True
        i, j = np.nonzero(near & (ids[:, None] < ids[None]) & across)
        return pd.DataFrame({"a": ids[i], "b": ids[j]})

    return pairs.unionByName(dealt.groupBy("filter", "p", "q").applyInPandas(within, "a long, b long")).distinct()


def _open_links(unsure: DataFrame, cells: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``(node, side, p, cell, links)`` of candidates (y, p) compared with every member of p, in blocks."""
    weights = nodes.select("node", "n", "v")
    sizes = unsure.groupBy("p").agg(F.count("*").alias("k")).join(cells.groupBy(F.col("cell").alias("p")).agg(F.count("*").alias("m")), "p")
    sizes = sizes.select("p", F.ceil(F.col("k") / MEMBERS).cast("int").alias("ys"), F.ceil(F.col("m") / MEMBERS).cast("int").alias("xs"))

    def side(rows: DataFrame, name: str, own: str, other: str) -> DataFrame:
        dealt = rows.join(sizes, "p").join(weights, "node")
        mine, theirs = F.pmod(F.xxhash64("node"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        return dealt.select("node", "cell", "p", "n", "v", F.lit(name).alias("side"), mine, theirs).select("node", "cell", "p", "n", "v", "side", "ys", "xs")

    both = side(unsure.select(F.col("y").alias("node"), "cell", "p"), "y", "ys", "xs")
    both = both.unionByName(side(cells.select("node", "cell", F.col("cell").alias("p")), "x", "xs", "ys"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ys, xs = group[group["side"] == "y"], group[group["side"] == "x"]
        if not len(ys) or not len(xs):
            return pd.DataFrame({"node": [], "side": [], "p": [], "cell": [], "links": []})
        linked = np.stack(_units(ys["v"].tolist())) @ np.stack(_units(xs["v"].tolist())).T >= threshold
        out = [ys.assign(links=linked @ xs["n"].to_numpy()), xs.assign(links=linked.T @ ys["n"].to_numpy())]
        return pd.concat(out)[["node", "side", "p", "cell", "links"]]

    return both.groupBy("p", "ys", "xs").applyInPandas(compare, "node long, side string, p long, cell long, links long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per row of ``embeddings`` (vec_id, embedding)."""
    spark, angle = embeddings.sparkSession, math.acos(threshold)
    with scratch(spark):
        rows, nodes = _nodes(embeddings)
        side = int(min(MOST_SIDE, max(4 * LISTED, 8 * math.sqrt(nodes.count()))))
        filters = save(_filters(nodes, side), "caps-filters")
        cells = _cells(filters, nodes, angle / 2 - MARGIN)
        weighed = cells.join(nodes.select("node", "n"), "node")
        stats = save(weighed.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("mass"), F.max("radius").alias("radius")), "caps-stats")
        pairs = _cell_pairs(filters, cells, stats, nodes, angle)
        stat = stats.select(F.struct("m", "cell").alias("rank"), "cell", "mass", "radius")
        ranked = pairs.join(stat.select(F.col("cell").alias("a"), F.col("rank").alias("ra")), "a").join(stat.select(F.col("cell").alias("b"), F.col("rank").alias("rb")), "b")
        ordered = ranked.select(F.least("ra", "rb")["cell"].alias("cell"), F.greatest("ra", "rb")["cell"].alias("p"))
        members = ordered.join(cells.select("cell", F.col("node").alias("y")), "cell").select(F.col("y").alias("a"), F.col("p").alias("b"), "cell")
        about = stats.select(F.col("cell").alias("p"), "mass", "radius")
        checked = _cosines(members, nodes).select(F.col("a").alias("y"), F.col("b").alias("p"), "cell", "cosine").join(about, "p").join(nodes.select(F.col("node").alias("y"), "n"), "y")
        turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
        single = F.col("radius") == 0
        every = F.when(single, F.col("cosine") >= threshold).otherwise(turn + F.col("radius") <= angle - MARGIN)
        never = F.when(single, F.col("cosine") < threshold).otherwise(turn - F.col("radius") > angle + MARGIN)
        checked = save(checked.filter(~never).withColumn("every", every), "caps-checked")
        sure = checked.filter("every")
        opened = save(_open_links(checked.filter("not every").select("y", "p", "cell"), cells, nodes, threshold), "caps-open")
        added = sure.select(F.col("y").alias("node"), F.col("mass").alias("links")).unionByName(opened.select("node", "links"))
        added = added.groupBy("node").agg(F.sum("links").alias("links"))
        shared = sure.groupBy(F.col("p").alias("cell")).agg(F.sum("n").alias("shared"))
        edges = sure.select(F.col("cell").alias("a"), F.col("p").alias("b")).unionByName(opened.filter("side = 'y' and links > 0").select(F.col("cell").alias("a"), F.col("p").alias("b")))
        joined = components(edges.distinct()).select(F.col("node").alias("cell"), "component")
        placed = cells.join(joined, "cell", "left").select("node", "cell", F.coalesce("component", "cell").alias("component"))
        placed = save(placed.join(nodes.select("node", "key", "vec_id"), "node"), "caps-placed")
        least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
        known = placed.join(stats.select("cell", "mass"), "cell").join(added, "node", "left").join(shared, "cell", "left").join(least, "component")
        total = F.col("mass") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("shared", F.lit(0))
        known = known.select("key", total.alias("n_links"), "component_id")
        component = F.coalesce("component_id", "vec_id")
        found = rows.join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        return save(found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "caps", lasting=True)
