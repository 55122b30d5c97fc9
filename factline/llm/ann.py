"""Approximate nearest neighbours by inner product: shifted Hilbert orderings of projected vectors.

Equal vectors are one entry with its smallest ids, however many rows there are. Each of ``CURVES`` orderings projects the
vectors to ``DIMS`` random orthogonal directions, shifts them, and numbers the cells on a Hilbert curve; a hash of the
entry tells apart entries of one cell. An ordering is cut at quantiles into blocks of about ``BLOCK_ROWS`` entries. A
query is compared with the blocks within ``radius`` of its own on every ordering, and the best of all are merged and
ranked by the exact inner product of the original vectors.

The radius is measured, not guessed: for a bounded sample of queries the true neighbours over all rows give the distance
in blocks on the nearest ordering; the radius is what covers ``COVER`` of them. On vectors with structure that is a few
blocks. On vectors without any, such as uniform ones in many dimensions, no ordering brings neighbours together and
the radius spans a constant share of the table; then the cost is that share of comparing every query with every row.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those whose length
isn't the commonest (ties: the least), nor rows with a null id; a repeated row is one entry; equal scores go to the smaller id; with
fewer candidates than asked for all are given; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.common import save

NEIGHBOURS = 20
EVERY = 20
CURVES = 4
DIMS = 8
BITS = 6
BLOCK_ROWS = 2048
MAX_BLOCKS = 16384
SAMPLE_VECTORS = 4096
SAMPLE_KEYS = 200_000
SAMPLE_QUERIES = 48
COVER = 0.96


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (a row each), by Skilling's transform."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(dims):
            inverted = (x[:, i] & q) != 0
            swapped = np.where(inverted, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(inverted, p, swapped)
            x[:, i] ^= swapped
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << bits - 1
    while q > 1:
        turn ^= np.where(x[:, dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> bit & 1)
    return key


class Orderings:
    """Projections, shifts and scales of every ordering, and where its blocks begin."""

    def __init__(self, sample: np.ndarray, seed: int = 5) -> None:
        random = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.projections, self.low, self.scale = [], [], []
        for _ in range(CURVES):
            basis, _ = np.linalg.qr(random.standard_normal((width, width)))
            projection = basis[:, :dims]
            seen = sample @ projection
            low, high = np.quantile(seen, 0.002, axis=0), np.quantile(seen, 0.998, axis=0)
            span = np.maximum(high - low, 1e-9) * 1.25
            self.projections.append(projection)
            self.low.append(low - span * 0.2 * random.random(dims))
            self.scale.append((1 << BITS) / span)
        self.bounds = [np.zeros(0, np.int64)] * CURVES

    def keys(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A row of keys for each ordering: the cell's place on the curve, then 15 bits of a hash of the id."""
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(49)).astype(np.int64)
        out = []
        for projection, low, scale in zip(self.projections, self.low, self.scale, strict=True):
            cells = np.clip((vectors @ projection - low) * scale, 0, (1 << BITS) - 1)
            out.append(hilbert(cells, BITS) << 15 | spread)
        return np.array(out)

    def blocks(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.array([np.searchsorted(b, k, side="right") for b, k in zip(self.bounds, self.keys(vectors, ids), strict=True)])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


def _packed(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors that take part: id and components as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        ids.append(i)
                        packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    chosen = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null")
    return chosen.mapInArrow(run, "vec_id long, v binary")


def _entries(packed: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors with their ``keep`` smallest ids; a task keeps no more of its own, so a common vector stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, set[int]] = {}
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.setdefault(v, set()).add(i)
            rows = [(v, sorted(ids)[:keep], any(i % EVERY == 0 for i in ids)) for v, ids in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.bool_())], names=["v", "ids", "asked"])

    partial = packed.mapInArrow(run, "v binary, ids array<long>, asked boolean")
    merged = partial.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"), F.bool_or("asked").alias("asked"))
    return merged.select(F.col("ids")[0].alias("id"), "ids", "asked", "v")


def exact(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per query the best ``k`` rows of ``vectors``, and their inner products, each summed alike whatever is beside it."""
    rough = queries @ vectors.T
    k = min(k, len(vectors))
    near = np.argpartition(-rough, k - 1, axis=1)[:, :k] if k < len(vectors) else np.tile(np.arange(len(vectors)), (len(queries), 1))
    scores = (vectors[near] * queries[:, None, :]).sum(axis=2)
    return near, scores


def nearest_rows(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the best ``k`` rows of ``vectors``, equal scores by smaller id, and their inner products.

    Every row whose rough product is as good as the ``k``-th, but for rounding, is scored exactly before any is left out.
    """
    rough = queries @ vectors.T
    k = min(k, len(vectors))
    lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :]
    slack = 1e-12 * vectors.shape[1] * lengths
    least = -np.partition(-(rough - slack), k - 1, axis=1)[:, k - 1]
    out = []
    for query, line, need in zip(queries, rough + slack, least, strict=True):
        near = np.flatnonzero(line >= need)
        scores = (vectors[near] * query).sum(axis=1)
        best = np.lexsort((ids[near], -scores))[:k]
        out.append((near[best], scores[best]))
    return out


def _orderings(entries: DataFrame, width: int, n: int, k: int) -> tuple[Orderings, int]:
    """Fit the orderings on bounded samples, and measure the radius."""
    first = entries.withColumn("_draw", F.xxhash64("id", F.lit("vectors"))).orderBy("_draw").drop("_draw").limit(SAMPLE_VECTORS).select("id", "v").collect()
    sample = np.array([np.frombuffer(bytes(r.v), np.float64) for r in first])
    orderings = Orderings(sample)
    spark = entries.sparkSession
    n_blocks = min(MAX_BLOCKS, -(-n // BLOCK_ROWS))
    fitted = spark.sparkContext.broadcast(orderings)
    share = min(1.0, SAMPLE_KEYS / n)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fitted.value.keys(matrix(batch.column("v"), width), batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=[f"k{c}" for c in range(CURVES)])

    drawn = entries.filter(F.pmod(F.xxhash64("id", F.lit("keys")), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("id", "v")
    seen = np.array([list(r) for r in drawn.mapInArrow(keys, ", ".join(f"k{c} long" for c in range(CURVES))).toLocalIterator()], np.int64).reshape(-1, CURVES)
    orderings.bounds = [np.quantile(seen[:, c], np.arange(1, n_blocks) / n_blocks, method="lower") if len(seen) else np.zeros(0, np.int64) for c in range(CURVES)]
    if n_blocks == 1:
        return orderings, 0

    asked = sample[:SAMPLE_QUERIES]
    asked_blocks = orderings.blocks(asked, np.array([r.id for r in first[:SAMPLE_QUERIES]]))
    bounded = spark.sparkContext.broadcast(orderings)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("v"), width)
            near, scores = exact(asked, vectors, k + 1)
            blocks = bounded.value.blocks(vectors, batch.column("id").to_numpy())
            apart = np.abs(blocks[:, near] - asked_blocks[:, :, None]).min(axis=0)
            query = np.repeat(np.arange(len(asked)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(scores.ravel()), pa.array(apart.ravel(), pa.int64())], names=["query", "score", "apart"])

    found = entries.select("id", "v").mapInArrow(nearest, "query int, score double, apart long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    apart = np.sort([r.apart for r in found.withColumn("rank", rank).filter((F.col("rank") > 1) & (F.col("rank") <= k + 1)).select("apart").collect()])
    return orderings, int(apart[min(len(apart) - 1, int(np.ceil(COVER * len(apart))))]) if len(apart) else 0


def search(rows: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``EVERY``: ``query_id, rank, vec_id, score`` of its ``k`` nearest found."""
    spark = rows.sparkSession
    packed = save(_packed(rows, id_col, vector_col), "vectors")
    lengths = sorted(((r["n"], -r["size"]) for r in packed.groupBy(F.length("v").alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width = -lengths[0][1] // 8
    packed = packed.filter(F.length("v") == width * 8)
    entries = save(_entries(packed, k + 1), "entries")
    orderings, radius = _orderings(entries, width, entries.count(), k)
    shared = spark.sparkContext.broadcast(orderings)
    n_blocks = len(orderings.bounds[0]) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, v = batch.column("id").to_pylist(), batch.column("v").to_pylist()
                blocks = shared.value.blocks(matrix(batch.column("v"), width), batch.column("id").to_numpy())
                out: list[tuple] = []
                for j, (asked, held) in enumerate(zip(batch.column("asked").to_pylist(), batch.column("ids").to_pylist(), strict=True)):
                    for curve in range(CURVES):
                        own = int(blocks[curve, j])
                        out.append((curve * n_blocks + own, False, ids[j], v[j], held))
                        if asked:
                            out += [(curve * n_blocks + b, True, ids[j], v[j], None) for b in range(max(0, own - radius), min(n_blocks, own + radius + 1))]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                names = ["block", "query", "id", "v", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, held = None, [], []
        table: np.ndarray | None = None
        for batch in batches:
            block, query = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if block[a] != now:
                    now, vectors, held, table = block[a], [], [], None
                if not query[a]:
                    vectors.append(matrix(part.column("v"), width))
                    held += part.column("ids").to_pylist()
                elif vectors:
                    if table is None:
                        table, least = np.concatenate(vectors), np.array([x[0] for x in held])
                    for c in range(0, b - a, 128):
                        some = part.slice(c, 128)
                        found = nearest_rows(matrix(some.column("v"), width), table, least, k + 1)
                        best = [[{"score": s, "ids": held[j]} for j, s in zip(near.tolist(), scores.tolist(), strict=True)] for near, scores in found]
                        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))
                        yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(best, kind)], names=["id", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                best = []
                for lists in batch.column("best").to_pylist():
                    found = {(-x["score"], i) for one in lists for x in one for i in x["ids"]}
                    best.append([{"vec_id": i, "score": -s} for s, i in sorted(found)[: k + 1]])
                kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, kind)], names=["id", "best"])

    partial = (
        entries.mapInArrow(deal, "block long, query boolean, id long, v binary, ids array<long>")
        .repartition("block").sortWithinPartitions("block", "query", "id")
        .mapInArrow(compare, "id long, best array<struct<score:double,ids:array<long>>>")
    )
    by_entry = partial.groupBy("id").agg(F.collect_list("best").alias("best")).mapInArrow(merge, "id long, best array<struct<vec_id:long,score:double>>")
    queries = packed.filter(F.col("vec_id") % EVERY == 0).dropDuplicates(["vec_id", "v"]).join(entries.select("v", "id"), "v").select(F.col("vec_id").alias("query_id"), "id")
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    ranked = queries.join(save(by_entry, "nearest"), "id").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "found"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), F.col("found.score").alias("score"))
