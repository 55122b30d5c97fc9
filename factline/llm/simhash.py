"""SimHash near-dedup: fingerprints of which few bits differ, found by pigeonhole blocks and verified by their distance.

A fingerprint of 64 bits is cut into six blocks. Two that differ in at most four bits agree on two blocks at least, so
keying every fingerprint by each of the 15 pairs of blocks brings each close pair together under some key, and keys have
21 bits and more. Equal fingerprints are one node from the start. Under a key, nodes are compared in numpy, and only the
links of a spanning forest leave the task: at most one less than there are nodes, with which the components are those of
all close pairs. A key with very many nodes is split by the same rule again on the blocks that it doesn't fix, before
anything is gathered.

``fingerprints`` takes word shingles with repeats, as `op3` asks. ``near_groups`` serves deduplication by similarity of
five-word shingle sets. Its candidates are the components of close fingerprints, found by the same blocks. Alone these would
miss some: a replaced or added block that leaves a similarity of ``SIMILARITY`` changes more bits than any choice of blocks
allows. So documents that share one of ``BANDS`` bands of ``BAND_ROWS`` min-hashes of the shingle sets are candidates too,
whatever the place of the edits: two sets at exactly 0.8 share none with a probability of 5e-8. Under a band, or in a component
of fingerprints, each node is first verified by its shingle set against the least node; where that leaves
several components, every pair of nodes of different ones is verified, so no link is lost by a node between them.

Defined cases: null and empty texts, and texts of white space only, have no words and fingerprint zero; fewer words than
a shingle are one shingle; rows that repeat an id have the component of that id's texts; null ids never link but get a row;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import batch_chunks, hashed_words, mix, save, scratch, text_bytes
from factline.llm.components import components

SHINGLE = 4
DISTANCE = 4
#: Blocks: first bit and width of each, high bits first.
BLOCKS = ((53, 11), (42, 11), (31, 11), (20, 11), (10, 10), (0, 10))
#: Nodes under one key beyond which the key is split again, or dealt in pairs of blocks.
HEAVY = 4000
#: Words of all texts of one key beyond which it is dealt in pairs of blocks.
HEAVY_WORDS = 2_000_000
SIMILARITY = 0.8
SIMILARITY_SHINGLE = 5
#: Sets of similarity s share one band at least with a probability of 1 - (1 - s ** BAND_ROWS) ** BANDS.
BANDS = 32
BAND_ROWS = 4
#: Bits of the set by which texts are looked up for verification: 16 MB, broadcast.
MARK_BITS = 1 << 27

_XOR, _TIMES = np.random.default_rng(11).integers(1, 1 << 63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[a : a + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[ones * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of a text's word shingles, repeats included: words are runs without ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes).tolist()
    size = min(shingle, len(words))
    stops = (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)]
    return majority(np.array(hashes, dtype="<u8"))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: ``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batch_chunks(batches, "text"):
            found = [signed(fingerprint(t, shingle)) for t in text_bytes(chunk.column("text"))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def forest(ids: np.ndarray, prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over all pairs within ``distance``: nearest earlier nodes first, none between linked ones."""
    n = len(ids)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(1, n):
        apart = np.bitwise_count(prints[:i] ^ prints[i])
        near = np.flatnonzero(apart <= distance)
        if len(near) > 1:
            near = near[np.argsort(apart[near], kind="stable")]
        mine = i
        for j in near.tolist():
            other = root(j)
            if other != mine:
                parent[max(mine, other)] = min(mine, other)
                mine = min(mine, other)
                links.append((int(ids[j]), int(ids[i])))
    return links


def _block(block: tuple[int, int]):  # noqa: ANN202
    start, width = block
    return F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1)


def _keyed(nodes: DataFrame) -> DataFrame:
    keys = []
    for k, (a, b) in enumerate(combinations(BLOCKS, 2)):
        keys.append(F.struct(F.lit(k).alias("pair"), (_block(a) * (1 << b[1]) + _block(b)).alias("key")))
    return nodes.select("id", "fp", F.explode(F.array(*keys)).alias("k")).select("id", "fp", ((F.col("k.pair").cast("long") * (1 << 24)) + F.col("k.key")).alias("key"))


def _split(keyed: DataFrame) -> DataFrame:
    """Heavy keys again, each node now under every choice of parts of the bits that the key leaves open.

    Those bits are cut into ``DISTANCE + 2`` parts by their order; a close pair agrees on two of them at least.
    """
    parts = []
    for k, pair in enumerate(combinations(range(len(BLOCKS)), 2)):
        open_bits = [bit for i, (start, width) in enumerate(BLOCKS) if i not in pair for bit in range(start, start + width)]
        cuts = np.array_split(open_bits, DISTANCE + 2)
        masks = [signed(sum(1 << int(bit) for bit in cut_)) for cut_ in cuts]
        choices = [F.xxhash64(F.lit(n), "key", F.col("fp").bitwiseAND(F.lit(masks[x] | masks[y]))) for n, (x, y) in enumerate(combinations(range(len(cuts)), 2))]
        parts.append((k, F.array(*choices)))
    chosen = parts[0][1]
    for k, choices in parts[1:]:
        chosen = F.when(F.shiftright("key", 24) == k, choices).otherwise(chosen)
    return keyed.select("id", "fp", F.explode(chosen).alias("key"))


def close_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``(a, b)`` between ``nodes`` (id, fp) whose components are those of all pairs within ``distance`` bits.

    ``distance`` is at most four, for which the blocks are cut.
    """
    if distance > DISTANCE:
        raise ValueError(f"the blocks are cut for distances up to {DISTANCE}")
    keyed = _keyed(nodes)
    heavy = save(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("key"), "heavy")
    if not heavy.isEmpty():
        keyed = keyed.join(heavy, "key", "left_anti").unionByName(_split(keyed.join(heavy, "key", "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of the last key, which the next batch may continue
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "id", "fp")]
            if held:
                columns = [np.concatenate([h, c]) for h, c in zip(held[0], columns, strict=True)]
            edges = np.flatnonzero(np.diff(columns[0])) + 1
            last = int(edges[-1]) if len(edges) else 0
            held = [tuple(c[last:].copy() for c in columns)]
            yield links(columns, [0, *edges.tolist()])
        if held:
            yield links(held[0], [0, len(held[0][0])])

    def links(columns: tuple | list, edges: list[int]) -> pa.RecordBatch:
        found = []
        bounds = np.array(edges)
        for k in np.flatnonzero(np.diff(bounds) > 1).tolist():
            part = slice(bounds[k], bounds[k + 1])
            found += forest(columns[1][part], columns[2][part].view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = keyed.select("key", "id", "fp").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (hex) and ``component_id``, the least id reachable over close fingerprints."""
    prints = save(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id")).filter("id is not null")
    roots = components(close_links(nodes, distance))
    by_print = nodes.join(roots, nodes.id == roots.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return prints.join(by_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- by similarity of shingle sets


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """Of a set of shingle hashes one hash for each band: of its ``BAND_ROWS`` min-hashes."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1 << 12):
        part = shingles[a : a + (1 << 12)]
        np.minimum(least, ((part[None, :] ^ _XOR[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    total = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + column)
    return total


def _features(docs: DataFrame) -> DataFrame:
    """Per document: a hash of its words in order, the fingerprint of its shingles, and the band hashes of its five-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batch_chunks(batches, "text"):
            texts = text_bytes(chunk.column("text"))
            owner, _, _, hashes = hashed_words(texts)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            same, bands, sizes, prints = [], [], [], []
            for k in range(len(texts)):
                words = hashes[edges[k] : edges[k + 1]]
                same.append(xxhash.xxh3_128_hexdigest(words.tobytes()))
                sizes.append(len(words))
                prints.append(signed(majority(shingle_hashes(words, SHINGLE))))
                bands.append(band_hashes(shingle_hashes(words)).view(np.int64) if len(words) else None)
            arrays = [chunk.column("doc_id"), pa.array(same, pa.string()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "same", "size", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, same string, size int, fp long, bands array<long>")


def with_fingerprint_keys(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, size, fp, bands) with one more key among the bands: that of the component of close fingerprints."""
    prints = save(nodes.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    roots = components(close_links(prints))
    component = prints.join(roots, prints.id == roots.node, "left").select("fp", F.coalesce("component", "id").alias("component"))
    return nodes.join(component, "fp").withColumn("bands", F.array_append("bands", F.xxhash64(F.lit("fp"), "component"))).drop("component")


def marks(ids: DataFrame) -> np.ndarray:
    """A bit set of fixed size with a bit for each id (column doc_id), by its hash: what isn't marked isn't among them.

    It has ``MARK_BITS`` bits however many ids there are; when it fills up, it only spares less.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)) + 1
    dealt = ids.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place")).repartition("bucket")
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in dealt.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).toLocalIterator():
        out[(r.bucket - 1) * len(r.bits) :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _shingle_sets(docs: DataFrame, of: DataFrame) -> DataFrame:
    """Per document of ``of`` (doc_id), and of few others: sorted distinct 64-bit hashes of its five-word shingles.

    Texts aren't shuffled to find theirs: each is looked up by its id's bit where it is read.
    """
    marked = docs.sparkSession.sparkContext.broadcast(marks(of))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value

        def those() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("bit").to_numpy()
                yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

        for chunk in batch_chunks(those(), "text"):
            texts = text_bytes(chunk.column("text"))
            owner, _, _, hashes = hashed_words(texts)
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            sets = [np.unique(shingle_hashes(hashes[edges[k] : edges[k + 1]]).view(np.int64)) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.withColumn("bit", bit).mapInArrow(run, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"])


def shingle_hashes(words: np.ndarray, size: int = SIMILARITY_SHINGLE) -> np.ndarray:
    """Hashes of runs of ``size`` words given by their hashes; of the whole, if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(total)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) < similarity * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut anew so that none of its values is in two of them."""
    held: list[pa.RecordBatch] = []  # of the last key, which the next batch may continue
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1].column(key)[-1].as_py() == keys[0] and last == 0:
            held.append(batch)
            continue
        yield from _whole([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    yield from _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if any(p.num_rows for p in parts):
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _key_rows(nodes: DataFrame) -> DataFrame:
    """``(key, id, size, first)``: nodes under every band hash and component of fingerprints that another has too, and the least id of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "key"):
            keys, ids, sizes_of = (batch.column(c).to_numpy() for c in ("key", "id", "size"))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            keep, first = np.repeat(sizes > 1, sizes), np.repeat(ids[starts], sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (keys, ids, sizes_of, first)], names=["key", "id", "size", "first"])

    keyed = nodes.select("id", "size", F.explode("bands").alias("key")).select("key", "id", "size").repartition("key")
    return keyed.sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, size int, first long")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose shingle sets are similar."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = save(_shingle_sets(texts, ends), "shingles")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    # Sets of too different sizes can't be similar; they aren't shipped.
    fits = F.least(F.size("of_a"), F.size("of_b")) >= similarity * F.greatest(F.size("of_a"), F.size("of_b"))
    pairs_of_sets = pairs.join(left, "a").withColumnRenamed("b", "_b").join(right, (F.col("_b") == F.col("b")) & fits)
    counted = pairs_of_sets.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("all"))
    return save(counted.filter(F.col("both") >= similarity * (F.col("all") - F.col("both"))).select("a", "b"), "similar")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(group, id, label)``: keys' rows ``(key, id, size, label)``, a large key as all pairs of blocks of its nodes.

    A key is large with over ``size`` nodes or ``HEAVY_WORDS`` words; a block has half of that, or is one longer text.
    Groups of the same nodes under several keys are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "key"):
            keys, ids, labels, words = (batch.column(c).to_numpy() for c in ("key", "id", "label", "size"))
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            rows = 0
            for a, b in zip(edges, edges[1:], strict=False):
                whole = b - a <= size and int(words[a:b].sum()) <= HEAVY_WORDS
                for parts in [(slice(a, b),)] if whole else combinations(pieces(words, a, b), 2):
                    own, marks = (np.concatenate([c[x] for x in parts]) for c in (ids, labels))
                    if (marks == marks[0]).all():
                        continue
                    held.append((signed(xxhash.xxh3_64_intdigest(own.tobytes())), own, marks))
                    rows += len(own)
                    if rows > 1 << 16:
                        yield packed(held)
                        held, rows = [], 0
            if held:
                yield packed(held)

    def pieces(words: np.ndarray, a: int, b: int) -> list[slice]:
        cuts, first, total = [], a, 0
        for k in range(a, b):
            if k > first and (k - first >= size // 2 or total + words[k] > HEAVY_WORDS // 2):
                cuts.append(slice(first, k))
                first, total = k, 0
            total += int(words[k])
        return [*cuts, slice(first, b)]

    def packed(held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        groups = np.repeat(np.array([h[0] for h in held]), [len(h[1]) for h in held])
        return pa.RecordBatch.from_arrays([pa.array(groups), *[pa.array(np.concatenate([h[i] for h in held])) for i in (1, 2)]], names=["group", "id", "label"])

    dealt = rows.select("key", "id", "size", "label").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, "group long, id long, label long").distinct()


def linked(ids: list[int], labels: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Similar pairs, so that with them the components, ``labels`` as yet, are those of all similar pairs.

    A node is compared with the members of every other component until one is similar.
    """
    members: dict[int, list[int]] = {}
    now = {label: label for label in labels}
    found = []
    for i, label in enumerate(labels):
        own = now[label]
        for other in [c for c in members if c != own]:
            hit = next((j for j in members[other] if similar(sets[i], sets[j], similarity)), None)
            if hit is not None:
                found.append((ids[hit], ids[i]))
                now = {k: own if c == other else c for k, c in now.items()}
                members.setdefault(own, []).extend(members.pop(other))
        members.setdefault(own, []).append(i)
    return found


def group_links(rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, size: int = HEAVY) -> DataFrame:
    """Links between nodes of one key that are similar and not of one label yet; all pairs are looked at, linked ones apart."""
    blocks = save(_blocks(rows, size), "blocks")
    ends = blocks.select(F.col("id").alias("doc_id")).distinct()
    sets = save(_shingle_sets(texts, ends), "shingles").withColumnRenamed("doc_id", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "group"):
            groups = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            found = []
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.slice(a, b - a)
                lists = part.column("shingles")
                ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                held = [flat[x:y] for x, y in pairwise(ends.tolist())]
                found += linked(part.column("id").to_pylist(), part.column("label").to_pylist(), held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    dealt = blocks.join(sets, "id").select("group", "id", "label", "shingles").repartition("group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` for documents with a near copy: of equal words, or linked by similar shingle sets."""
    if similarity < SIMILARITY:
        raise ValueError(f"the bands are cut for similarities of {SIMILARITY} and more")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    features = save(_features(texts), "features")
    nodes = save(features.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    copies = features.select("same", "doc_id").join(nodes.select("same", "id"), "same").filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    rows = save(_key_rows(with_fingerprint_keys(nodes.filter("bands is not null"))), "keys")
    pairs = save(rows.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    found = _verified(pairs, texts, similarity)
    labels = save(components(found), "labels")
    labelled = rows.join(labels, rows.id == labels.node, "left").select("key", "id", "size", F.coalesce("component", "id").alias("label"))
    # Of two nodes all is known, and of nodes of one component; other keys have pairs that nobody looked at.
    mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).filter("n > 2 and least <> most").select("key")
    more = save(group_links(labelled.join(mixed, "key", "left_semi"), texts, similarity), "links")
    return components(copies.unionAll(found).unionAll(more)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose group has one of smaller id; all columns stay."""
    with scratch(docs.sparkSession):
        found = near_groups(docs, similarity, id_col, text_col).filter("doc_id <> component_id")
        gone = save(found.select(F.col("doc_id").alias("_gone")).distinct(), "gone", lasting=True)
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
