"""Benchmark decontamination: an FM-index per training shard, searched backwards for every window of the benchmark.

A shard is an Arrow batch of whole documents. Only runs of words that the benchmark knows can hold a window, so the
index covers the shard's runs that are long enough, one after another with a separator between. Windows of all items
are searched together: each step takes one word more, from the last to the first, and narrows every window's range of
suffixes by ranks of a wavelet matrix over the Burrows-Wheeler transform. Suffixes found are walked back to a sampled
position. Positions of a window's words are the hit spans; overlapping spans are merged.

The benchmark goes to the tasks in blocks of about ``BLOCK_WORDS`` words, each block's results being merged by document, so
what is broadcast, and what the driver holds at a time, has that bound however large the benchmark or an item is. A cut can
bring words together that are a window of a block searched before, so ``removed`` goes over all blocks until none is hit.

Defined cases: null and empty texts have no words; an item without words has no window and never occurs; an item with
fewer words than the window is one window; rows of one item_id count as one item; repeated documents each get a row; an
empty table gives no row, an empty benchmark no hit; other columns are carried along in ``removed`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import WORD_TABLE, batch_chunks, cut, save, spans_of, text_bytes

WINDOW = 10
BLOCK_WORDS = 500_000
SHARD_BYTES = 8 << 20
SAMPLE_EVERY = 8
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Wavelet:
    """Wavelet matrix: ``rank(symbols, places)`` counts each symbol before its place, a level of bits at a time."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(now) - self.ones[-1][-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(places), places
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = (symbols >> level & 1).astype(bool)
            before_low, before_high = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + before_low, low - before_low)
            high = np.where(one, self.zeros[k] + before_high, high - before_high)
        return high - low


class FMIndex:
    """Over word ids 2..; 1 separates runs and 0 ends the text. Suffixes that begin at a separator sort by place."""

    def __init__(self, words: np.ndarray, size: int) -> None:
        n = len(words)
        separators = np.flatnonzero(words <= 1)
        order_of = words.astype(np.int64) + len(separators)
        order_of[separators] = np.arange(len(separators) - 1, -1, -1)  # the end, which is last, sorts first
        order, rank = self.ranked(order_of)
        step = 1
        while rank[order[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            order, rank = self.ranked(rank * (n + 1) + after)
            step *= 2
        self.places = order
        previous = words[order - 1]
        self.before = previous
        self.wavelet = Wavelet(previous, size)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(words, minlength=size + 1))))
        # Sampled: every place after a separator, so no walk back crosses one, and every SAMPLE_EVERY-th.
        starts = np.concatenate(([True], words[:-1] <= 1))
        sampled = starts | (np.arange(n) % SAMPLE_EVERY == 0)
        self.sampled = sampled[order]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]
        del self.places

    @staticmethod
    def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        return order, rank

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the windows (rows of one length), all narrowed together from the last word to the first."""
        low = np.zeros(len(windows), np.int64)
        high = np.full(len(windows), len(self.before), np.int64)
        alive = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, k]
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        gone = np.ones(len(windows), bool)
        gone[alive] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Places in the text of suffixes: walk back until a sampled one, then add the steps taken."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        left = np.flatnonzero(~self.sampled[at])
        while len(left):
            symbol = self.before[at[left]]
            at[left] = self.first[symbol] + self.wavelet.rank(symbol, at[left])
            steps[left] += 1
            left = left[~self.sampled[at[left]]]
        return self.samples[self.sample_rank[at]] + steps


class Phrases:
    """A block of the benchmark: words numbered from 2, and distinct windows by length with the items that hold them."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = words_of(text)
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                windows[size][tuple(ids[i : i + size])].add(item)
        self.windows = {n: (np.array(list(found), np.int64), list(found.values())) for n, found in windows.items()}
        self.shortest = min(self.windows, default=0)


def hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, np.ndarray, set[int]]]:
    """Per text: its number of words, which of them are hit, and the items that occur."""
    get = phrases.vocabulary.get
    runs, where, counts = [], [], []  # runs of known words; (text, first word)
    for k, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        ids = np.array([get(w, 0) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids != 0, [False]))))
        starts, ends = edges[::2], edges[1::2]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if len(starts) else ():
            if b - a >= phrases.shortest:
                runs.append(ids[a:b])
                where.append((k, a))
    out = [(n, np.zeros(n, bool), set()) for n in counts]
    if not runs:
        return out
    parts: list[np.ndarray] = []
    for run in runs:
        parts += [run, np.ones(1, np.int64)]
    parts[-1] = np.zeros(1, np.int64)
    begins = np.concatenate(([0], np.cumsum([len(r) + 1 for r in runs])[:-1]))
    index = FMIndex(np.concatenate(parts), len(phrases.vocabulary) + 1)
    for size, (windows, items) in phrases.windows.items():
        low, high = index.search(windows)
        found = np.flatnonzero(low < high)
        number = high[found] - low[found]
        if not len(found):
            continue
        window = np.repeat(found, number)
        at = np.repeat(low[found], number) + np.arange(len(window)) - np.repeat(np.cumsum(number) - number, number)
        place = index.locate(at)
        run = np.searchsorted(begins, place, side="right") - 1
        for w, r, p in zip(window.tolist(), run.tolist(), (place - begins[run]).tolist(), strict=True):
            k, first = where[r]
            out[k][1][first + p : first + p + size] = True
            out[k][2].update(items[w])
    return out


def blocks(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[Phrases]:
    """The benchmark in blocks of about BLOCK_WORDS words, one at a time; long items come in pieces that share no window."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    words = items.select("item", F.filter(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    step = max(1, BLOCK_WORDS // 4)
    number = F.floor(F.greatest(F.size("words") - window, F.lit(0)) / step)
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), number), lambda k: F.concat_ws(" ", F.slice("words", (k * step + 1).cast("int"), step + window - 1)))
    parts = words.select("item", F.posexplode(pieces).alias("piece", "text"))
    total = words.select(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    part = F.pmod(F.xxhash64("item", "piece"), F.lit(n))
    for k in range(n):
        yield Phrases([(r.item, r.text.encode()) for r in parts.filter(part == k).toLocalIterator()], window)


def digest(items: set[str] | list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Per document: words, words hit by any window of the benchmark, items that occur and a digest of their ids."""
    spark = docs.sparkSession
    found = [spark.sparkContext.broadcast(p) for p in blocks(benchmark, window, item_col, item_text_col)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(found) > 1:
        return _merged(texts, found)
    shared = found[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batch_chunks(batches, "text", SHARD_BYTES):
            got = hits(text_bytes(chunk.column("text")), shared.value)
            yield _rows(chunk.column("doc_id"), [(n, int(h.sum()), len(i), digest(i), bool(i)) for n, h, i in got])

    return texts.mapInArrow(run, SCHEMA)


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _merged(texts: DataFrame, found: list[Broadcast]) -> DataFrame:
    """Results of several blocks: a row's hit words (as packed bits) and items, brought together by row."""
    # A row has no key but its content: rows of one id and text have the same result, so they share it.
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("|", F.coalesce("doc_id", F.lit("")), F.coalesce("text", F.lit(""))), 256))

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in batch_chunks(batches, "text", SHARD_BYTES):
                got = hits(text_bytes(chunk.column("text")), shared.value)
                rows = [(k, n, np.packbits(h).tobytes(), sorted(i)) for k, (n, h, i) in zip(chunk.column("key").to_pylist(), got, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.string()))],
                    names=["doc_id", "key", "n_words", "bits", "items"],
                )

        return keyed.mapInArrow(run, "doc_id long, key string, n_words long, bits binary, items array<string>")

    def merge(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            rows = []
            columns = (chunk.column(x).to_pylist() for x in ("n_words", "bits", "items", "copies"))
            ids = []
            for doc_id, n, bits, items, copies in zip(chunk.column("doc_id").to_pylist(), *columns, strict=True):
                whole = reduce(np.bitwise_or, [np.frombuffer(b, np.uint8) for b in bits])
                n_hit = int(np.unpackbits(whole).sum())
                names = {x for part in items for x in part}
                ids += [doc_id] * copies
                rows += [(n, n_hit, len(names), digest(names), bool(names))] * copies
            yield _rows(pa.array(ids, pa.int64()), rows)

    every = reduce(DataFrame.unionAll, [one(p).withColumn("block", F.lit(k)) for k, p in enumerate(found)])
    by_row = every.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("bits").alias("bits"),
        F.collect_set("items").alias("items"), F.count_if(F.col("block") == 0).alias("copies"),
    )
    return by_row.select("doc_id", "n_words", "bits", "items", "copies").mapInArrow(merge, SCHEMA)


def removed(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with every hit span cut from its text, again until the text left has no window; all columns and rows stay."""
    spark = docs.sparkSession
    found = [spark.sparkContext.broadcast(p) for p in blocks(benchmark, window, item_col, item_text_col)]

    def without(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in batch_chunks(batches, text_col, SHARD_BYTES):
                place = chunk.schema.get_field_index(text_col)
                column = chunk.column(place)
                texts, todo = text_bytes(column), range(len(column))
                changed: dict[int, bytes] = {}
                while todo:
                    again = []
                    for k, (_, hit, _) in zip(todo, hits([changed.get(k, texts[k]) for k in todo], shared.value), strict=True):
                        if hit.any():
                            text = changed.get(k, texts[k])
                            words = [m.span() for m in _WORD.finditer(text)]
                            changed[k] = cut(text, [(words[a][0], words[b - 1][1]) for a, b in spans_of(hit)])
                            again.append(k)
                    todo = again
                if changed:
                    whole = column.to_pylist()
                    for k, text in changed.items():
                        whole[k] = text.decode()
                    chunk = chunk.set_column(place, chunk.schema.field(place), pa.array(whole, column.type))
                yield chunk

        return run

    def hit_by(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in batch_chunks(batches, "text", SHARD_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([bool(h.any()) for _, h, _ in hits(text_bytes(chunk.column("text")), shared.value)], pa.bool_())], names=["hit"])

        return run

    out = docs
    while True:
        for shared in found:
            out = out.mapInArrow(without(shared), docs.schema)
        if len(found) == 1:
            return out
        out = save(out, "decontaminated")
        texts = out.select(F.col(text_col).alias("text"))
        if all(texts.mapInArrow(hit_by(shared), "hit boolean").filter("hit").isEmpty() for shared in found):
            return out
