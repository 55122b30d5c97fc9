"""Helpers that several operators share: the shared folder, byte-bounded chunks, vectorised word hashes, hit spans."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from factline.operators.tables import shared_folder as shared_dir

#: Texts of about this many bytes are worked on at a time inside a task; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_SCRATCH: list[list[str]] = []


def save(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Inside ``scratch`` the table goes at its end, unless it is to last.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if _SCRATCH and not lasting:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; what is needed beyond has to be saved as lasting."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_chunks(lengths: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``limit``; every range has a row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def batch_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each have about ``limit`` bytes."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for a, b in byte_chunks(lengths, limit):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Freed memory back to the system at a task's end: workers are reused, and each would hold the most it ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has its own rules
        pass


# Lower-cases A-Z; maps every byte that is no ASCII letter or digit and below 0x80 to a space.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_TABLE = np.frombuffer(WORD_TABLE, dtype=np.uint8)
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 1 << 63, size=4096, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0xD1B54A32D192ED03)
    return h ^ (h >> np.uint64(33))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of ASCII letters, digits and non-ASCII bytes, ASCII lower-cased) of all texts, one after another.

    Returns each word's text number, first byte and end byte in that text, and 64-bit hash.
    """
    joined = b" ".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if texts else np.zeros(0, np.int64)
    data = _TABLE[np.frombuffer(joined, dtype=np.uint8)]
    inside = np.concatenate(([False], data != 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.flatnonzero(data != 32)
    place = at - np.repeat(starts, ends - starts)
    value = _BYTE[data[at]] * _PLACE[place & 4095] + (place >> 12).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    hashes = mix(np.add.reduceat(mix(value), first))
    owner = np.searchsorted(begins, starts, side="right") - 1
    return owner, starts - begins[owner], ends - begins[owner], hashes


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true, as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given byte spans; one space stands where words on both sides would touch."""
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    out = kept[0]
    for piece in kept[1:]:
        joint = out[-1:].isspace() or piece[:1].isspace() or not out or not piece
        out += piece if joint else b" " + piece
    return out
