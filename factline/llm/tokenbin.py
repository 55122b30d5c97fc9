"""Token-id output: each document's ids as a zstandard frame of its own, compressed with one shared dictionary.

The file format is a folder: ``dictionary`` holds the dictionary, its SHA-256 and the id width; ``shards`` holds rows of
up to ``BLOCK_DOCS`` documents in ascending id order (shard, block, dictionary hash, first and last id, the documents'
ids, their numbers of tokens, and frame ends) with the frames one after another in ``frames``. The frame ends are the
offset index: a short document is read by slicing its frame from one block and decompressing that alone. Blocks are
committed by Spark's writer, so a lost executor leaves no half-written block, and the folder may lie in any store.

Documents are range-partitioned by id; a shard is one partition. Places in the whole corpus follow from the shards'
numbers of tokens, of which there are as many as partitions.

Defined cases: a null text is empty and gives the end id alone; null ids come first; rows that repeat an id stand next
to each other, ordered by a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.llm.bpe import END_ID, encoder
from factline.llm.common import batch_chunks, shared_dir

BLOCK_DOCS = 256
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on at most about so many documents, drawn by a hash of the id, of at most so many characters.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 8000
LEVEL = 1

SCHEMA = (
    "shard int, block long, dictionary string, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, "
    "ends array<long>, frames binary"
)
READ_SCHEMA = "shard int, block long, place int, doc_id long, start long, n_tokens long, ids_crc32 long"


def serialised(ids: bytes, width: int) -> bytes:
    """Ids given as unsigned 32-bit integers, in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def restored(data: bytes, width: int) -> bytes:
    return data if width == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """From serialised id arrays of a bounded sample of documents; empty if there is too little to train on."""
    import zstandard

    total = docs.count()
    bound = F.lit(min(1.0, SAMPLE_DOCS / max(1, total)) * (1 << 20))
    texts = docs.filter((F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 20)) < bound) & (F.length("text") <= SAMPLE_CHARS)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batch_chunks(batches, "text"):
            ids = encoder(tokenizer).encode([t or "" for t in chunk.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([serialised(x, width) for x in ids], pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in texts.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes):  # noqa: ANN201
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))


@functools.lru_cache(maxsize=4)
def decompressor(dictionary: bytes):  # noqa: ANN201
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, an end id after each, and write them to ``path`` in ascending id order."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = 2 if encoder(tokenizer).library.get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(texts, tokenizer, width)
    key = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(key, width, bytearray(dictionary))], "dictionary string, width int, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, press = TaskContext.get().partitionId(), encoder(tokenizer), compressor(shared.value)
        block = 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            ends = list(accumulate(len(f) for _, _, f in held))
            values = [shard, block, key, held[0][0], held[-1][0], [h[0] for h in held], [h[1] for h in held], ends, b"".join(f for _, _, f in held)]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            names = ["shard", "block", "dictionary", "first_id", "last_id", "doc_ids", "n_tokens", "ends", "frames"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for chunk in batch_chunks(batches, "text"):
            encoded = encode.encode([t or "" for t in chunk.column("text").to_pylist()])
            for doc_id, ids in zip(chunk.column("doc_id").to_pylist(), encoded, strict=True):
                held.append((doc_id, len(ids) // 4 + 1, press.compress(serialised(ids + end, width))))
                if len(held) == BLOCK_DOCS:
                    yield row()
                    held.clear()
                    block += 1
        if held:
            yield row()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = texts.withColumn("key", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key", "text").drop("key")
    ordered.mapInArrow(run, SCHEMA).write.parquet(f"{path}/shards")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decompress every document; ``start`` counts the ids of all documents before it, in ascending id order."""
    held = spark.read.parquet(f"{path}/dictionary").first()
    shared = spark.sparkContext.broadcast((held.dictionary, held.width, bytes(held.bytes)))
    blocks = spark.read.parquet(f"{path}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, width, dictionary = shared.value
        press = decompressor(dictionary)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dictionary"] != key:
                    raise ValueError(f"block {r['block']} of shard {r['shard']} was written with another dictionary")
                rows, before = [], 0
                for place, (doc_id, n, start, end) in enumerate(zip(r["doc_ids"], r["n_tokens"], [0, *r["ends"]], r["ends"], strict=False)):
                    ids = restored(press.decompress(r["frames"][start:end]), width)
                    if len(ids) != 4 * n:
                        raise ValueError(f"document {doc_id} has {len(ids) // 4} ids, its index says {n}")
                    rows.append((r["shard"], r["block"], place, doc_id, before, n, zlib.crc32(ids)))
                    before += n
                kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4)
                names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # Tokens before each block: sums over blocks within a shard, and over the shards before it.
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    by_shard = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before_shard"))
    by_block = sizes.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before_block"))
    docs = blocks.mapInArrow(run, READ_SCHEMA)
    return docs.join(by_block, ["shard", "block"]).join(by_shard, "shard").select(
        "doc_id", (F.col("before_shard") + F.col("before_block") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id: blocks are found by their id range, and only that frame is decompressed."""
    held = spark.read.parquet(f"{path}/dictionary").first()
    press = decompressor(bytes(held.bytes))
    blocks = spark.read.parquet(f"{path}/shards").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    entries = blocks.select("frames", F.posexplode("doc_ids").alias("place", "doc_id"), "ends").filter(F.col("doc_id") == doc_id)
    start = F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.element_at("ends", F.col("place")))
    frames = entries.select(F.substring("frames", (start + 1).cast("int"), (F.get("ends", "place") - start).cast("int")).alias("frame"))
    return [np.frombuffer(restored(press.decompress(bytes(r.frame)), held.width), "<u4").tolist() for r in frames.toLocalIterator()]


def written(docs: DataFrame, tokenizer: str) -> str:
    """Write to a new folder in the shared one; its path."""
    path = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return path
