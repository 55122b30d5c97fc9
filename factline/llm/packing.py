"""Packing: documents into sequences of at most ``window`` tokens, cut where an order-preserving dynamic program says.

Each Spark partition packs its documents in the order read, so nothing is shuffled: a document is tokenised, followed
by its end id, and appended to the partition's stream. Candidate cuts are document ends, sentence ends, and, where
neither comes for ``window // 8`` tokens, places inside a sentence. The cost of a window is its padding, of a cut its
penalty (none at a document's end). A window shorter than ``window`` is padded up to it, except where its length is a
power of two; the rest of a partition's stream that doesn't fill a window is split into powers of two and so never
padded.

Defined cases: a null text is empty and still gives its end id; an empty table gives no piece; a repeated row is packed
again; other columns, null or not, are ignored; a document longer than a window is cut over as many as it takes.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.bpe import END_ID, encoder
from factline.llm.common import batch_chunks

WINDOW = 2048
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 64
#: Tokens of a partition's stream that are optimised together.
STREAM_TOKENS = 1 << 19

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def best_cuts(places: list[int], penalties: list[int], window: int) -> list[int]:
    """Indices of the cuts of least padding plus penalties over ``places`` (rising, first 0, no gap above ``window``).

    best(j) = penalty(j) + min over i with places[j] - places[i] <= window of best(i) + window - (places[j] - places[i]);
    a monotone queue holds the i that can still be the least, so every place enters and leaves once. Ends at the last.
    """
    n = len(places)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best(i) + places[i], i), least first
    for j in range(1, n):
        at = places[j]
        while at - places[queue[0][1]] > window:
            queue.popleft()
        least, i = queue[0]
        value = least + window - at + penalties[j]
        best[j], back[j] = value, i
        value += at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Stream:
    """A partition's tokens that aren't in a finished sequence yet, with the documents that they come from."""

    def __init__(self, window: int, sequence: int, ends: np.ndarray) -> None:
        self.window, self.sequence, self.ends = window, sequence, ends
        self.ids: list[bytes] = []
        self.docs: list[list] = []  # doc_id, tokens of it before the stream, tokens in the stream, tokens in all
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.ids.append(ids)
        self.docs.append([doc_id, 0, n, n])
        self.size += n

    def places(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        doc_ends = np.cumsum([d[2] for d in self.docs])
        sentences = np.flatnonzero(np.isin(ids, self.ends)) + 1
        at = np.union1d(sentences, doc_ends)
        gap = max(1, self.window // 8)
        edges = np.concatenate(([0], at))
        wide = np.flatnonzero(np.diff(edges) > gap)
        inside = [np.arange(edges[i] + gap, edges[i + 1], gap) for i in wide]
        at = np.unique(np.concatenate([[0], at, *inside])).astype(np.int64)
        penalty = np.full(len(at), INSIDE_PENALTY)
        penalty[np.isin(at, sentences)] = SENTENCE_PENALTY
        penalty[np.isin(at, doc_ends)] = 0
        return at.tolist(), penalty.tolist()

    def flush(self, final: bool) -> None:
        """Finish sequences; all of them at the end, else all but the last few, whose cuts later tokens may move."""
        if not self.size:
            return
        data = b"".join(self.ids)
        at, penalty = self.places(np.frombuffer(data, "<u4"))
        cuts = [at[i] for i in best_cuts(at, penalty, self.window)]
        if final:
            rest = cuts[-1] - cuts[-2]
            if rest < self.window:
                cuts.pop()
                while rest:
                    cuts.append(cuts[-1] + (1 << rest.bit_length() - 1))
                    rest -= 1 << rest.bit_length() - 1
        else:
            cuts = cuts[: max(1, len(cuts) - 4)]
        self.write(cuts, data)

    def write(self, cuts: list[int], data: bytes) -> None:
        docs, d, begin = self.docs, 0, 0  # begin: where document d begins in the stream
        for a, b in zip(cuts, cuts[1:], strict=False):
            place = a
            while place < b:
                while begin + docs[d][2] <= place:
                    begin += docs[d][2]
                    d += 1
                end = min(b, begin + docs[d][2])
                crc = zlib.crc32(data[4 * place : 4 * end])
                self.rows.append((docs[d][0], docs[d][1] + place - begin, end - place, crc, docs[d][3], self.sequence, place - a))
                place = end
            self.sequence += 1
        done = cuts[-1]
        kept, begin = [], 0
        for doc_id, before, n, whole in docs:
            if begin + n > done:
                skip = max(0, done - begin)
                kept.append([doc_id, before + skip, n - skip, whole])
            begin += n
        self.docs, self.ids, self.size = kept, [data[4 * done :]], self.size - done

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: its document, place there and length, crc32 of its ids, and its place in a sequence.

    ``sequence_id`` is the partition's number times 2**40 plus the sequence's number there.
    """
    step = STREAM_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        stream = Stream(window, TaskContext.get().partitionId() << 40, encode.sentence_ends)
        end = END_ID.to_bytes(4, "little")
        for chunk in batch_chunks(batches, "text"):
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            for doc_id, ids in zip(chunk.column("doc_id").to_pylist(), encode.encode(texts), strict=True):
                stream.add(doc_id, ids + end)
                if stream.size >= step:
                    stream.flush(final=False)
                    yield stream.batch()
        stream.flush(final=True)
        yield stream.batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
