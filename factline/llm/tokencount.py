"""Token counts: how many unigram pieces each text's best segmentation has, without keeping the pieces.

A text is split at white space and each word gets the word mark in front. A task's new distinct words go into one
trie; walking it depth first, the best score and its number of pieces at a node follow from the nodes above, so words
with a common beginning share that work, and a word's count is read at its terminal node. Documents then sum the
counts of their words. A piece's score is the logarithm of a Zipf frequency of its rank in the vocabulary file; a
character that no piece holds costs as many byte pieces as it has bytes. Of equal scores the fewer pieces win.

Defined cases: null and empty texts have no words and no tokens; an empty table gives no row; repeated rows are counted
each; other columns, null or clashing, are ignored; texts are read whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import batch_chunks

WORD_MARK = "▁"
#: Score of a byte piece, below that of any other piece.
BYTE_SCORE = -25.0
CACHE_WORDS = 1_000_000
_NO_END = object()
SCHEMA = "doc_id long, n_words long, n_tokens long"


class Unigram:
    """Pieces with scores; ``counts`` keeps the words met."""

    def __init__(self, scores: dict[str, float], cache_words: int = CACHE_WORDS) -> None:
        self.scores, self.cache_words = scores, cache_words
        self.longest = max(map(len, scores), default=1)
        # Every end of a piece, with the score of those that are pieces: where an end is none, no longer piece ends there.
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))} | scores
        self.known: dict[str, int] = {}

    def add(self, words: set[str]) -> None:
        """Insert marked words in a trie; fill it with forward scores; keep the counts at the terminal nodes."""
        root: dict = {}
        for word in words:
            node = root
            for c in WORD_MARK + word:
                node = node.setdefault(c, {})
            node[""] = word  # terminal
        get, longest = self.ends.get, self.longest
        # One path's scores, counts and characters at a time; deeper entries are overwritten when the walk turns.
        best, count = [0.0], [0]
        path: list[str] = []
        todo = [(root, 0, "")]
        while todo:
            node, depth, c = todo.pop()
            if depth:
                del path[depth - 1 :], best[depth:], count[depth:]
                path.append(c)
                size = len(c.encode("utf-8", "surrogatepass"))
                score, n = best[depth - 1] + size * BYTE_SCORE, count[depth - 1] + size
                tail = "".join(path[-longest:])
                for k in range(1, len(tail) + 1):
                    own = get(tail[-k:], _NO_END)
                    if own is _NO_END:
                        break
                    if own is not None:
                        s = best[depth - k] + own
                        if s > score or s == score and count[depth - k] + 1 < n:
                            score, n = s, count[depth - k] + 1
                best.append(score)
                count.append(n)
            for key, child in node.items():
                if key:
                    todo.append((child, depth + 1, key))
                else:
                    self.known[child] = count[depth]

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """Words and tokens of each text; the new words of all of them share one trie."""
        if len(self.known) > self.cache_words:
            self.known.clear()
        lists = [t.split() for t in texts]
        new: set[str] = set()
        for words in lists:
            new.update(words)
        self.add(new.difference(self.known))
        get = self.known.__getitem__
        return [(len(words), sum(map(get, words))) for words in lists]


@functools.lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    """The normal pieces of a sentencepiece file, scored by rank; one per worker process."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [
        pieces.id_to_piece(i)
        for i in range(pieces.get_piece_size())
        if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
    ]
    return Unigram({p: -math.log(rank + 2.7) for rank, p in enumerate(ranked)})


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, words and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = model(vocabulary)
        for chunk in batch_chunks(batches, "text"):
            found = unigram.counts([t or "" for t in chunk.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [chunk.column("doc_id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
