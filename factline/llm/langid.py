"""Language identification: known words by per-language log frequency, unseen words by backing off to shorter n-grams.

Training counts words and the character n-grams of marked words on labelled documents, a bounded sample of at most
about ``SAMPLE_DOCS`` documents of each language, drawn by a hash of the id; the commonest ``MAX_WORDS`` words and
``MAX_GRAMS`` n-grams are kept, which bounds the model that is broadcast. Prediction reads whole texts: a known word
adds its log frequencies; an unseen one adds the mean over its known n-grams of the longest length that has any, from
``LONGEST`` down to 1. The language of the largest sum wins (ties: the smaller name); the score is its share of
the softmax of the sums, divided by the root of the number of words so that it stays telling for long texts.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0; so is every text where no labelled
document has a letter; training rows with null text or label are left out; an empty table gives no row; repeated rows are
scored each; other columns, such as a ``lang_pred`` of the input, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.common import batch_chunks

SAMPLE_DOCS = 3000
MAX_WORDS = 60_000
MAX_GRAMS = 60_000
LONGEST = 4
SMOOTHING = 0.1
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, lang_pred string, score double"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Languages in order, and a log frequency for each language of every kept word and n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_scores: np.ndarray
    gram_scores: np.ndarray

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [self.grams[g] for g in grams_of(word, n) if g in self.grams]
            if known:
                return self.gram_scores[known].mean(axis=0)
        return np.zeros(len(self.languages))


class Scorer:
    """A model with a worker's cache of words met so far."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.rows = dict(self.model.words)
        self.table = np.concatenate([self.model.word_scores, np.zeros((1024, len(self.model.languages)))])
        self.used = len(self.model.words)

    def place(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = self.model.unseen(word)
        self.rows[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.model.languages:
            return "und", 0.0
        if self.used > CACHE_WORDS + len(self.model.words):
            self.reset()
        get = self.rows.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            for i, k in enumerate(at):
                if k < 0:
                    at[i] = k if (k := get(words[i], -1)) >= 0 else self.place(words[i])
        total = self.table[at].sum(axis=0)
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / math.sqrt(len(words)))
        return self.model.languages[best], float(1 / share.sum())


def train(
    docs: DataFrame, allowed: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
) -> Model:
    """Fit on the rows that ``allowed`` admits and that have a label and a text."""
    rows = docs.filter(allowed) if allowed is not None else docs
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    share = {r.lang: sample_docs / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros((0, 0)))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20))
    bound = F.lit(0.0)
    for lang, s in share.items():
        bound = F.when(F.col("lang") == lang, F.lit(s * (1 << 20))).otherwise(bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batch_chunks(batches, "text", 8 << 20):
            words: dict[str, Counter] = {}
            for lang, text in zip(chunk.column("lang").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            out = []
            for lang, found in words.items():
                grams: Counter = Counter()
                for word, n in found.items():
                    for size in range(1, LONGEST + 1):
                        for g in grams_of(word, size):
                            grams[g] += n
                out += [(lang, False, w, n) for w, n in found.items()] + [(lang, True, g, n) for g, n in grams.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "gram", "term", "n"])

    sampled = rows.filter((draw < bound) & F.col("text").isNotNull()).select("lang", "text")
    counts = sampled.mapInArrow(count, "lang string, gram boolean, term string, n long").groupBy("gram", "term", "lang").agg(F.sum("n").alias("n"))
    terms = counts.groupBy("gram", "term").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).persist()
    languages = sorted(share)

    def top(gram: bool, limit: int) -> tuple[dict[str, int], np.ndarray]:
        found = terms.filter(F.col("gram") == gram).orderBy(F.desc("total"), "term").limit(limit).collect()
        table = np.array([[r.by.get(lang, 0) for lang in languages] for r in found], float).reshape(-1, len(languages))
        table = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (len(found) + 1)))
        return {r.term: i for i, r in enumerate(found)}, table

    words, word_scores = top(False, max_words)
    grams, gram_scores = top(True, max_grams)
    terms.unpersist()
    return Model(languages if words else [], words, grams, word_scores, gram_scores)


_SCORERS: dict[int, Scorer] = {}


def scorer(shared) -> Scorer:  # noqa: ANN001
    """A worker's scorer for a broadcast model; only the latest is kept."""
    key = id(shared.value)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(shared.value)
    return _SCORERS[key]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, predicted language and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        for chunk in batch_chunks(batches, "text"):
            found = [own.predict(t) for t in chunk.column("text").to_pylist()]
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), langs, scores], names=["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, SCHEMA)


def accepted(docs: DataFrame, model: Model, min_score: float, text_col: str = "text", min_words: int = 0) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``min_score``.

    Texts with a letter but fewer than ``min_words`` words stay whatever their score, which so few words leave low.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared)
        for chunk in batch_chunks(batches, text_col):
            texts = chunk.column(text_col).to_pylist()
            found = [own.predict(t) for t in texts]
            good = [lang != "und" and (score >= min_score or len(words_of(t)) < min_words) for t, (lang, score) in zip(texts, found, strict=True)]
            yield chunk.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
