"""Substring dedup: near-duplicate passages, found by compact windows of token min-hashes and verified word by word.

The elements of a text are its five-word shingles. For each of ``HASHES`` hash functions the Cartesian tree over the
elements' hashes has a node for each element; the window of a node reaches as far as no smaller hash stands, and every
passage inside it that holds the node's element has that element's hash as its min-hash: one *compact window* stands for
all these passages. Only windows of ``PASSAGE`` words and more can hold a passage of that length, of which there are
about two in ``PASSAGE`` words. Two passages of similarity s share a function's min-hash with probability s, and equal
passages always do, so windows that share a hash are the candidates; windows whose hash no other document has are dropped.

Candidates are verified before they are linked:

* *Equal passages.* Inside the windows of the first function, every run of ``PASSAGE`` words is hashed whole. Documents with
  an equal run are linked to the first of it, so whatever else shares the window's hash can't come between two of them.
* *Edited passages.* The other functions' windows are keyed by the node's words and six more on one side. Of one key, windows
  are compared with the first, then those still open with the second, and so on, whether that one was linked itself or not.
  A window is open until it holds a near-duplicate passage of another (``PASSAGE`` words and more whose shingles have a Jaccard
  similarity of ``SIMILARITY``, insertions, deletions and moved parts included). One with an equal passage of another stands
  for nothing that the other doesn't and is compared no further. Up to ``ANCHORS`` windows of a key are compared with all
  others as they stream by. The rest of a larger key are all compared, however many documents hold the phrase: those of up to
  ``WHOLE`` windows whole, others where they share a shingle. Of two windows with such a passage each has a shared one among the
  first of its own, in any order that is the same for both; how many that are follows from ``shingle_weights``. The order puts
  last what the key's first windows have in common, so that few meet under each. Before any words are compared, one matrix product
  of weights and shingles leaves out the pairs that can't hold a passage, and where the shared shingles stand leaves out nearly all
  others that don't. Windows of a key with the same words in several documents are an equal passage and go on once.

* *Equal texts.* A text that a document of smaller id has too is one passage, and isn't looked into any further.

All is done inside a task first, and only the first ones there are dealt on by hash, so a passage that a third of all
documents hold is never gathered in one task, nor paired with itself. Passages are cut from every document but the one of
smallest id that holds them.

Defined cases: null texts, and texts of fewer words than a passage, hold none; null ids take no part but stay in
``cleaned``; rows that repeat an id are not compared with each other, and each has its own passages; passages that repeat
inside one document are no duplicates; an empty table gives no row; other columns, whatever their names, are carried along
in ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.common import batch_chunks, byte_chunks, cut, give_back, hashed_words, mix, save, spans_of, text_bytes
from factline.llm.simhash import SIMILARITY, SIMILARITY_SHINGLE, by_key

PASSAGE = 50
#: The first finds equal passages, the others edited ones: of those at similarity 0.8 each finds about two thirds.
HASHES = 4
#: Words of the node and beside it that key a window of an edited passage: after it for one function, before it for the next.
CONTEXT = 11
#: Windows of one key that further ones are compared with where they are read; the rest of a larger key is dealt in blocks.
ANCHORS = 16
#: Windows of a key up to which they are compared as one group.
WHOLE = 64
#: Windows of a block, of which a task compares two at a time where very many share a shingle.
BLOCK = 2000

#: Elements of a window on either side of its node that a passage of ``PASSAGE`` words around the node can reach.
REACH = PASSAGE - SIMILARITY_SHINGLE
_SIDE = 2 * REACH + SIMILARITY_SHINGLE
_PACKED = 2 + _SIDE + 4
_BITS = -(-(2 * REACH + 1) // 8)
#: Different shingles that two windows of edited passages share at least, if none repeats inside the later one.
LEAST_SHARED = -int(-SIMILARITY * (REACH + 1) // 1)
#: Least sum of the weights of shared shingles, see ``shingle_weights``.
_LEAST_WEIGHT = SIMILARITY * (REACH + 1) - 0.01
#: Columns of the matrices of weights and shingles; more of them leave fewer pairs to no purpose.
_COLUMNS = 512
#: Of so many of a key's first windows a shingle is in, to come last in the order by which the rest meet.
_COMMON = 3
_APART = 100
_BUCKETS = 1 << 11  # of hashes of shingles
_CELLS = 1 << 25  # of a table of windows and shingles
_TIMES = np.random.default_rng(13).integers(1, 1 << 31, size=SIMILARITY_SHINGLE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Own shingles of runs that begin so many places before column ``REACH`` and end so many after it; how many of so many must be shared.
_OWN = (np.arange(REACH + 1, dtype=np.int16)[:, None] + np.arange(1, REACH + 2, dtype=np.int16)[None, :])[None]
_ENOUGH = np.ceil(SIMILARITY * np.arange(4 * _SIDE)).astype(np.int16)
_CHECK = np.random.default_rng(17).integers(1, 1 << 63, size=_SIDE, dtype=np.uint64)
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, size=16, dtype=np.uint64)
WINDOWS = "value long, doc_id long, at int, shape int, known boolean, dealt boolean"
#: ``key`` is the other document's id in a link, and the number of words in a size; ``length`` of an edited passage's window says
#: whether it is open.
ROWS = "kind int, length int, key long, doc_id long, place long, words binary"
EQUAL, EDITED, LINK, SIZE, REST = range(5)


def slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of every ``width`` neighbours, by doubling."""
    pick, now, reach = (np.minimum if least else np.maximum), values, 1
    while reach < width:
        step = min(reach, width - reach)
        now = pick(now[:-step], now[step:])
        reach += step
    return now


def compact_windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of the Cartesian trees, one for each run of equal ``owner``, whose windows have ``width`` elements or more.

    A node has such a window if and only if it is the least of some ``width`` neighbours; the nearest smaller elements
    around it are then nodes of that kind, or the text's ends. Returns the nodes and how far each window reaches to both sides.
    """
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    lowest = slide(hashes, width, True)
    whole = owner[: n - width + 1] == owner[width - 1 :]
    lowest = np.where(whole, lowest, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), lowest, np.zeros(width - 1, np.uint64)])
    nodes = np.flatnonzero((slide(padded, width, False) == hashes) & (hashes > 0))
    if not len(nodes):
        return none, none, none
    starts = np.searchsorted(owner, owner[nodes], side="left").tolist()
    ends = np.searchsorted(owner, owner[nodes], side="right").tolist()
    back, ahead, stack = [0] * len(nodes), [0] * len(nodes), []
    values, places = hashes[nodes].tolist(), nodes.tolist()
    for i, (value, place) in enumerate(zip(values, places, strict=True)):
        while stack and (places[stack[-1]] < starts[i] or values[stack[-1]] > value):
            k = stack.pop()
            ahead[k] = min(place, ends[k]) - places[k] - 1
        back[i] = place - (places[stack[-1]] + 1 if stack else starts[i])
        stack.append(i)
    for k in stack:
        ahead[k] = ends[k] - places[k] - 1
    return nodes, np.array(back), np.array(ahead)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours, by doubling."""
    out, size, power, width = words, 0, words, 1
    while True:
        if n & width:
            if size:
                m = max(0, len(words) - size - width + 1)
                out = mix(out[:m] * np.uint64(0x9E3779B97F4A7C15) + power[size : size + m])
            else:
                out = power
            size += width
        if size == n:
            return out
        m = max(0, len(power) - width)
        power = mix(power[:m] * np.uint64(0xD1B54A32D192ED03) + power[width : width + m])
        width *= 2


def _text_windows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: key, text number, node's first word, and reach and function of each window that can hold a passage."""
    owner, _, _, words = hashed_words(texts)
    first = np.searchsorted(owner, np.arange(len(texts)))
    n = len(words) - SIMILARITY_SHINGLE + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none
    inside = np.flatnonzero(owner[:n] == owner[SIMILARITY_SHINGLE - 1 :])
    shingles, of = grams(words, SIMILARITY_SHINGLE)[inside], owner[inside]
    around = grams(words, CONTEXT)
    out = []
    for function, seed in enumerate(_SEEDS[:HASHES]):
        hashes = mix(shingles ^ seed)
        nodes, back, ahead = compact_windows(hashes, of, REACH + 1)
        if not len(nodes):
            continue
        at, values = inside[nodes], hashes[nodes]
        if function:
            begin = at if function % 2 else at - (CONTEXT - SIMILARITY_SHINGLE)
            end = begin + CONTEXT - 1
            fits = (begin >= 0) & (end < len(words))
            fits[fits] = (owner[begin[fits]] == of[nodes[fits]]) & (owner[end[fits]] == of[nodes[fits]])
            nodes, back, ahead, at, begin = nodes[fits], back[fits], ahead[fits], at[fits], begin[fits]
            values = mix(around[begin] ^ seed)
        shape = np.minimum(back, REACH) | np.minimum(ahead, REACH) << 6 | function << 12
        out.append((values.view(np.int64), of[nodes], at - first[of[nodes]], shape))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none, none)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's windows: the first document of a hash there deals it on, for the others it is known to repeat."""
    for whole in batch_chunks(batches, "text", 8 << 20):
        held = []
        for chunk in batch_chunks(iter([whole]), "text"):
            value, text, at, shape = _text_windows(text_bytes(chunk.column("text")))
            held.append((value, chunk.column("doc_id").to_numpy()[text], at.astype(np.int32), shape.astype(np.int32)))
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
        if not held or not len(columns[0]):
            continue
        order = np.lexsort((columns[2], columns[1], columns[0]))
        value, doc_id, at, shape = (c[order] for c in columns)
        begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        sizes = np.diff(np.append(begin, len(value)))
        dealt = doc_id == np.repeat(doc_id[begin], sizes)
        known = np.repeat(np.logical_or.reduceat(~dealt, begin), sizes)
        back = np.argsort(order)  # as they stand in the texts: neighbouring rows of one document take less room
        yield pa.RecordBatch.from_arrays([pa.array(c[back]) for c in (value, doc_id, at, shape, known, dealt)], names=[x.split()[0] for x in WINDOWS.split(", ")])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by hash and document: those whose hash more than one document has."""
    names = ["value", "doc_id", "at", "shape"]
    held: list[np.ndarray] | None = None  # of the last hash, while only one document is known to have it
    last = None  # the last hash, if it is known to repeat
    for batch in batches:
        dealt = batch.column("dealt").to_numpy(zero_copy_only=False)
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "known"]]
        if not dealt.all():
            yield pa.RecordBatch.from_arrays([pa.array(c[~dealt]) for c in columns[:4]], names=names)
            columns = [c[dealt] for c in columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        value, doc_id, _, _, known = columns
        if not len(value):
            continue
        begin = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        sizes = np.diff(np.append(begin, len(value)))
        other = known | (doc_id != np.repeat(doc_id[begin], sizes)) | (value == last if last is not None else False)
        repeats = np.repeat(np.logical_or.reduceat(other, begin), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c[repeats]) for c in columns[:4]], names=names)
        end = begin[-1]
        last, held = (value[-1], None) if repeats[-1] else (None, [c[end:].copy() for c in columns])


def _word_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as 16 bits of each word's hash, which is all that verification reads."""
    for chunk in batch_chunks(batches, "text"):
        codes = [c.tobytes() for c in word_lists(text_bytes(chunk.column("text")))[0]]
        yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("same"), pa.array(codes, pa.binary())], names=["doc_id", "same", "codes"])


def word_lists(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each text the words' 16-bit codes, first bytes and end bytes."""
    owner, starts, ends, hashes = hashed_words(texts)
    at = np.searchsorted(owner, np.arange(1, len(texts)))
    return [np.split(x, at) for x in ((hashes >> np.uint64(48)).astype(np.uint16), starts, ends)]


def mark(codes: bytes) -> int:
    """31 bits that tell the texts of one id apart."""
    return xxhash.xxh3_64_intdigest(codes) >> 33


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's windows with their words: whole runs and sides of them, linked inside the task or to be dealt on."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("codes")).to_numpy()
        for a, b in byte_chunks(sizes, 1 << 20):
            yield from _chunk_places(batch.slice(a, b - a))
    give_back()


def _chunk_places(chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = chunk.column("codes").to_pylist()
    ids, marks = chunk.column("doc_id").to_numpy(), np.array([mark(t) for t in texts], np.int64) << 32
    counts = np.array([len(t) // 2 for t in texts])
    yield _rows(SIZE, key=counts, doc_id=ids, place=marks)
    given = zip(chunk.column("same").to_pylist(), chunk.column("copies").to_pylist(), strict=True)
    leader = [next((x["first"] for x in copies or () if x["same"] == same), None) for same, copies in given]
    copy = np.array([x is not None for x in leader])
    if copy.any():
        yield _rows(LINK, doc_id=ids[copy], place=marks[copy], key=np.array([x for x in leader if x is not None], np.int64), length=counts[copy])
        chunk, ids, marks, counts, texts = chunk.filter(pa.array(~copy)), ids[~copy], marks[~copy], counts[~copy], [t for t, c in zip(texts, copy, strict=True) if not c]
    codes = np.frombuffer(b"".join(texts), np.uint16).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    lists = chunk.column("windows")
    window = lists.flatten()
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    value, at, shape = (window.field(c).to_numpy() for c in ("value", "at", "shape"))
    function, back, ahead = shape >> 12, shape & 63, shape >> 6 & 63
    inside = at + SIMILARITY_SHINGLE <= counts[text]  # another row's window, if the id repeats, may lie beyond
    ahead = np.minimum(ahead, counts[text] - SIMILARITY_SHINGLE - at)

    mine = np.flatnonzero(inside & (function == 0) & (back + ahead >= REACH))
    if len(mine):
        number = back[mine] + ahead[mine] - REACH + 1
        begin = first[text[mine]] + at[mine] - back[mine]
        run = np.unique(np.repeat(begin, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
        key, of = grams(codes, PASSAGE)[run].view(np.int64), owner[run]
        place, doc_id = marks[of] | (run - first[of]), ids[of]
        order = np.lexsort((place, doc_id, key))
        key, doc_id, place = key[order], doc_id[order], place[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        leader = np.repeat(doc_id[starts], np.diff(np.append(starts, len(key))))
        yield _links(*(c[doc_id != leader] for c in (doc_id, place, leader)))
        starts = starts[np.argsort(order[starts])]  # as they stand in the texts
        yield _rows(EQUAL, key=key[starts], doc_id=doc_id[starts], place=place[starts])

    # Of equal hashes side by side, as in a run of one word, the first has the whole window; those too short for a passage lie in it.
    mine = np.flatnonzero(inside & (function > 0) & (back + ahead >= REACH))
    if len(mine):
        mine = mine[np.lexsort((at[mine], ids[text[mine]], value[mine]))]
        begin, size = first[text[mine]] + at[mine] - back[mine], back[mine] + SIMILARITY_SHINGLE + ahead[mine]
        short = np.maximum(codes & np.uint64(255), np.uint64(1)).astype(np.uint8)
        words, check = np.zeros((len(mine), _SIDE), np.uint8), np.zeros(len(mine), np.uint32)
        for c in range(0, len(mine), 4096):
            columns = np.arange(_SIDE) - REACH + back[mine[c : c + 4096], None]
            taken = (columns >= 0) & (columns < size[c : c + 4096, None])
            where = np.where(taken, begin[c : c + 4096, None] + columns, 0)
            words[c : c + 4096] = np.where(taken, short[where], 0)
            check[c : c + 4096] = mix((np.where(taken, codes[where], np.uint64(0)) * _CHECK).sum(axis=1)) >> np.uint64(32)
        sides = Sides(value[mine], ids[text[mine]], marks[text[mine]] | at[mine], back[mine], ahead[mine], words, np.ones(len(mine), bool), check=check).once()
        links, others = sides.linked(ANCHORS)
        yield links
        yield sides.rows(EDITED, others)


def _rows(kind: int, **given: np.ndarray | pa.Array) -> pa.RecordBatch:
    n = len(given["doc_id"])
    types = {"kind": pa.int32(), "length": pa.int32(), "key": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "words": pa.binary()}
    given["kind"] = np.full(n, kind)
    given.setdefault("length", np.zeros(n, np.int32))
    arrays = [(given[c] if isinstance(given[c], pa.Array) else pa.array(given[c])).cast(t) if c in given else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(types))


def _links(doc_id: np.ndarray, place: np.ndarray, other_id: np.ndarray, length: np.ndarray | int = PASSAGE) -> pa.RecordBatch:
    """Links of ``length`` words at ``place``; those of neighbouring places to one document are one."""
    order = np.lexsort((place, other_id, doc_id))
    doc_id, place, other_id = doc_id[order], place[order], other_id[order]
    length = length[order] if isinstance(length, np.ndarray) else np.full(len(place), length)
    follows = (doc_id[1:] == doc_id[:-1]) & (other_id[1:] == other_id[:-1]) & (place[1:] - place[:-1] <= 1)
    begin = np.flatnonzero(np.concatenate(([True], ~follows))) if len(place) else np.zeros(0, np.int64)
    end = np.maximum.reduceat(place + length, begin) if len(begin) else begin
    return _rows(LINK, doc_id=doc_id[begin], place=place[begin], key=other_id[begin], length=end - place[begin])


class Sides:
    """Windows of edited passages, sorted by key, document and place, with the words around their nodes.

    ``words`` has a row of word codes of a byte for each window, the node beginning in column ``REACH``; ``back`` and
    ``ahead`` elements beside it belong to the window, the rest is zero. ``more`` has the further places of one text with the
    same words, as bytes: lines that a text repeats are one window. ``check`` is a hash of the words' whole codes, by which runs of
    two words are told apart that have a byte in common.
    """

    def __init__(self, key: np.ndarray, doc_id: np.ndarray, place: np.ndarray, back: np.ndarray, ahead: np.ndarray, words: np.ndarray, open: np.ndarray, more: np.ndarray | None = None, check: np.ndarray | None = None) -> None:
        self.key, self.doc_id, self.place, self.back, self.ahead, self.words, self.open = key, doc_id, place, back, ahead, words, open
        self.more = np.full(len(key), b"", object) if more is None else more
        self.check = np.zeros(len(key), np.uint32) if check is None else check

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Sides:
        words = batch.column("words").to_pylist()
        table = np.frombuffer(b"".join(w[:_PACKED] for w in words), np.uint8).reshape(-1, _PACKED)
        columns = (batch.column(c).to_numpy() for c in ("key", "doc_id", "place"))
        begin = np.where(batch.column("kind").to_numpy() == REST, _PACKED + _BITS, _PACKED).tolist()
        more = np.fromiter((w[k:] for w, k in zip(words, begin, strict=True)), object, len(words))
        check = np.ascontiguousarray(table[:, 2 + _SIDE :]).view(np.uint32).ravel()
        return cls(*columns, table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2 : 2 + _SIDE], batch.column("length").to_numpy() > 0, more, check)

    def hashed(self, beside: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
        """Of each window a hash of its key and words, and of what is ``beside`` them."""
        total = mix(self.key.view(np.uint64) ^ mix(beside)) + self.check
        for k in range(_SIDE):
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.words[:, k]
        return mix(total)

    def once(self) -> Sides:
        """The first of equal windows of one key and text, with the places of the others."""
        _, first, which = np.unique(self.hashed(self.doc_id.view(np.uint64) ^ mix((self.place >> 32).view(np.uint64))), return_index=True, return_inverse=True)
        again = np.flatnonzero(first[which] != np.arange(len(which)))
        again = again[np.argsort(first[which[again]], kind="stable")]
        begin = np.flatnonzero(np.diff(first[which[again]], prepend=-1))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(again)], strict=True) if len(again) else ():
            self.more[first[which[again[a]]]] = self.place[again[a:b]].tobytes()
        return self.take(np.sort(first))

    def take(self, rows: np.ndarray) -> Sides:
        return Sides(*(c[rows] for c in vars(self).values()))

    def after(self, other: Sides | None) -> Sides:
        mine, theirs = vars(self), vars(other) if other is not None else None
        return self if theirs is None else Sides(**{c: np.concatenate([theirs[c], mine[c]]) for c in mine})

    def rows(self, kind: int, chosen: np.ndarray) -> pa.RecordBatch:
        some = self.take(chosen)
        packed = np.concatenate([some.back[:, None], some.ahead[:, None], some.words, some.checked()], axis=1).astype(np.uint8)
        return _rows(kind, key=some.key, doc_id=some.doc_id, place=some.place, length=some.open.astype(np.int32), words=pa.array([r.tobytes() + m for r, m in zip(packed, some.more, strict=True)], pa.binary()))

    def rest(self, seen: Seen) -> pa.RecordBatch:
        """Those beyond the first ``ANCHORS`` of their key, once for all documents where key and words are equal, with bits of the shingles that many of these first have; ``length`` of open ones is how many
        different shingles they share at least with a window that holds such a passage, and ``_APART`` more if one of them isn't common."""
        rank = self.rank()
        chosen = np.flatnonzero(rank >= ANCHORS)
        chosen = chosen[seen.first(self.take(chosen))]
        some, first = self.take(chosen), self.take(np.flatnonzero((rank < ANCHORS) & np.isin(self.key, self.key[chosen])))
        codes, theirs = (keyed_shingles(x.words, x.key) for x in (some, first))
        values, counts = np.unique(theirs[theirs > 0], return_counts=True)
        common = np.isin(codes, values[counts >= _COMMON])
        first, last = _runs(common, SIMILARITY / (1 + SIMILARITY))  # as in ``may_align``
        common, enough = np.packbits(common, axis=1), last > first
        codes.sort(axis=1)
        repeats = ((codes[:, 1:] == codes[:, :-1]) & (codes[:, 1:] > 0)).sum(axis=1)
        # Of a run that stands at most so many places are not told by different shingles.
        least = np.maximum(1, np.ceil(SIMILARITY * (REACH + 1) - (1 + SIMILARITY) * repeats - 1e-6)).astype(np.int32)
        packed = np.concatenate([some.back[:, None], some.ahead[:, None], some.words, some.checked(), common], axis=1).astype(np.uint8)
        return _rows(REST, key=some.key, doc_id=some.doc_id, place=some.place, length=np.where(some.open, least + np.where(enough, 0, _APART), 0), words=pa.array([r.tobytes() + m for r, m in zip(packed, some.more, strict=True)], pa.binary()))

    def checked(self) -> np.ndarray:
        return np.ascontiguousarray(self.check)[:, None].view(np.uint8)

    def rank(self) -> np.ndarray:
        """Of each window how many of its key stand before it."""
        begin = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1])))
        return np.arange(len(self.key)) - np.repeat(begin, np.diff(np.append(begin, len(self.key))))

    def linked(self, rounds: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """Links of open windows to earlier ones, and which windows have no equal passage of an earlier one.

        Every round compares the open windows with the next of these others of their key, until none is open; linked ones are no longer open.
        """
        part, found, copied = np.arange(len(self.key)), [], np.zeros(len(self.key), bool)
        while len(part) and rounds:
            rounds -= 1
            key = self.key[part]
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(begin, len(part)))
            leaders = np.repeat(part[begin], sizes)
            asked = np.flatnonzero(self.open[part] & (self.doc_id[part] != self.doc_id[leaders]))
            copied[self.settle(part[asked], leaders[asked], found)] = True
            still = self.open[part]
            still[begin] = False
            going = np.repeat(np.logical_or.reduceat(still, begin), sizes) & ~copied[part]
            going[begin] = False
            part = part[going]
        return _joined(found), np.flatnonzero(~copied)

    def all_linked(self) -> pa.RecordBatch:
        """Links of open windows to the first earlier one of their key that holds such a passage, of all that may."""
        found: list[tuple] = []
        codes = keyed_shingles(self.words, self.key)
        own, other = self.partners(codes)
        numbers, first, last = numbered_shingles(codes)
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        end = np.append(begin[1:], len(own))
        width = 1  # others that a window is compared with at a time, more and more
        while len(begin):
            number = np.minimum(end - begin, width)
            k = np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())
            for c in range(0, len(k), 4096):
                i, j = own[k[c : c + 4096]], other[k[c : c + 4096]]
                cells = j[:, None] * first.shape[1] + numbers[i]
                near = _in_order(first.take(cells), last.take(cells))
                self.settle(i[near], j[near], found)
            begin, width = begin + number, width * 2
            going = begin < end
            going[going] = self.open[own[begin[going]]]
            begin, end = begin[going], end[going]
        return _joined(found)

    def partners(self, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each open window the earlier ones of its key and of other documents that share enough of its shingles (``codes``)."""
        n, codes = len(self.key), keyed_shingles(self.words, self.key) if codes is None else codes
        column = (codes >> np.uint64(64 - _COLUMNS.bit_length() + 1)).astype(np.int64) + np.arange(n)[:, None] * _COLUMNS
        row, code, often = distinct(codes)
        cell = row * _COLUMNS + (code >> np.uint64(64 - _COLUMNS.bit_length() + 1)).astype(np.int64)
        weights = np.bincount(cell, shingle_weights(often), n * _COLUMNS).astype(np.float32).reshape(n, _COLUMNS)
        held, begins, ends = np.zeros((3, n, _COLUMNS), np.float32)
        held.ravel()[cell] = 1
        for matrix, mask in zip((begins, ends), run_ends(codes), strict=True):
            matrix.ravel()[column[mask]] = 1
        first = np.searchsorted(self.key, self.key)  # of the key
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        asked = np.flatnonzero(self.open)
        for c in range(0, len(asked), 128):
            some = asked[c : c + 128]
            a, b = int(first[some[0]]), int(some[-1])
            theirs = held[a:b].T
            enough = weights[some] @ theirs >= _LEAST_WEIGHT
            for matrix in (begins, ends):
                enough &= matrix[some] @ theirs > 0
            i, j = np.nonzero(enough)
            i, j = some[i], j + a
            fits = (j < i) & (j >= first[i]) & (self.doc_id[i] != self.doc_id[j])
            found.append((i[fits], j[fits]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def settle(self, own: np.ndarray, other: np.ndarray, found: list[tuple]) -> np.ndarray:
        """Links of windows to the first of their others that they hold a passage of go to ``found``.

        They are no longer open, nor are windows with an equal passage of another before that; these are returned.
        """
        copies = [np.zeros(0, np.int64)]

        def note(i: np.ndarray, offset: np.ndarray, j: np.ndarray, length: np.ndarray) -> None:
            self.open[i] = False
            found.append((self.doc_id[i], self.place[i] + offset, self.doc_id[j], length))
            for k in np.flatnonzero(self.more[i] != b"").tolist():
                places = np.frombuffer(self.more[i[k]], np.int64)
                found.append(tuple(np.broadcast_to(c, len(places)) for c in (self.doc_id[i[k]], places + offset[k], self.doc_id[j[k]], length[k])))

        for c in range(0, len(own), 4096):
            todo, leader = own[c : c + 4096], other[c : c + 4096]
            todo, leader = todo[self.open[todo]], leader[self.open[todo]]
            copy, begins, ends, moved = self.compared(todo, leader)
            asked = np.flatnonzero(moved)
            pair, first, end = standing(self.words[todo[asked]], self.words[leader[asked]])
            moved[:] = False
            moved[asked[pair]] = True
            sure = np.flatnonzero(copy | (ends > begins) | moved)
            sure = sure[np.unique(todo[sure], return_index=True)[1]]
            k = sure[copy[sure]]
            copies.append(todo[k])
            self.open[todo[k]] = False
            k = sure[~copy[sure] & ~moved[sure]]
            note(todo[k], begins[k] - REACH, leader[k], ends[k] - begins[k])
            those = np.isin(asked[pair], sure)
            k = asked[pair[those]]
            note(todo[k], first[those] - REACH, leader[k], end[those] - first[those])
        return np.concatenate(copies)

    def own(self, i: int) -> np.ndarray:
        return self.words[i, REACH - self.back[i] : REACH + SIMILARITY_SHINGLE + self.ahead[i]]

    def compared(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which windows hold a passage of another as it is, the columns of one that is edited in place, and which are to be aligned.

        Equal words for a passage's length hold one, which is linked by its own hash. Without insertions and deletions both
        sides of a run have as many shingles, so that many of the run's must be equal in place. Of the others, those are
        left to ``standing`` that have enough shingles of the other window at all.
        """
        x, y = self.words[i], self.words[j]
        equal = (x == y) & (x > 0)
        copy = _leading(equal[:, REACH - 1 :: -1]) + _leading(equal[:, REACH + SIMILARITY_SHINGLE :]) + SIMILARITY_SHINGLE >= PASSAGE
        begin, end, moved = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        rest = np.flatnonzero(~copy & (equal.sum(axis=1) >= SIMILARITY * PASSAGE))
        first, last = _runs(_shingles_equal(equal[rest]), 2 * SIMILARITY / (1 + SIMILARITY))
        begin[rest], end[rest] = first, np.where(last > first, last + SIMILARITY_SHINGLE - 1, 0)
        rest = np.flatnonzero(~copy & (end == 0))
        moved[rest] = may_align(x[rest], y[rest])
        return copy, begin, end, moved


class Seen:
    """Windows of the last key so far, by a hash of their words: a window that an earlier document has as it is stands for nothing else."""

    def __init__(self) -> None:
        self.key, self.hashes, self.doc_id = (np.zeros(0, t) for t in (np.int64, np.uint64, np.int64))

    def first(self, sides: Sides) -> np.ndarray:
        """Which of further windows, sorted by key and document, no earlier document has."""
        columns = (self.key, sides.key), (self.hashes, sides.hashed()), (self.doc_id, sides.doc_id)
        key, hashes, doc_id = (np.concatenate(c) for c in columns)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = (doc_id == doc_id[first[which]])[len(self.key) :]
        last = first[key[first] == key[-1]] if len(key) else first
        self.key, self.hashes, self.doc_id = key[last], hashes[last], doc_id[last]
        return new


def _joined(found: list[tuple]) -> pa.RecordBatch:
    return _links(*([np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4))


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row the different values above zero, in order: their rows, the values, and how often the row has each."""
    values = np.sort(codes, axis=1)
    first = values > 0
    first[:, 1:] &= values[:, 1:] != values[:, :-1]
    at = np.flatnonzero(first)
    row = at // codes.shape[1]
    end = np.append(at[1:], codes.size)
    return row, values.ravel()[at], np.minimum(end, (row + 1) * codes.shape[1]) - at


def shingle_weights(often: np.ndarray) -> np.ndarray:
    """Of shingles that a window has so often, weights whose sum over all that another has too is ``_LEAST_WEIGHT`` at least, if it holds such a passage.

    Of a run that stands, the shared places are ``SIMILARITY`` at least of its own and the other's span without them, and that span
    has as many places as different shingles are shared; copies and runs edited in place share more.
    """
    return (1 + SIMILARITY) * often - SIMILARITY


def run_ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's shingles where a run of a passage's length may begin, and where one may end: it does both with a shared shingle."""
    inside, n = codes > 0, codes.shape[1]
    first, last = np.argmax(inside, axis=1)[:, None], n - 1 - np.argmax(inside[:, ::-1], axis=1)[:, None]
    return inside & (np.arange(n) <= last - REACH), inside & (np.arange(n) >= first + REACH)


def keyed_shingles(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each row of words the hashes of its shingles under its key; zero outside of the window."""
    n = words.shape[1] - SIMILARITY_SHINGLE + 1
    codes = sum(words[:, k : k + n].astype(np.uint64) << np.uint64(8 * k) for k in range(SIMILARITY_SHINGLE))
    inside = (words[:, :n] > 0) & (words[:, SIMILARITY_SHINGLE - 1 :] > 0)
    return np.where(inside, np.maximum(mix(codes ^ key.view(np.uint64)[:, None]), np.uint64(1)), np.uint64(0))


def numbered_shingles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of shingles' hashes their numbers, zero for those of no other row, and of each number the first and last column where it is, from 1 on."""
    values, counts = np.unique(distinct(codes)[1], return_counts=True)
    shared = np.append(values[counts > 1], np.uint64(0))
    at = np.searchsorted(shared[:-1], codes)
    width = min(len(shared), max(_BUCKETS, _CELLS // max(1, len(codes))))  # beyond that some share a number, which lets more pairs through
    numbers = np.where((codes > 0) & (shared[at] == codes), 1 + at % max(1, width - 1), 0)
    return numbers, *_columns(numbers, *np.zeros((2, len(codes), max(2, width)), np.uint8))


def may_align(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of words have a run that ``alike`` may find to stand in the other's row; all that it finds are among them.

    Of a run that stands, the places whose shingles the other side holds are ``SIMILARITY`` of its own and the other's
    together; the other side has as many places as the run has different shingles of it, and one at least.
    """

    def shingles(words: np.ndarray) -> np.ndarray:
        n = words.shape[1] - SIMILARITY_SHINGLE + 1
        total = np.zeros((len(words), n), np.uint32)
        for k in range(SIMILARITY_SHINGLE):
            total += words[:, k : k + n] * _TIMES[k]
        bucket = np.maximum(total >> np.uint32(33 - _BUCKETS.bit_length()), 1).astype(np.intp)
        return np.where((words[:, :n] > 0) & (words[:, SIMILARITY_SHINGLE - 1 :] > 0), bucket, 0)

    out = np.zeros(len(x), bool)
    for c in range(0, len(x), 1024):
        mine, theirs = shingles(x[c : c + 1024]), shingles(y[c : c + 1024])
        first, last = _columns(theirs, *np.zeros((2, len(mine), _BUCKETS), np.uint8))
        first, last = np.take_along_axis(first, mine, axis=1), np.take_along_axis(last, mine, axis=1)
        some = np.flatnonzero(_in_order(first, last))
        if len(some):
            out[c + some[_often_enough(mine[some], first[some] > 0)]] = True
    return out


def _columns(buckets: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of rows and buckets, filled with the first and last column of each bucket, from 1 on."""
    rows, n = np.arange(len(buckets)), buckets.shape[1]
    for k in range(n):  # column by column, so that the order of writing is known
        last[rows, buckets[:, k]] = k + 1
        first[rows, buckets[:, n - 1 - k]] = n - k
    first[:, 0] = last[:, 0] = 0
    return first, last


def _in_order(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of rows of places with the least and greatest place there of each, zero for none: which have a run that may stand.

    The other side's span is no less than from the first place there of the run's first shingle to that of its last one. Copies and
    runs edited in place pass too.
    """
    n, hit = first.shape[1], first > 0
    total = np.cumsum(hit, axis=1, dtype=np.float32) * np.float32(1 + SIMILARITY) - np.float32(SIMILARITY) * np.arange(n, dtype=np.float32)
    ends = np.where(hit, total - np.float32(SIMILARITY) * first, np.float32(-np.inf))[:, REACH:]
    begins = np.where(hit, total - np.float32(SIMILARITY) * last, np.float32(np.inf))[:, : n - REACH]
    return (ends >= np.minimum.accumulate(begins, axis=1) + np.float32(SIMILARITY - 1 - 1e-3)).any(axis=1)


def _often_enough(mine: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which rows of buckets have a run that may stand by how many places of it are hit, and how many different ones."""
    first, last = _runs(hits, SIMILARITY / (1 + SIMILARITY))
    out = last > first
    some = np.flatnonzero(out)
    if not len(some):
        return out
    # Of a run that stands, the other side has a place for each different shingle: places of the first of a shingle count for less.
    mine = mine[some]
    earliest, _ = _columns(mine, *np.zeros((2, len(some), _BUCKETS), np.uint8))
    once = np.take_along_axis(earliest, mine, axis=1) == np.arange(1, mine.shape[1] + 1)
    first, last = _runs(hits[some], SIMILARITY, np.where(once, np.float32(1), np.float32(1 + SIMILARITY)))
    out[some] = last > first
    return out


def standing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``alike`` finds for each pair of rows of words: the pair's number, and first and end column of each run of words in ``x``.

    Every run of a passage's length holds the column ``REACH`` and so is two parts, before it and from it on.
    """
    found = [(np.zeros(0, np.int64),) * 3]
    for c in range(0, len(x), 256):
        a, b = (plain_shingles(w[c : c + 256]) for w in (x, y))
        same = (a[:, :, None] == b[:, None, :]) & (a > 0)[:, :, None]
        hit = same.any(axis=2)
        there = same.argmax(axis=2).astype(np.int16)
        low, high = np.where(hit, there, np.int16(_SIDE)), np.where(hit, there, np.int16(-1))
        left, right = slice(REACH, None, -1), slice(REACH, None)
        span = np.maximum(np.maximum.accumulate(high[:, left], axis=1)[:, :, None], np.maximum.accumulate(high[:, right], axis=1)[:, None, :])
        span -= np.minimum(np.minimum.accumulate(low[:, left], axis=1)[:, :, None], np.minimum.accumulate(low[:, right], axis=1)[:, None, :])
        both = np.cumsum(hit[:, left], axis=1, dtype=np.int16)[:, :, None] + np.cumsum(hit[:, right], axis=1, dtype=np.int16)[:, None, :]
        both -= hit[:, REACH, None, None]
        stands = hit[:, left, None] & hit[:, None, right] & (_OWN >= REACH + 1)
        stands &= both >= _ENOUGH[np.clip(_OWN + span + 1 - both, 0, len(_ENOUGH) - 1)]
        pair, begin = np.nonzero(stands.any(axis=2)[:, ::-1])
        last = stands.shape[2] - 1 - np.argmax(stands[pair, REACH - begin, ::-1], axis=1)
        edges = np.zeros((len(hit), _SIDE + 1), np.int64)
        np.add.at(edges, (pair, begin), 1)
        np.add.at(edges, (pair, REACH + last + SIMILARITY_SHINGLE), -1)
        inside = np.cumsum(edges, axis=1) > 0
        change = np.diff(inside.astype(np.int8), axis=1, prepend=0)
        (pair, first), (_, end) = np.nonzero(change > 0), np.nonzero(change < 0)
        found.append((pair + c, first, end))
    return tuple(np.concatenate(k) for k in zip(*found, strict=True))


def plain_shingles(words: np.ndarray) -> np.ndarray:
    """Of each row of words its five-word shingles, in their columns; zero outside of the window."""
    n = words.shape[1] - SIMILARITY_SHINGLE + 1
    inside = (words[:, :n] > 0) & (words[:, SIMILARITY_SHINGLE - 1 :] > 0)
    return np.where(inside, sum(words[:, k : k + n].astype(np.uint64) << np.uint64(8 * k) for k in range(SIMILARITY_SHINGLE)), np.uint64(0))


def _leading(equal: np.ndarray) -> np.ndarray:
    """How many values each row begins with that are true."""
    apart = ~equal
    at = np.argmax(apart, axis=1)
    return np.where(apart[np.arange(len(at)), at], at, apart.shape[1])


def _shingles_equal(words: np.ndarray) -> np.ndarray:
    """Where ``SIMILARITY_SHINGLE`` words in a row are equal."""
    n = words.shape[1] - SIMILARITY_SHINGLE + 1
    out = words[:, :n].copy()
    for k in range(1, SIMILARITY_SHINGLE):
        out &= words[:, k : k + n]
    return out


def _runs(equal: np.ndarray, share: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the reach of runs of a passage's length and more of which that ``share`` is equal, both ends included; empty if none.

    With ``weights``, equal places count by these instead of once.
    """
    n = equal.shape[1]
    first, last = np.zeros(len(equal), np.int64), np.zeros(len(equal), np.int64)
    weights = equal if weights is None else equal * weights
    some = np.flatnonzero(weights.sum(axis=1) >= share * (REACH + 1) - 1e-4)
    if not len(some):
        return first, last
    equal, weights = equal[some], weights[some]
    total = np.cumsum(weights - np.float32(share), axis=1, dtype=np.float32)
    before = np.where(equal, total - (weights - np.float32(share)) - np.float32(1e-4), np.float32(np.inf))  # of runs that begin here
    after = np.where(equal, total, np.float32(-np.inf))  # of runs that end here
    ends = after[:, REACH:] >= np.minimum.accumulate(before[:, : n - REACH], axis=1)
    begins = before[:, : n - REACH] <= np.maximum.accumulate(after[:, : REACH - 1 : -1], axis=1)[:, ::-1]
    any_ = ends.any(axis=1)
    first[some] = np.where(any_, np.argmax(begins, axis=1), 0)
    last[some] = np.where(any_, n - np.argmax(ends[:, ::-1], axis=1), 0)
    return first, last


def alike(mine: np.ndarray, other: np.ndarray, similarity: float = SIMILARITY, passage: int = PASSAGE) -> list[tuple[int, int]]:
    """Runs of words of ``mine`` that are near-duplicate passages of words in ``other``.

    Shingles that both hold are matched. A run from one match to another stands if it has ``passage`` words and its shingles
    have a Jaccard similarity of ``similarity`` with those of the other side between its first and last match there, counted
    by places; all runs that stand are merged.
    """
    a, b = shingles_of(mine), shingles_of(other)
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    place = np.minimum(np.searchsorted(b[order], a), len(b) - 1)
    at = np.flatnonzero(b[order[place]] == a)
    if not len(at):
        return []
    there = np.broadcast_to(order[place[at]], (len(at), len(at)))
    upper = np.triu(np.ones((len(at), len(at)), bool))
    low = np.minimum.accumulate(np.where(upper, there, len(b)), axis=1)
    high = np.maximum.accumulate(np.where(upper, there, -1), axis=1)
    both = np.cumsum(upper, axis=1)
    own = at[None, :] - at[:, None] + 1
    stands = upper & (own >= passage - SIMILARITY_SHINGLE + 1) & (both >= similarity * (own + high - low + 1 - both))
    hit = np.zeros(len(mine), bool)
    for i in np.flatnonzero(stands.any(axis=1)).tolist():
        hit[at[i] : at[np.flatnonzero(stands[i])[-1]] + SIMILARITY_SHINGLE] = True
    return spans_of(hit)


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Five-word shingles of words given by codes of a byte."""
    n = len(words) - SIMILARITY_SHINGLE + 1
    total = np.zeros(max(0, n), np.int64)
    for i in range(SIMILARITY_SHINGLE if n > 0 else 0):
        total = total << 8 | words[i : i + n].astype(np.int64)
    return total


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, key, document and place: links to the first of each key, which may have come batches before."""
    last, leader = None, 0
    open_sides: Sides | None = None
    seen = Seen()
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        done = batch.filter(pa.array(kind >= LINK))
        if done.num_rows:
            yield done
        rest = batch.filter(pa.array(kind == EQUAL))
        if rest.num_rows:
            key, doc_id, place = (rest.column(c).to_numpy() for c in ("key", "doc_id", "place"))
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            first = doc_id[begin].copy()
            if key[0] == last:
                first[0] = leader
            leaders = np.repeat(first, np.diff(np.append(begin, len(key))))
            last, leader = key[-1], leaders[-1]
            copies = doc_id != leaders
            if copies.any():
                yield _links(doc_id[copies], place[copies], leaders[copies])
        rest = batch.filter(pa.array(kind == EDITED))
        if rest.num_rows:
            sides = Sides.of(rest).after(open_sides)
            links, others = sides.linked(ANCHORS)
            if links.num_rows:
                yield links
            sides, end = sides.take(others), sides.key[-1]
            rank = sides.rank()
            if (rank >= ANCHORS).any():
                yield sides.rest(seen)
            open_sides = sides.take(np.flatnonzero((sides.key == end) & (rank < ANCHORS)))
    give_back()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each window the shingles by which it may meet another, uncommon ones first, and which of them an open one asks by.

    The first one that two share is followed by all others that they share. So it is followed by enough weight of the one that asks, and
    in the other by ``least`` - 1 more. What is ``apart`` shares an uncommon one. Where the other has all of its uncommon ones here,
    it is enough to ask by those where a run may begin, or end, if all of these are uncommon.
    """
    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            batch = whole.slice(a, 4096)
            table = np.frombuffer(b"".join(w[: _PACKED + _BITS] for w in batch.column("words").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            codes = keyed_shingles(table[:, 2 : 2 + _SIDE], batch.column("key").to_numpy())
            common = np.unpackbits(table[:, _PACKED:], axis=1)[:, : codes.shape[1]].astype(np.uint64)
            order = np.where(codes > 0, np.maximum(codes >> np.uint64(1), np.uint64(1)) | common << np.uint64(63), np.uint64(0))
            row, value, often = distinct(order)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            after = first[row + 1] - np.arange(len(row))  # this one and those that follow
            total = np.append(0, np.cumsum(shingle_weights(often)))
            rare = value < np.uint64(1 << 63)
            length, apart = batch.column("length").to_numpy(), batch.column("apart").to_numpy(zero_copy_only=False)
            asks = (length[row] > 0) & (total[first[row + 1]] - total[:-1] >= _LEAST_WEIGHT) & (rare | (length[row] <= _APART))
            least = batch.column("least").to_numpy()
            for mask in run_ends(codes):
                those = np.where(mask, order, np.uint64(0))
                by_these = (least == 1) & ~((those >= np.uint64(1 << 63)).any(axis=1))
                mine, own, _ = distinct(those)
                fewer = by_these & (np.bincount(mine, minlength=len(least)) < np.bincount(row[asks], minlength=len(least)))
                fewer &= length > 0
                among = np.isin(mix(value ^ mix(row.astype(np.uint64))), mix(own ^ mix(mine.astype(np.uint64))))
                asks = np.where(fewer[row], among, asks)
            held = (after >= least[row]) & (rare | ~apart[row])
            some = np.flatnonzero(asks | held)
            arrays = [value[some].view(np.int64), batch.column("id").to_numpy()[row[some]], asks[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in arrays], names=["key", "id", "asks"])
    give_back()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows under the shingles that they share with another, where one of them asks."""
    for batch in by_key(batches, "key"):
        key, ids, asks = batch.column("key").to_numpy(), batch.column("id").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(begin, len(key)))
        keep = np.repeat((sizes > 1) & np.logical_or.reduceat(asks, begin), sizes)
        blocks = np.repeat(-(-sizes // BLOCK), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, ids, asks, blocks)], names=["shingle", "id", "asks", "blocks"])


def _rest_links(rest: DataFrame) -> DataFrame:
    """Links of the open windows of larger keys: those of one key are compared, of very large keys those that share a shingle, in pairs of blocks if they are many."""
    least = rest.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("length") > 0, F.col("length") % _APART)).alias("least"), (F.min(F.when(F.col("length") > 0, F.col("length"))) > _APART).alias("apart")
    ).filter("least is not null")
    placed = rest.join(least, "key")
    columns = ["kind", "length", "key", "doc_id", "place", "words"]
    whole = placed.filter(F.col("n") <= WHOLE).select(columns)
    large = placed.filter(F.col("n") > WHOLE).withColumn("id", F.xxhash64("key", "doc_id", "place"))
    signatures = large.select("key", "id", "length", "least", "apart", "words").mapInArrow(_signatures, "key long, id long, asks boolean")
    shared = signatures.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "shingle long, id long, asks boolean, blocks long")
    own, other = F.pmod("id", F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = shared.join(large.select("id", "kind", "doc_id", "place", "words"), "id").withColumn("own", own).withColumn("other", other)
    group = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    parts = met.select("kind", F.col("asks").cast("int").alias("length"), group.alias("key"), "doc_id", "place", "words")
    # By number, since work grows with pairs: few bytes are no reason to take tasks together.
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = whole.unionByName(parts).repartition(tasks, "key").sortWithinPartitions("key", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_key(batches, "key"):
            for part in key_parts(batch, 1024):
                links = Sides.of(part).all_linked()
                if links.num_rows:
                    yield links
        give_back()

    return dealt.mapInArrow(run, ROWS)


def key_parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch sorted by key in parts of about so many rows; those of one key stay together."""
    key = batch.column("key").to_numpy()
    begin = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key)).tolist()
    a = 0
    for b, after in zip(begin[1:], [*begin[2:], len(key) + rows], strict=True):
        if after - a > rows:
            yield batch.slice(a, b - a)
            a = b


FOUND = "doc_id long, texts array<struct<mark:long,n_words:long,n_repeated:long,passages:array<struct<first:int,end:int>>,other_ids:array<long>>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links sorted by document and place, merged to a row for each document with any."""
    kind = pa.list_(pa.struct([("mark", pa.int64()), ("n_words", pa.int64()), ("n_repeated", pa.int64()), ("passages", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), ("other_ids", pa.list_(pa.int64()))]))
    now: int | None = None
    texts: dict[int, tuple[int, list[list[int]], set[int]]] = {}

    def row(doc_id: int) -> tuple | None:
        out = []
        for key, (n, spans, others) in sorted(texts.items()):
            if spans:
                out.append({"mark": key, "n_words": n, "n_repeated": sum(b - a for a, b in spans), "passages": [{"first": a, "end": b} for a, b in spans], "other_ids": sorted(others)})
        return (doc_id, out) if out else None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind)], names=["doc_id", "texts"])

    for batch in batches:
        found = []
        for what, key, doc_id, place, length in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "doc_id", "place", "length")), strict=True):
            if doc_id != now:
                found.append(row(now))
                now, texts = doc_id, {}
            held = texts.get(place >> 32)
            if held is None:
                held = texts[place >> 32] = (key if what == SIZE else 0, [], set())
            if what == LINK:
                start = place & 0xFFFFFFFF
                if held[1] and start <= held[1][-1][1]:
                    held[1][-1][1] = max(held[1][-1][1], start + length)
                else:
                    held[1].append([start, start + length])
                held[2].add(key)
        rows = [r for r in found if r]
        if rows:
            yield packed(rows)
    final = row(now)
    if final:
        yield packed([final])


def _copies(texts: DataFrame) -> DataFrame:
    """Per ``doc_id`` the hashes of its texts that a smaller id has too, and the least such id."""
    hashes = save(texts.select("doc_id", F.xxhash64("text").alias("same"), F.xxhash64(F.lit("text"), "text").alias("again")), "texts")
    first = hashes.groupBy("same", "again").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("same", "again", "first")
    copies = hashes.join(first, ["same", "again"]).filter(F.col("doc_id") > F.col("first"))
    return copies.groupBy("doc_id").agg(F.collect_set(F.struct("same", "first")).alias("copies"))


def found_passages(texts: DataFrame) -> DataFrame:
    """Per ``doc_id`` of ``texts`` (doc_id, text) with near-duplicate passages of smaller ids: these passages, text by text."""
    texts = texts.filter("doc_id is not null and text is not null")
    windows = texts.mapInArrow(_windows, WINDOWS)
    dealt = windows.repartition(F.when(F.col("dealt"), F.col("value")).otherwise(F.xxhash64("doc_id"))).sortWithinPartitions("value", "doc_id", "at")
    repeated = dealt.mapInArrow(_repeated, "value long, doc_id long, at int, shape int")
    by_doc = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("value", "at", "shape")).alias("windows"))
    codes = texts.withColumn("same", F.xxhash64("text")).mapInArrow(_word_codes, "doc_id long, same long, codes binary")
    sides = by_doc.join(codes, "doc_id").join(_copies(texts), "doc_id", "left").select("doc_id", "same", "codes", "windows", "copies")
    rows = sides.mapInArrow(_places, ROWS)
    keyed = rows.repartition(F.when(F.col("kind") < LINK, F.col("key")).otherwise(F.xxhash64("doc_id"))).sortWithinPartitions("kind", "key", "doc_id", "place")
    settled = save(keyed.mapInArrow(_settled, ROWS), "links")
    links = settled.filter(F.col("kind") != REST).unionByName(_rest_links(settled.filter(F.col("kind") == REST))).drop("words")
    # A text's size sorts before its links.
    return links.repartition("doc_id").sortWithinPartitions("doc_id", F.col("kind") != SIZE, "place").mapInArrow(_merged, FOUND)


PASSAGES = "doc_id long, n_words long, n_repeated long, passages array<struct<first:int,end:int>>, other_ids array<long>"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with passages that near-duplicate those of smaller ids: the words, and these documents.

    Rows that repeat an id and text are one; rows of one id and other texts have a row each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return found_passages(texts).select("doc_id", F.inline("texts")).drop("mark")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with near-duplicate passages cut from every document but the one of smallest id that holds them."""
    schema = docs.schema
    found = found_passages(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, sides = pa.RecordBatch.from_struct_array(batch.column("row")), batch.column("texts")
            place = schema.names.index(text_col)
            asked = [k for k, held in enumerate(sides) if held.is_valid]
            if asked:
                texts = own.column(place).to_pylist()
                sizes = np.array([len(texts[k] or "") for k in asked])
                for a, b in byte_chunks(sizes):
                    whole = [(texts[k] or "").encode() for k in asked[a:b]]
                    for k, text, codes, starts, ends in zip(asked[a:b], whole, *word_lists(whole), strict=True):
                        mine = mark(codes.tobytes())
                        for held in sides[k].as_py():
                            if held["mark"] == mine:
                                texts[k] = cut(text, [(int(starts[x["first"]]), int(ends[x["end"] - 1])) for x in held["passages"]]).decode()
                own = own.set_column(place, own.schema.field(place), pa.array(texts, own.column(place).type))
            yield own
        give_back()

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return keyed.join(found, "doc_id", "left").select("row", "texts").mapInArrow(run, schema)
