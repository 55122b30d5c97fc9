"""Known names in texts: whole words, in any case and in either Unicode normal form, the longest name first.

Names and texts are brought to one form: each character decomposed and folded by itself, runs of blanks as one. Names of up to
``BLOCK_CHARS`` characters in all are one Aho-Corasick automaton, broadcast to the tasks that read the texts. More names meet the texts by
equality: a name that begins and ends where a token (a word, or another character) does is looked for as so many tokens in a row, for each number of
tokens that a name has. Texts are read once; a bit set of bounded size, of first tokens and of whole names, tells there which rows of
tokens may be a name, and only those are joined with the names. Names that can begin or end inside a word, as with a mark that doesn't
combine, go by automata of bounded size, one after the other. Places are kept through the change of form, and a match has to begin
and end where a character of the text does.

Defined cases: null and blank names are ignored, names that differ in form only are one; a null text has none; blanks inside a name stand
for any run of blanks; a name that begins or ends with a letter or digit isn't found inside a longer word, any other is found
anywhere; of names that begin at one place the longest counts.
"""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.operators.tables import saved

#: Characters of the names of one automaton.
BLOCK_CHARS = 2_000_000
#: Places of the names found in a text, before overlaps are settled: first and end character, the longest name at each start.
PLACES = "array<struct<start:int,end:int>>"
#: Bits of the set by which rows of tokens are looked up: 16 MB, broadcast.
MARK_BITS = 1 << 27
_BUCKET = 1 << 15  # bits of one of Spark's bitmaps

# What Unicode calls white space.
_BLANKS = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    """One character decomposed, each part folded if that leaves one character; any blank as a space."""
    if c in _BLANKS:
        return " "
    out = ""
    for part in unicodedata.normalize("NFD", c):
        low = part.casefold()
        low = low if len(low) == 1 else part.lower()
        out += low if len(low) == 1 else part
    return out


def form(text: str) -> tuple[str, np.ndarray | None]:
    """The text in the common form, and the place in the text of each of its characters and of its end (none: the same)."""
    if text.isascii() and not any(a in text for a in ("  ", "\t", "\n", "\r", "\x0b", "\x0c")):
        return text.lower(), None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    unlike, which = np.unique(codes, return_inverse=True)
    folded = [_folded(chr(c)) for c in unlike.tolist()]
    blank = np.array([f == " " for f in folded])[which]
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    formed = codes[keep].tobytes().decode("utf-32-le", "surrogatepass").translate(dict(zip(unlike.tolist(), folded, strict=True)))
    sizes = np.array([len(f) for f in folded])[which]
    return formed, np.append(np.repeat(np.flatnonzero(keep), sizes[keep]), len(text))


@lru_cache(maxsize=1 << 16)
def _wordish(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or c in "‌‍"


def _opens(c: str) -> bool:
    return c.isalnum() or c == "_"


def formed_name(name: str | None) -> str:
    """A name in the common form, without blanks around it."""
    return form(unicodedata.normalize("NFC", " ".join((name or "").split())))[0]


class _Kinds(dict):
    """For ``translate``: ``a`` for what words are made of, a blank for all else."""

    def __missing__(self, code: int) -> str:
        self[code] = "a" if _wordish(chr(code)) else " "
        return self[code]


_KINDS = _Kinds()


def token_starts(formed: str) -> np.ndarray:
    """Where the tokens of a text in the common form begin, and its end: a run of what words are made of is one, as is any other character."""
    word = np.frombuffer(formed.translate(_KINDS).encode(), np.uint8) == ord("a")
    begins = np.ones(len(word), bool)
    begins[1:] = ~(word[1:] & word[:-1])
    return np.append(np.flatnonzero(begins), len(word))


def _ends(name: str) -> tuple[bool, bool]:
    """Whether a name in the common form begins and ends as words do."""
    whole = unicodedata.normalize("NFC", name)
    return _opens(whole[0]), _opens(whole[-1])


def _of_tokens(name: str) -> bool:
    """Whether a name can stand only where tokens begin and end."""
    opens, closes = _ends(name)
    return (opens or not _wordish(name[0])) and (closes or not _wordish(name[-1]))


def automaton(names: list[str]) -> ahocorasick.Automaton:
    """Of names in the common form, with their length and whether they begin and end as words do."""
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, (len(name), *_ends(name)))
    found.make_automaton()
    return found


def places(text: str | None, found: ahocorasick.Automaton) -> list[tuple[int, int]]:
    """First and end character of the longest name at each place of the text where one begins."""
    formed, at = form(text or "")
    best: dict[int, int] = {}
    for last, (size, opens, closes) in found.iter(formed) if formed else ():
        a, b = last + 1 - size, last + 1
        if opens and a and _wordish(formed[a - 1]) or closes and b < len(formed) and _wordish(formed[b]):
            continue
        if at is not None:
            inside = a and at[a] == at[a - 1] or b < len(formed) and at[b] == at[b - 1]
            if inside:  # in the midst of a character
                continue
            a, b = int(at[a]), int(at[b - 1]) + 1
        best[a] = max(best.get(a, 0), b)
    return sorted(best.items())


def _unlike(names: DataFrame, name: str) -> DataFrame:
    """``n``: the names in the common form, each once."""
    shape = F.pandas_udf(lambda s: s.map(formed_name), "string")
    return names.select(shape(F.col(name)).alias("n")).filter("n <> ''").distinct()


def _dealt(unlike: DataFrame) -> list[list[str]]:
    total = unlike.agg(F.sum(F.length("n"))).first()[0] or 0
    count = -(-total * 3 // (2 * BLOCK_CHARS))  # a hash deals them unevenly
    dealt = unlike.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(max(1, count))))
    return [found for b in range(count) if (found := [r.n for r in dealt.filter(F.col("b") == b).select("n").toLocalIterator()])]


def blocks(names: DataFrame, name: str = "name") -> list[list[str]]:
    """The names in the common form, in blocks of at most ``BLOCK_CHARS`` characters (a longer one alone), one read at a time."""
    return _dealt(_unlike(names, name))


def with_places(docs: DataFrame, names: DataFrame, text: str = "text", name: str = "name", out: str = "name_places") -> DataFrame:
    """``docs`` with the places of known names in their texts; few names need no shuffle."""
    unlike = saved(_unlike(names, name), "names")
    if (unlike.agg(F.sum(F.length("n"))).first()[0] or 0) > BLOCK_CHARS:
        shaped = F.pandas_udf(lambda s: s.map(lambda n: len(token_starts(n)) - 1 if _of_tokens(n) else 0), "int")
        first = F.pandas_udf(lambda s: s.map(lambda n: n[: token_starts(n)[1]]), "string")
        shapes = saved(unlike.select("n", shaped("n").alias("size"), first("n").alias("head")), "name-shapes")
        found = _looked_up(docs, shapes.filter("size > 0"), text, out)
        unlike = shapes.filter("size = 0").select("n")
    else:
        found = docs.withColumn(out, F.array().cast(PLACES))
    for block in _dealt(unlike):
        found = _marked(found, found.sparkSession.sparkContext.broadcast(block), text, out)
    return found


def _bit(kind: str, token: str) -> int:
    return zlib.crc32((kind + token).encode()) & (MARK_BITS - 1)


def _bits(shapes: DataFrame) -> bytearray:
    """The bit set of whole names and of their first tokens."""
    marks = shapes.select(F.explode(F.array(F.concat(F.lit("n"), "n"), F.concat(F.lit("h"), "head"))).alias("m"))
    at = marks.select(F.crc32(F.encode("m", "utf-8")).bitwiseAND(F.lit(MARK_BITS - 1)).alias("h"))
    held = bytearray(MARK_BITS // 8)
    width = _BUCKET // 8
    buckets = at.groupBy(F.shiftright("h", 15).alias("b")).agg(F.bitmap_construct_agg(F.col("h") % _BUCKET).alias("bits"))
    for row in buckets.toLocalIterator():
        part = bytes(row.bits)[: max(0, min(width, len(held) - row.b * width))]
        held[row.b * width : row.b * width + len(part)] = part
    return held


def _looked_up(docs: DataFrame, shapes: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the places of names (``n``, the number of its tokens as ``size``, and its first token as ``head``) that meet them by equality."""
    sizes = sorted(r["size"] for r in shapes.select("size").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(bytes(_bits(shapes)))
    rows = saved(docs.drop(out).withColumn("_row", F.monotonically_increasing_id()), "texts")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, heads = bits.value, {}
        for batch in batches:
            ids, starts, ends, names = [], [], [], []
            for i in range(batch.num_rows):
                for a, b, n in may_be_names(batch.column(1)[i].as_py(), sizes, held, heads):
                    ids.append(batch.column(0)[i].as_py())
                    starts.append(a)
                    ends.append(b)
                    names.append(n)
                if len(heads) > 1 << 18:
                    heads.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(names, pa.string())], names=["_row", "start", "end", "n"])

    maybe = rows.select("_row", F.col(text)).mapInArrow(look, "_row long, start int, end int, n string")
    longest = maybe.join(shapes.select("n"), "n", "left_semi").groupBy("_row", "start").agg(F.max("end").alias("end"))
    found = longest.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(out))
    # A number of tasks of its own: what is done with texts and places costs more than their bytes tell.
    spark = docs.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(width, "_row").join(found, "_row", "left").withColumn(out, F.coalesce(out, F.array().cast(PLACES))).drop("_row")


def may_be_names(text: str | None, sizes: list[int], bits: bytes, heads: dict[str, bool]) -> Iterator[tuple[int, int, str]]:
    """First and end character and common form of the rows of so many tokens whose bits are set; ``heads`` remembers first tokens."""

    def is_set(kind: str, token: str) -> bool:
        h = _bit(kind, token)
        return bits[h >> 3] >> (h & 7) & 1 == 1

    formed, at = form(text or "")
    cuts = token_starts(formed).tolist()
    for i in range(len(cuts) - 1):
        a = cuts[i]
        head = formed[a : cuts[i + 1]]
        known = heads.get(head)
        if known is None:
            known = heads[head] = is_set("h", head)
        if not known:
            continue
        for size in sizes:
            if i + size >= len(cuts):
                break
            b = cuts[i + size]
            name = formed[a:b]
            if not is_set("n", name):
                continue
            opens, closes = _ends(name)
            if opens and a and _wordish(formed[a - 1]) or closes and b < len(formed) and _wordish(formed[b]):
                continue
            if at is None:
                yield a, b, name
            elif not (a and at[a] == at[a - 1] or b < len(formed) and at[b] == at[b - 1]):  # not in the midst of a character
                yield int(at[a]), int(at[b - 1]) + 1, name


_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def _marked(docs: DataFrame, block, text: str, out: str) -> DataFrame:  # noqa: ANN001
    schema, key = docs.schema, uuid.uuid4().hex
    number = docs.columns.index(out)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()  # a worker holds one at a time
            _AUTOMATA[key] = automaton(block.value)
        found = _AUTOMATA[key]
        for batch in batches:
            merged = []
            for t, before in zip(batch.column(text).to_pylist(), batch.column(number).to_pylist(), strict=True):
                best = {p["start"]: p["end"] for p in before}
                for a, b in places(t, found):
                    best[a] = max(best.get(a, 0), b)
                merged.append([{"start": a, "end": b} for a, b in sorted(best.items())])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:number], pa.array(merged, kind), *batch.columns[number + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(mark, T.StructType(schema.fields))


def masked_entities(entities: DataFrame, mask) -> DataFrame:  # noqa: ANN001
    """Known entities (name, aliases) with every name masked; an alias that masks to the name, or to an earlier alias, is kept once.

    Null aliases are dropped, and a null array stays null.
    """
    name = mask(F.col("name"))
    aliases = F.array_remove(F.array_distinct(F.transform(F.array_compact("aliases"), mask)), name)
    return entities.withColumn("aliases", F.when(F.col("name").isNull(), F.array_distinct(F.transform(F.array_compact("aliases"), mask))).otherwise(aliases)).withColumn("name", name)


def claims_of(places_: Column, text: Column) -> Column:
    """Places as spans labelled ``known_names``."""
    return F.transform(places_, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit("known_names").alias("label"), F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("value")))
