"""A policy's redaction of texts: ordered steps claim stretches, each stretch goes to the first, and words outside them are counted.

Order: rules with a replacement, credentials, the built-in classes, known names, rules without a replacement, rare names. A step takes its
matches in the order of the text; one that overlaps a stretch already claimed is passed over, and the step goes on behind that stretch. Steps
of patterns are found in the JVM, known names by the automata of ``names``; settling them needs no other row, so nothing is
shuffled until placeholders are numbered, and then only values move.

Defined cases: a null text has no claims and stays null; a policy without steps changes nothing; a match that already is its replacement
is left and isn't counted; rare names are counted over a batch of documents (a null batch is one of its own).
"""

from __future__ import annotations

import ipaddress
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factline.functions import credentials
from factline.functions.spans import SPAN, Found, found_at, replaced_at
from factline.operators.names import with_places
from factline.operators.ordered import placeholders

#: Rows whose spans are Python objects at a time.
FEW = 64
CLAIM = "array<struct<step:int,label:string,start:int,end:int,value:string,replacement:string>>"


class Rule(NamedTuple):
    """A policy's own pattern; with a replacement it can't be undone."""

    name: str
    pattern: str
    replacement: str | None = None


class Step(NamedTuple):
    """What a step calls its claims, its candidates, what makes spans of one (all of it, without), and what replaces a claim."""

    label: str
    found: Callable[[Column], Found] | None
    refine: Callable[[str, int, int], list[tuple[int, int]]] | None = None
    replacement: str | None = None
    by_label: bool = False  # the replacement holds the label of the span


# --- The built-in classes: a candidate is a run of what a value may be made of, and a small function says what in it is one.


def _touches(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isalnum()


def _ends_number(text: str, at: int) -> bool:
    """Whether a number may end here: nothing follows, or a word of letters that can't be a hexadecimal digit each."""
    end = at
    while _touches(text, end):
        end += 1
    tail = text[at:end]
    return not tail or (tail.isalpha() and any(c not in "abcdefABCDEF" for c in tail))


def luhn(digits: str) -> bool:
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Of a run of digit groups: at each group that nothing touches, the longest run of up to eight groups that is a card number.

    A card has 13 to 19 digits, so a sum over at most eight groups from each start is all there is to look at.
    """
    groups, i = [], start
    while i < end:
        if text[i].isdigit():
            j = i
            while j < end and text[j].isdigit():
                j += 1
            groups.append((i, j))
            i = j
        i += 1
    out, at = [], 0
    while at < len(groups):
        longest, digits = None, ""
        for k in range(at, min(at + 8, len(groups))):
            a, b = groups[k]
            digits += text[a:b]
            if len(digits) > 19:
                break
            if len(digits) >= 13 and luhn(digits) and _ends_number(text, b):
                longest = k
        if longest is not None and not _touches(text, groups[at][0] - 1):
            out.append((groups[at][0], groups[longest][1]))
            at = longest
        at += 1
    return out


def addresses(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """An IPv4 address that no further part touches, or an IPv6 address without the stop or colon of its sentence."""
    if ":" not in text[start:end]:
        further = text[end : end + 1] == "." and text[end + 1 : end + 2].isdigit()
        if _touches(text, start - 1) or text[start - 1 : start] == "." or _touches(text, end) or further:
            return []
    else:
        while end > start and text[end - 1] == ".":
            end -= 1
        end -= text[start:end].endswith(":") and not text[start:end].endswith("::")
        start += text[start:end].startswith(":") and not text[start:end].startswith("::")
        value = text[start:end]
        if _touches(text, start - 1) or _touches(text, end) or sum(map(bool, value.split(":"))) < 2 or not any(c.isdigit() for c in value):
            return []
    try:
        ipaddress.ip_address(text[start:end])
    except ValueError:
        return []
    return [(start, end)]


def _clock(part: str) -> bool:
    part = part.strip().replace(":", "")
    return len(part) == 4 and part.isdigit() and int(part[:2]) <= 24 and int(part[2:]) <= 59


def _times(value: str) -> bool:
    """Two clock times joined by a dash."""
    parts = value.replace("–", "-").split("-")
    return len(parts) == 2 and all(map(_clock, parts))


def _date(value: str) -> bool:
    parts = value.replace("/", "-").replace(".", "-").split("-")
    sizes = [len(p) for p in parts]
    return len(parts) == 3 and all(p.isdigit() for p in parts) and (sizes[0] == 4 and max(sizes[1:]) <= 2 or max(sizes[:2]) <= 2 and 2 <= sizes[2] <= 4)


def _digits(value: str) -> int:
    return sum(c.isdigit() for c in value)


def phones(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """7 to 15 digits that stand alone, no two clock times and no date; an extension belongs to the number and isn't counted."""
    value = text[start:end]
    opens = value[0] in "+("
    touched = text[start - 1 : start].isdigit() if opens and start else _touches(text, start - 1) or start > 0 and text[start - 1] == "+"
    main = value[: next((i for i, c in enumerate(value) if c.isalpha()), len(value))].rstrip()
    dated = "/" in value and text[end : end + 1] == "/" or _date(main)
    return [(start, end)] if not touched and not dated and _ends_number(text, end) and 7 <= _digits(main) <= 15 and not _times(main) else []


def called(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A number that the word before it says is one to call: 6 to 15 digits, no clock times and no date."""
    value = text[start:end]
    return [(start, end)] if not _touches(text, start - 1) and _ends_number(text, end) and 6 <= _digits(value) <= 15 and not _times(value) and not _date(value) else []


def links(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A link up to a bracket it didn't open, without the punctuation that ends the sentence around it."""
    if start and (text[start - 1].isalnum() or text[start - 1] in "@./-_%"):
        return []
    opened: list[str] = []
    for i in range(start, end):
        if text[i] in "([":
            opened.append(text[i])
        elif text[i] in ")]":
            if not opened:
                end = i
                break
            opened.pop()
    while end > start and (text[end - 1] in ".,;:!?*" or text[end - 1] in "([" and opened):
        end -= 1
    bare = text[start:end].lower()
    head = bare.index("://") + 3 if "://" in bare else 4 if bare.startswith("www") else 0
    return [(start, end)] if len(bare) > head else []


# Names of classes, the schemes of links, and the words that say a number is one to call.
_SCHEMES = "https?|ftps?|sftp|ssh|wss?|file"
_CALL_WORDS = ("call", "calls", "called", "phone", "tel", "telephone", "mobile", "cell", "cellphone", "sms", "whatsapp", "fax", "dial", "ring", "handy", "telefon", "mobil", "rufnummer")
_LABEL = r"[\p{L}\p{N}\p{M}][\p{L}\p{N}\p{M}-]*+"
_HOST = r"[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.(?:\p{L}{2,24}))(?::[0-9]{1,5})?/"
CLASSES: dict[str, tuple[str, Callable[[str, int, int], list[tuple[int, int]]] | None]] = {
    "Url": (rf"(?i)(?:\b(?:{_SCHEMES})://|\bwww\.|(?<![\p{{L}}\p{{N}}@./_%-]){_HOST})[^\s<>\"'`{{}}|\\^]*+", links),
    "Email": (rf"(?:\b[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}\p{{M}}._%+'-]{{0,127}}|\"[^\"\r\n]{{1,127}}\")(?:@|%40){_LABEL}(?:\.{_LABEL})*+(?<=\.[\p{{L}}\p{{N}}-]{{2,63}})", None),
    "PaymentCard": (r"[0-9]++(?:[\p{Zs}-][0-9]++)*+", cards),
    "IpAddress": (r"(?i)[0-9a-f.]{0,45}+:[0-9a-f.:]{1,45}+|\b[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+", addresses),
    "Phone": (
        r"(?:(?:\+|\b00)[1-9][0-9]{0,2}(?:[\p{Zs}.-]?\(?[0-9]{1,4}\)?){2,5}(?:/[0-9]{1,8}(?:[\p{Zs}.-]?[0-9]{1,4}){0,3})?|\([0-9]{2,5}\)[\p{Zs}.-]?[0-9]{2,4}(?:[\p{Zs}.-]?[0-9]{2,4}){1,3}"
        r"|\b[0-9]{3}[\p{Zs}.-][0-9]{3}[\p{Zs}.-][0-9]{4}|\b0[0-9]{2,4}[\p{Zs}./-]?[0-9]{3,8}(?:[\p{Zs}.-][0-9]{2,6}){0,3})(?:\p{Zs}?(?:[xX]|[eE][xX][tT]\.?|[eE]xtension)\p{Zs}?[0-9]{1,6})?",
        phones,
    ),
}
_CALLED = rf"(?i)\b(?:{'|'.join(_CALL_WORDS)})\b[^0-9\n+(]{{0,30}}+(\+?\(?[0-9][0-9\p{{Zs}}.\-/()]{{4,}}[0-9])"


def _whole(pattern: str, label: str, group: int = 0) -> Callable[[Column], Found]:
    return lambda text: found_at(text, pattern, group, label, lambda v: F.lit(True))


class Policy(NamedTuple):
    """Classes by name (``Credential`` and the built-in ones), own rules, whether rare names go, and how often they may stand."""

    classes: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()
    rare_names: bool = False
    rare_limit: int = 1

    def steps(self) -> list[Step]:
        """In the order in which they claim text; ``known_names`` has no pattern."""
        out = [Step(r.name, _whole(r.pattern, r.name), replacement=r.replacement) for r in self.rules if r.replacement]
        if "Credential" in self.classes:
            for s in credentials.shapes():
                out.append(Step("Credential", lambda text, s=s: found_at(text, s.pattern, s.group, s.name, s.counts), replacement="[masked:{}]", by_label=True))
        out += [Step(c, _whole(pattern, c), refine) for c, (pattern, refine) in CLASSES.items() if c in self.classes]
        out.append(Step("known_names", None))
        return out + [Step(r.name, _whole(r.pattern, r.name)) for r in self.rules if not r.replacement]


class _Taken:
    """Stretches claimed so far, kept in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def over(self, start: int, end: int) -> int | None:
        """The end of the first stretch that overlaps, if any."""
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] > start:
            return self.ends[i - 1]
        return self.ends[i] if i < len(self.starts) and self.starts[i] < end else None

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def _claimed(text: str, found: list[list[dict]], named: list[dict], steps: list[Step]) -> list[dict]:
    """Claims of a text, each stretch to the first step, in the order of the text."""
    taken, out, at = _Taken(), [], 0
    for number, step in enumerate(steps):
        if step.found is None:
            candidates = [(p["start"], p["end"], "") for p in named]
        else:
            candidates = [(s["start"], s["end"], s["label"]) for s in found[at]]
            at += 1
        if step.refine:
            candidates = [(*span, label) for a, b, label in candidates for span in step.refine(text, a, b)]
        position = 0
        for a, b, label in candidates:
            if a < position or a >= b:
                continue
            hidden = taken.over(a, b)
            if hidden is not None:
                position = max(hidden, a + 1)
                continue
            taken.add(a, b)
            out.append({"step": number, "label": step.label, "start": a, "end": b, "value": text[a:b], "replacement": step.replacement.format(label) if step.by_label else step.replacement})
            position = b
    return sorted(out, key=lambda c: c["start"])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``FEW``: a text's spans as Python objects take many times its length."""
    for batch in batches:
        for a in range(0, batch.num_rows, FEW):
            yield batch.slice(a, FEW)


def with_claims(docs: DataFrame, policy: Policy, names: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``claims``: what the policy hides of each text, in order, none overlapping; null where the text is."""
    steps = policy.steps()
    patterns = [s for s in steps if s.found]
    named = with_places(docs, names, text, out="_named") if names is not None else docs.withColumn("_named", F.array().cast("array<struct<start:int,end:int>>"))
    arrays = F.array(*[F.coalesce(s.found(F.col(text)).spans, F.array().cast(SPAN)) for s in patterns]) if patterns else F.array().cast(f"array<{SPAN}>")
    ready = named.withColumn("_found", arrays)
    kept = [c for c in docs.columns if c != "claims"]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("claims", T._parse_datatype_string(CLAIM))])
    arrow = pa.list_(pa.struct([("step", pa.int32()), ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("replacement", pa.string())]))
    plain = [s._replace(found=s.found and True) for s in steps]  # columns don't go to the workers

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = zip(batch.column(text).to_pylist(), batch.column("_found").to_pylist(), batch.column("_named").to_pylist(), strict=True)
            claims = [None if t is None else _claimed(t, f, n, plain) for t, f, n in rows]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(claims, arrow)], names=[*kept, "claims"])

    return ready.select(*kept, "_found", "_named").mapInArrow(settle, schema)


def scrubbed(claimed: DataFrame, text: str = "text") -> DataFrame:
    """``claimed`` with what can't be undone replaced, and ``hits``: each replacement's label and its place in the new text."""
    spans = F.filter("claims", lambda c: c["replacement"].isNotNull() & (c["replacement"] != c["value"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), F.array().cast("array<struct<label:string,offset:int>>").alias("hits"))

    def step(state: Column, c: Column) -> Column:
        head = F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, c["start"] - state["at"]))
        hit = F.struct(c["label"].alias("label"), F.length(head).alias("offset"))
        return F.struct(c["end"].alias("at"), F.concat(head, c["replacement"]).alias("out"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    done = F.aggregate(spans, start, step, lambda s: F.struct(F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))).alias("text"), s["hits"].alias("hits")))
    return claimed.withColumn("_done", done).withColumn(text, F.col("_done.text")).withColumn("hits", F.coalesce("_done.hits", F.array().cast("array<struct<label:string,offset:int>>"))).drop("_done", "claims")


def hidden(claimed: DataFrame, batch: str, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``claimed`` with each claim replaced where it stands, and the mapping ``batch, label, value, placeholder`` of those that can be undone.

    A value has one placeholder in its batch, numbered by label in the order of its first appearance. Text between claims that looks
    like a placeholder of one of the labels gets an equals sign, one more if it has some.
    """
    each = claimed.select(batch, key, F.explode("claims").alias("c")).filter("c.replacement is null")
    values = each.select(batch, key, F.col("c.label").alias("label"), F.col("c.value").alias("value"), F.struct(F.col(key), F.col("c.start").alias("start")).alias("position"))
    mapping = placeholders(values, batch, "label", "value", "position")
    used = values.select(batch, key, "label", "value").distinct().join(mapping, [batch, "label", "value"])
    own = used.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("label", "value"), "placeholder"))).alias("_shown"))
    joined = claimed.join(own, key, "left")

    def shown(c: Column) -> Column:
        return F.coalesce(c["replacement"], F.try_element_at("_shown", F.struct(c["label"].alias("label"), c["value"].alias("value"))), c["value"])

    def escaped(t: Column) -> Column:
        return F.regexp_replace(t, r"\[(=*[A-Za-z_][A-Za-z0-9_ -]{0,63}-[0-9]{1,18}\])", "[=$1")

    return joined.withColumn(text, replaced_at(F.col(text), F.col("claims"), shown, escaped)).drop("_shown", "claims"), mapping


def claim_counts(claimed: DataFrame) -> DataFrame:
    """``(label, found)`` over all documents."""
    return claimed.select(F.explode("claims").alias("c")).filter(F.col("c.replacement").isNull() | (F.col("c.replacement") != F.col("c.value"))).groupBy("c.label").agg(F.count("*").alias("found"))


# --- Words outside claims

_CAPITALISED = r"\p{Lu}[\p{L}\p{M}]*+(?:(?:['’]\p{Lu}|-\p{L})[\p{L}\p{M}]*+)*+"


def with_words(claimed: DataFrame, text: str = "text") -> DataFrame:
    """``claimed`` with ``words``: capitalised words with a small letter that overlap no claim and stand alone, with their places."""
    alone = rf"(?<![\p{{L}}\p{{N}}])(?<![\p{{Ll}}\p{{N}}]_){_CAPITALISED}(?![\p{{L}}\p{{N}}])"
    spans = found_at(F.col(text), alone, 0, "word", lambda v: v.rlike(r"\p{Ll}")).spans
    worded = claimed.withColumn("words", spans)
    number = worded.columns.index("words")

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            kept = [outside(w, c) for w, c in zip(batch.column("words").to_pylist(), batch.column("claims").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:number], pa.array(kept, batch.schema.field(number).type), *batch.columns[number + 1 :]], names=batch.schema.names)

    return worded.mapInArrow(subtract, worded.schema)


def outside(spans: list[dict] | None, holes: list[dict] | None) -> list[dict]:
    """The spans that overlap no hole: both are in order and don't overlap among themselves, so one pass over both tells."""
    out, at, holes = [], 0, holes or []
    for span in spans or []:
        while at < len(holes) and holes[at]["end"] <= span["start"]:
            at += 1
        if at == len(holes) or holes[at]["start"] >= span["end"]:
            out.append(span)
    return out


def word_counts(worded: DataFrame, batch: str) -> DataFrame:
    """``(batch, word, uses)`` of the words outside claims; batches add up before anything is dealt."""
    return worded.select(batch, F.explode("words.value").alias("word")).groupBy(batch, "word").agg(F.count("*").alias("uses"))


def cut_fragments(worded: DataFrame, counts: DataFrame, batch: str, key: str, limit: int, text: str = "text") -> DataFrame:
    """``(key, word)``: a text's last word, if a cut may have left it of a word that its batch has more than ``limit`` times.

    It has to end the text, but for hyphens and apostrophes, and with them begin a longer word. Frequent words give their beginnings,
    so that the two meet by equality.
    """
    last = F.try_element_at("words", F.lit(-1))
    tail = F.substring(F.col(text), last["start"] + 1, F.length(text))
    rest = F.substring(F.col(text), last["end"] + 1, F.length(text))
    ends = worded.select(key, batch, last["value"].alias("word"), tail.alias("tail"), rest.alias("rest")).filter("word is not null").filter(F.col("rest").rlike(r"^['’-]*\z"))
    beginnings = counts.filter(F.col("uses") > limit).select(batch, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - 1)), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("tail"), F.length("word").alias("n"))
    return ends.join(beginnings.filter(F.length("tail") < F.col("n")).select(batch, "tail").distinct(), [batch, "tail"], "left_semi").select(key, "word")


def in_context(text: Column) -> Found:
    """Candidates of numbers behind a word that says they are to be called."""
    return found_at(text, _CALLED, 1, "Phone", lambda v: F.lit(True))


def called_numbers(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, value)``: numbers to be called that a gate finds beside the ``Phone`` class."""
    found = docs.select(key, F.col(text).alias("_text"), F.explode(in_context(F.col(text)).spans).alias("s")).select(key, "_text", "s.start", "s.end")
    schema = T.StructType([docs.schema[key], T.StructField("value", T.StringType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t[a:b]) for k, t, s, e in zip(*[c.to_pylist() for c in batch.columns], strict=True) for a, b in called(t, s, e)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array([v for _, v in rows], pa.string())], names=[key, "value"])

    return found.mapInArrow(check, schema)
