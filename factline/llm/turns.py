"""Conversation structure repair: the cheapest edits that make the turns of a conversation read ``(s?(ua)+)?``.

Rows are taken by turn (nulls first; rows of one turn by role, then text). A row's first fault counts: *blank* (nothing but
blanks), *duplicate* (role and text seen earlier), *truncated* (last character isn't ``.``, ``!`` or ``?``). Edits: Keep 0, Rerole
to user or assistant 2, Delete 3 (required for blank and duplicate rows), Insert an empty user or assistant row 2; a truncated
row that stays adds 1. Of the cheapest edits those with the ASCII-least audit (their initials in order) are taken.

Conversations are dealt by a hash into batches of bounded rows; in a batch one recursive DuckDB query takes all of its
conversations a row further at a time and keeps the least (cost, audit) of each grammar state. Two equally dear audits of one
state are never a prefix of one another, since an insert more costs more, so keeping the least of each state loses nothing.

A conversation of more than ``SEGMENT`` rows, which may hold a third of the table, is put in order by ranges and cut into
segments, dealt as if they were conversations of their own. The recursion then starts from each of the four states, and a
fold over the segments (four states, one text each) picks the path; texts move again only to be written.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own; a role's initial is its
first character (none for an empty role); a conversation of which no row is present has zeros, an empty audit and no messages; an
empty table gives no row; other columns are ignored. Texts are never cut: a batch is bounded by rows and by bytes, and one
longer text is a batch of its own conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.common import save

#: Rows of a conversation that are worked on at once; longer conversations are cut into segments.
SEGMENT = 512
#: Rows, and bytes of text, of the conversations of one recursive query.
BATCH_ROWS = 16384
BATCH_BYTES = 16 << 20

# Grammar states: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_INSERT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}

_MESSAGES = "messages array<struct<role string, text string, edit string>>"
_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_CONVERSATION = f"conv_key string, {_STATS}, {_MESSAGES}"
_SEGMENTS = (
    "conv_key string, segment long, first string, last string, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, paths array<struct<entry int, leaves int, cost long, audit string>>"
)
_FOLDED = f"conv_key string, {_STATS}, segment long, entry int, piece string"


class Repaired(NamedTuple):
    """One row per conversation (``messages`` null where it is long), and the messages of long ones, a row per part in order."""

    conversations: DataFrame
    parts: DataFrame


def _inserted(state: int) -> list[tuple[int, str]]:
    """States within two inserts; a third comes back to a state that was had for less."""
    once = _INSERT[state]
    twice = _INSERT[once]
    return [(state, ""), (once, "I")] + ([(twice, "II")] if twice != state else [])


def _moves() -> list[tuple[int, int, str, str | None, int]]:
    """(state, next state, edits, initial that the row must have, cost) for one row and the inserts after it."""
    edits = [(s, t, "K", initial, 0) for (s, initial), t in _KEEP.items()]
    edits += [(s, t, "R", None, 2) for s, t in _INSERT.items()]
    edits += [(s, s, "D", None, 3) for s in range(4)]
    return [(s, u, letter + more, initial, cost + 2 * len(more)) for s, t, letter, initial, cost in edits for u, more in _inserted(t)]


_ADVANCE = """
with recursive reached(g, entry, i, state, cost, audit) as (
  select g, entry, 0, state, cost, audit from starts
  union all
  select w.g, w.entry, w.i + 1, m.leaves, min(w.cost + m.cost + case when r.truncated and m.edit[1] <> 'D' then 1 else 0 end),
    arg_min(w.audit || m.edit, {'cost': w.cost + m.cost + case when r.truncated and m.edit[1] <> 'D' then 1 else 0 end, 'audit': w.audit || m.edit})
  from reached w join turns r on r.g = w.g and r.i = w.i
  join moves m on m.state = w.state and (m.edit[1] = 'D' or (not r.must and coalesce(m.initial, r.initial) = r.initial))
  group by w.g, w.entry, w.i + 1, m.leaves)
select r.g, r.entry, r.state, r.cost, r.audit from reached r join sizes s on s.g = r.g and s.n = r.i
"""


class _Recursion:
    """The recursive query over batches of row groups; one connection a task."""

    def __init__(self) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        self.db.execute("create table moves(state int, leaves int, edit varchar, initial varchar, cost bigint)")
        self.db.executemany("insert into moves values (?, ?, ?, ?, ?)", _moves())

    def run(self, groups: list[list[dict]], entries: tuple[int, ...]) -> list[dict[tuple[int, int], tuple[int, str]]]:
        """For each group: (entry, state after its last row) to (cost, audit)."""
        starts = [(g, e, s, 2 * len(i), i) for g in range(len(groups)) for e in entries for s, i in _inserted(e)]
        rows = [(g, i, r["role"][:1], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for g, group in enumerate(groups) for i, r in enumerate(group)]
        tables = {
            "starts": (starts, [("g", pa.int32()), ("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]),
            "turns": (rows, [("g", pa.int32()), ("i", pa.int32()), ("initial", pa.string()), ("must", pa.bool_()), ("truncated", pa.bool_())]),
            "sizes": ([(g, len(group)) for g, group in enumerate(groups)], [("g", pa.int32()), ("n", pa.int32())]),
        }
        for name, (values, fields) in tables.items():
            columns = list(zip(*values, strict=True)) or [[] for _ in fields]
            self.db.register(name, pa.table([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields]))
        found: list[dict] = [{} for _ in groups]
        for g, entry, state, cost, audit in self.db.execute(_ADVANCE).fetchall():
            found[g][entry, state] = (cost, audit)
        return found


def _replayed(rows: list[dict], audit: str, state: int) -> tuple[list[dict], int]:
    """The messages that the edits make of the rows, from a state on, and the state they leave."""
    messages, at = [], 0
    for edit in audit:
        row = None if edit == "I" else rows[at]
        at += row is not None
        if edit == "D":
            continue
        if edit == "K":
            state = _KEEP[state, row["role"][:1]]
            messages.append({"role": row["role"], "text": row["text"], "edit": "K"})
        else:
            state = _INSERT[state]
            messages.append({"role": _ROLE[state], "text": row["text"] if row else "", "edit": edit})
    return messages, state


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[dict]]]:
    """Runs of rows of one conversation segment, of rows that are in their order."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["conv_key"], row["segment"])
            if now != key:
                if rows:
                    yield key, rows
                key, rows = now, []
            rows.append(row)
    if rows:
        yield key, rows


def _in_batches(groups: Iterator[tuple[tuple[str, int], list[dict]]]) -> Iterator[list[tuple[tuple[str, int], list[dict]]]]:
    batch, rows, size = [], 0, 0
    for key, group in groups:
        n = sum(len(r["text"]) for r in group)
        if batch and (rows + len(group) > BATCH_ROWS or size + n > BATCH_BYTES):
            yield batch
            batch, rows, size = [], 0, 0
        batch.append((key, group))
        rows, size = rows + len(group), size + n
    if batch:
        yield batch


def _fault(rows: list[dict]) -> None:
    """Gives rows their first fault. Where ``repeated`` is null, a row is a duplicate of an earlier one among these rows."""
    seen = set()
    for row in rows:
        again = row["repeated"] if row["repeated"] is not None else row["digest"] in seen
        seen.add(row["digest"])
        row["fault"] = "blank" if row["blank"] else "duplicate" if again else "truncated" if row["truncated"] else ""


def _summary(rows: list[dict]) -> dict:
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    count = {name: sum(r["fault"] == name for r in rows) for name in ("blank", "duplicate", "truncated")}
    illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:], strict=False))
    return count | {"illegal": illegal, "first": initials[0], "last": initials[-1], "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns))}


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au") and len(a) == 1


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations, a row each."""
    recursion = _Recursion()
    for batch in _in_batches(_grouped(batches)):
        for _, rows in batch:
            _fault(rows)
        out = []
        for ((key, _), rows), found in zip(batch, recursion.run([rows for _, rows in batch], (START,)), strict=True):
            cost, audit = min(found[START, end] for end in ENDS if (START, end) in found)
            s = _summary(rows)
            messages, _ = _replayed(rows, audit, START)
            out.append(
                {"conv_key": key, "gaps": _gaps(s["first_turn"], s["last_turn"], s["turns"]), "cost": cost, "audit": audit, "messages": messages}
                | {name: s[name] for name in ("blank", "duplicate", "truncated", "illegal")}
            )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _segmented(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments of long conversations, a row each, with the cheapest edits between each two states."""
    recursion = _Recursion()
    for batch in _in_batches(_grouped(batches)):
        for _, rows in batch:
            _fault(rows)
        out = []
        for ((key, segment), rows), found in zip(batch, recursion.run([rows for _, rows in batch], (START, SYSTEM, USER, ASSISTANT)), strict=True):
            paths = [{"entry": e, "leaves": s, "cost": cost, "audit": audit} for (e, s), (cost, audit) in sorted(found.items())]
            out.append({"conv_key": key, "segment": segment, "paths": paths} | _summary(rows))
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of segments in order: a row for each with its entry state and edits, and a row with the conversation's figures."""
    for _, segments in _by_conversation(batches):
        states: dict[int, tuple[int, str, list[tuple[int, int]]]] = {START: (0, "", [])}
        figures = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        first_turn = last_turn = last = None
        names = []
        for s in segments:
            ahead: dict[int, tuple[int, str, list[tuple[int, int]]]] = {}
            for path in s["paths"]:
                if path["entry"] in states:
                    cost, audit, way = states[path["entry"]]
                    new = (cost + path["cost"], audit + path["audit"], [*way, (path["entry"], len(path["audit"]))])
                    if path["leaves"] not in ahead or new[:2] < ahead[path["leaves"]][:2]:
                        ahead[path["leaves"]] = new
            states = ahead
            names.append(s["segment"])
            for name in figures:
                figures[name] += s[name]
            figures["illegal"] += last is not None and not _legal(last, s["first"])
            last = s["last"]
            if s["first_turn"] is not None:
                figures["turns"] -= s["first_turn"] == last_turn
                first_turn, last_turn = s["first_turn"] if first_turn is None else first_turn, s["last_turn"]
        cost, audit, way = min(states[end] for end in ENDS if end in states)
        key, turns = segments[0]["conv_key"], figures.pop("turns")
        rows, at = [], 0
        for segment, (entry, n) in zip(names, way, strict=True):
            rows.append({"conv_key": key, "segment": segment, "entry": entry, "piece": audit[at : at + n]})
            at += n
        rows.append({"conv_key": key, "gaps": _gaps(first_turn, last_turn, turns), "cost": cost, "audit": audit} | figures)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_key"] != key:
                if held:
                    yield key, held
                key, held = row["conv_key"], []
            held.append(row)
    if held:
        yield key, held


def _written(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The messages of each segment, by its entry state and edits."""
    for (key, segment), rows in _grouped(batches):
        messages, _ = _replayed(rows, rows[0]["piece"], rows[0]["entry"])
        yield pa.RecordBatch.from_pylist([{"conv_key": key, "part": segment, "messages": messages}], schema=schema)


def _map(df: DataFrame, function, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: function(batches, schema), ddl)


def key_of(conv_id: Column) -> Column:
    """A text for a conversation id; null has its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _prepared(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    named = rows.select("conv_key", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return named.select(
        "*",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
    )


def _long_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Figures of long conversations, and their messages by part."""
    order = ("conv_key", F.asc_nulls_first("turn"), "role")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    placed = save(ranged.withColumn("place", F.monotonically_increasing_id()), "turns-ordered")
    first = placed.groupBy("conv_key", "digest").agg(F.min("place").alias("first_place"))
    known = placed.join(first, ["conv_key", "digest"]).withColumn("repeated", F.col("place") > F.col("first_place"))
    # A place holds the partition's number above bit 33 and the row's within it below, so a segment lies in one partition.
    known = known.withColumn("segment", F.shiftright("place", SEGMENT.bit_length() - 1))
    known = save(known.drop("first_place"), "turns-known")
    dealt = known.repartition("conv_key", "segment").sortWithinPartitions("conv_key", "segment", "place")
    segments = _map(dealt.drop("place"), _segmented, _SEGMENTS)
    folded = save(_map(segments.repartition("conv_key").sortWithinPartitions("conv_key", "segment"), _folded, _FOLDED), "turns-folded")
    pieces = folded.filter("segment is not null").select("conv_key", "segment", "entry", "piece")
    joined = known.join(pieces, ["conv_key", "segment"]).select("conv_key", "segment", "place", "role", "text", "entry", "piece")
    ready = joined.repartition("conv_key", "segment").sortWithinPartitions("conv_key", "segment", "place")
    parts = _map(ready, _written, f"conv_key string, part long, {_MESSAGES}")
    return folded.filter("segment is null").drop("segment", "entry", "piece"), parts


def repair(rows: DataFrame, present: Column | None = None) -> Repaired:
    """Repairs the conversations of ``rows`` (conv_id, turn, role, text).

    Rows for which ``present`` isn't true count as gone, though a conversation of such rows alone still has its row.
    """
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = rows.select(key_of(F.col("conv_id")).alias("conv_key"), "conv_id", "turn", "role", "text", here.alias("present"))
    sizes = save(rows.groupBy("conv_key").agg(F.min("conv_id").alias("conv_id"), F.count_if("present").alias("n")), "turns-sizes")
    prepared, long = _prepared(rows.filter("present")), sizes.filter(F.col("n") > SEGMENT).select("conv_key")
    any_long = not long.isEmpty()
    short = prepared.join(long, "conv_key", "left_anti") if any_long else prepared
    short = short.withColumn("segment", F.lit(0).cast("long")).withColumn("repeated", F.lit(None).cast("boolean"))
    ordered = short.repartition("conv_key").sortWithinPartitions("conv_key", F.asc_nulls_first("turn"), "role", "text")
    found = _map(ordered, _whole, _CONVERSATION)
    parts = rows.sparkSession.createDataFrame([], f"conv_key string, part long, {_MESSAGES}")
    if any_long:
        figures, parts = _long_parts(prepared.join(long, "conv_key"))
        found = found.unionByName(figures, allowMissingColumns=True)
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.array().cast("array<struct<role:string,text:string,edit:string>>")
    gone = sizes.filter("n = 0").select("conv_key", *zero, F.lit("").alias("audit"), none.alias("messages"))
    ids = sizes.select("conv_key", "conv_id")
    return Repaired(found.unionByName(gone).join(ids, "conv_key"), parts.join(ids, "conv_key"))


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's lines, a part at a time."""
    key, state, some = None, None, False
    for batch in batches:
        for row in batch.to_pylist():
            if row["conv_key"] != key:
                if state:
                    yield pa.RecordBatch.from_pylist([{"conv_key": key, "repaired_sha256": state.hexdigest()}], schema=schema)
                key, state, some = row["conv_key"], hashlib.sha256(), False
            for line in row["lines"]:
                state.update(("\n" + line if some else line).encode())
                some = True
    if state:
        yield pa.RecordBatch.from_pylist([{"conv_key": key, "repaired_sha256": state.hexdigest()}], schema=schema)


def digests(repaired: Repaired) -> DataFrame:
    """A row per conversation with its figures, audit, and the digest of its repaired ``role:text`` lines.

    A digest is over one text in order, so that of a long conversation is taken in one task, a part in memory at a time.
    """
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    short = repaired.conversations.filter("messages is not null").select(*names, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    ordered = repaired.parts.select("conv_key", "part", lines.alias("lines")).repartition("conv_key").sortWithinPartitions("conv_key", "part")
    hashed = _map(ordered, _hashed, "conv_key string, repaired_sha256 string")
    long = repaired.conversations.filter("messages is null").join(hashed, "conv_key").select(*names, "repaired_sha256")
    return short.unionByName(long)
