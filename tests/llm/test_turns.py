"""Conversation repair against an exhaustive search over edits, against its SQL, and with long conversations in segments."""

import hashlib
import heapq
import random
import re

import pytest

from compare import duck, duck_rows, spark_rows
from factline.llm import queries, turns

ROWS = "conv_id long, turn long, role string, text string, messages string, conv_key int"


def least(rows):
    """(cost, audit, lines) of the cheapest edits, by best-first search over every sequence of edits."""
    seen, faults = set(), []
    for role, text in rows:
        again = (role, text) in seen
        seen.add((role, text))
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append("b" if not bare else "d" if again else "t" if bare[-1] not in ".!?" else "")
    grammar = re.compile(r"(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and grammar.fullmatch(initials):
            return cost, audit, lines
        state = (at, initials[-1:], bool(initials))
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, initials + role[0], (*lines, role + ":")))
        if at < len(rows):
            role, text = rows[at]
            extra = faults[at] == "t"
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, initials, lines))
            if faults[at] not in ("b", "d"):
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, initials + (role[:1] or "?"), (*lines, role + ":" + text)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, initials + new[0], (*lines, new + ":" + text)))
        heap = [x for x in heap if re.fullmatch(r"s?(ua)*u?", x[3])]
        heapq.heapify(heap)
    return None


def of(spark, conversations):
    rows = [(c, t, role, text, "m", 7) for c, conv in conversations.items() for t, role, text in conv]
    return spark.createDataFrame(rows, ROWS).repartition(3)


def test_against_every_sequence_of_edits(spark):
    r = random.Random(5)
    texts = ["yes.", "no", "what?", " ", "", "so it is!", "a\n.", None]
    roles = ["user", "assistant", "system", "tool", None, ""]
    conversations = {c: [(r.choice([None, t, t]), r.choice(roles[: 3 if c % 2 else 6]), r.choice(texts)) for t in range(r.randrange(1, 9))] for c in range(300)}
    found = {x.conv_id: x for x in turns.digests(turns.repair(of(spark, conversations))).collect()}
    assert len(found) == 300
    for c, conv in conversations.items():
        rows = sorted(((t is not None, t or 0, role if role is not None else " ", text if text is not None else " ") for t, role, text in conv))
        cost, audit, lines = least([x[2:] for x in rows])
        assert (found[c].cost, found[c].audit) == (cost, audit), (c, rows)
        assert found[c].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        known = [x[1] for x in rows if x[0]]
        assert found[c].gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)


def test_long_conversations_in_segments_are_as_whole_ones(spark, monkeypatch):
    r = random.Random(6)
    texts = ["yes.", "no", "what?", " ", "so it is!", *(f"line {i}." for i in range(60))]
    conversations = {c: [(t // 2 if c == 3 else t, r.choice(["user", "assistant", "assistant", "system"]), r.choice(texts)) for t in range(90)] for c in range(5)}
    conversations[None] = [(t, "user" if t % 3 else "assistant", f"{t % 40}.") for t in range(120)]
    conversations[9] = [(0, "user", "x" * 200_000 + "."), (1, "assistant", "y.")]
    rows = of(spark, conversations)
    whole = spark_rows(turns.digests(turns.repair(rows)))
    monkeypatch.setattr(turns, "SEGMENT", 16)
    assert spark_rows(turns.digests(turns.repair(rows))) == whole
    repaired = turns.repair(rows)
    assert repaired.conversations.filter("messages is null").count() == 6
    roles = [m.role[0] for row in repaired.parts.filter("conv_id = 1").orderBy("part").collect() for m in row.messages]
    assert re.fullmatch("s?(ua)+", "".join(roles))


def test_gone_rows_repeats_and_empty_tables(spark):
    rows = of(spark, {1: [(0, "user", "hi."), (0, "user", "hi."), (1, "assistant", "yes.")], 2: [(0, "user", "hi.")]})
    found = {x.conv_id: x for x in turns.digests(turns.repair(rows, rows.conv_id == 1)).collect()}
    assert (found[1].audit, found[1].cost, found[1].duplicate, found[1].illegal) == ("KDK", 3, 1, 1)
    assert (found[2].audit, found[2].cost, found[2].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert turns.digests(turns.repair(rows.limit(0))).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, size):
    sf = f"/root/testdata/{size}"
    assert spark_rows(queries.op11_conversation_repair(spark, sf)) == duck_rows(duck(sf), queries.OP11_SQL)
