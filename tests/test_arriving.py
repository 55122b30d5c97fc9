"""Answers in pieces, batch and stream, at every cut and over a restart; walks over pages in no order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factline.sources import walks
from factline.streaming import holdback

PIECES = "answer string, seq long, piece string, last boolean"
TEXT = "Dear [Email-1], [Name-2] wrote [Nobody-9] [=Name-2] [a b] [x] [" + "y" * 130 + " é[Name-2]"
WHOLE = TEXT.replace("[Email-1]", "a@b.org").replace("[Name-2]", "Rowan").replace("[=Name-2]", "[Name-2]")


def mapping(spark, answers):
    return spark.createDataFrame([(a, p, v) for a in answers for p, v in (("[Email-1]", "a@b.org"), ("[Name-2]", "Rowan"))], "answer string, placeholder string, value string")


def pieces_of(name, cuts):
    cuts = [0, *cuts, len(TEXT)]
    parts = [TEXT[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(name, i, p, i == len(parts) - 1) for i, p in enumerate(parts)]


def shown_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.answer, r.seq, "part" in r and r.part)):
        text, n = out.get(r.answer, ("", 0))
        out[r.answer] = (text + r.shown, n + r.unrestored)
    return out


def test_every_cut_shows_the_same(spark):
    rows = [p for k in range(1, len(TEXT)) for p in pieces_of(f"one{k:03}", [k])] + pieces_of("whole", []) + pieces_of("letters", list(range(1, len(TEXT))))
    r = random.Random(2)
    for n in range(30):
        cuts = sorted(r.choices(range(len(TEXT)), k=12))  # with empty pieces
        rows += pieces_of(f"many{n}", cuts)
    names = {a for a, *_ in rows}
    held = holdback.held_back(spark.createDataFrame(rows, PIECES).repartition(8))
    found = shown_of(holdback.restored(held, mapping(spark, names)).collect())
    assert set(found) == names
    assert all(v == (WHOLE, 1) for v in found.values())
    by_answer = {}
    for a, i, p, last in rows:
        by_answer.setdefault(a, []).append(p)
    tails = {(x.answer, x.seq): x.held for x in held.collect()}
    for a, parts in by_answer.items():
        text = ""
        for i, p in enumerate(parts):
            text += p
            assert tails[a, i] == ("" if i == len(parts) - 1 else holdback.held_tail(text)), (a, i)


def test_pieces_that_are_null_or_empty(spark):
    rows = [("a", 0, "[Name", False), ("a", 1, None, False), ("a", 2, "", False), ("a", 3, "-2]", False), ("b", 0, None, True), ("c", 0, "[open", None)]
    found = [(r.answer, r.seq, r.shown) for r in holdback.restored(holdback.held_back(spark.createDataFrame(rows, PIECES)), mapping(spark, ["a"])).orderBy("answer", "seq").collect()]
    assert found == [("a", 0, ""), ("a", 1, ""), ("a", 2, ""), ("a", 3, "Rowan"), ("b", 0, ""), ("c", 0, "")]
    assert holdback.held_back(spark.createDataFrame([], PIECES)).collect() == []


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Pieces come out of order and twice, over a restart between any two; what is held goes out after a time without pieces."""
    r = random.Random(3)
    rows = [p for n in range(6) for p in pieces_of(f"s{n}", sorted(r.sample(range(1, len(TEXT)), 6)))]
    r.shuffle(rows)
    held = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        for part in range(3):
            some = rows[part::2] + rows[:4] if part < 2 else [("late", 0, "x [open", False)]
            spark.createDataFrame(some, PIECES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(PIECES).parquet(str(tmp_path / "in"))
            shown = holdback.restored(holdback.held_back_stream(source, wait_ms=500 if part == 2 else 10**9), mapping(spark, {p[0] for p in rows if p[0] != "late"}))
            query = shown.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
            # timers keep a query running, so it is stopped once it has read all there is and run two batches more
            end = time.time() + 60
            while time.time() < end:
                done = query.recentProgress
                if sum(p.numInputRows for p in done) and [p.numInputRows for p in done[-2:]] == [0, 0]:
                    break
                time.sleep(0.3)
            query.stop()
        found = shown_of(spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found.pop("late") == ("x [open", 0)
    assert found == {f"s{n}": (WHOLE, 1) for n in range(6)}


PAGES = "walk string, token string, rows int, next string, page int"


def by_hand(pages, starts, most):
    stored = {}
    for w, t, n, nxt in pages:
        stored[w, t] = min(stored.get((w, t), (nxt, n)), (nxt, n), key=lambda x: (x[0] is not None, x[0] or "", x[1]))
    out = []
    for w, token in starts:
        asked, page = {token}, 0
        while (w, token) in stored:
            nxt, n = stored[w, token]
            page += 1
            ended = "empty page" if n == 0 else "no next" if nxt is None else "repeated token" if nxt in asked else "missing page" if (w, nxt) not in stored else "max pages" if page >= most else None
            out.append((w, page, token, n, ended, ended == "max pages" or ended == "empty page" and nxt is not None))
            if ended:
                break
            asked.add(nxt)
            token = nxt
    return sorted(out, key=repr)


def test_walks_equal_reading_page_by_page(spark):
    r = random.Random(7)
    pages, starts = [], []
    for k in range(60):
        size, walk = r.randrange(1, 40), f"w{k}" if k else None
        tokens = [None if r.random() < 0.5 else "t0", *[f"t{i}" for i in range(1, size)]]
        for i, t in enumerate(tokens):
            nxt = tokens[i + 1] if i + 1 < size else None
            x = r.random()
            nxt = r.choice(tokens) if x < 0.03 else "nowhere" if x < 0.05 else None if x < 0.06 else nxt
            pages.append((walk, t, 0 if r.random() < 0.03 else 2, nxt))
        if k % 9 == 0:
            pages.append(pages[-1])
        starts.append((walk, tokens[0]))
    starts.append(("nothing", "t"))
    r.shuffle(pages)
    for most in (7, 1000):
        got = walks.walked(spark.createDataFrame([(*p, 9) for p in pages], PAGES), spark.createDataFrame(starts, "walk string, token string"), most)
        assert sorted((tuple(x) for x in got.select("walk", "page", "token", "rows", "ended", "unread").collect()), key=repr) == by_hand(pages, starts, most)


def test_a_long_walk_takes_few_rounds(spark):
    n = 5000
    pages = spark.range(n).select(F.lit("w").alias("walk"), F.concat(F.lit("t"), "id").alias("token"), F.lit(1).alias("rows"), F.concat(F.lit("t"), F.when(F.col("id") < n - 1, F.col("id") + 1)).alias("next"))
    starts = spark.createDataFrame([("w", "t0")], "walk string, token string")
    last = walks.walked(pages, starts, 10**9).filter("ended is not null").collect()
    assert [(x.page, x.token, x.ended) for x in last] == [(n, f"t{n - 1}", "no next")]
    assert walks.walked(pages.limit(0), starts, 5).collect() == []


@pytest.mark.parametrize(
    ("style", "given", "current", "wanted"),
    [
        ("Token", "abc", None, "abc"), ("Token", " ", None, None), ("Token", None, "1", None), ("Keyset", None, None, None), ("PageNumber", None, None, "2"), ("PageNumber", None, " 4 ", "5"),
        ("PageNumber", None, "x", None), ("PageNumber", "9", "4", "9"), ("NextLink", "https://h/p?limit=5&cursor=a%2Fb#x", None, "a/b"), ("NextLink", "https://h/p?limit=5", None, None), ("NextLink", "/p?cursor=", None, None),
    ],
)
def test_next_token(spark, style, given, current, wanted):
    row = spark.createDataFrame([(given, current)], "given string, current string")
    assert row.select(walks.next_token(style, F.col("given"), F.col("current")).alias("n")).first().n == wanted


def test_child_walks_name_their_parent(spark):
    row = spark.createDataFrame([("x/y",), (None,)], "p string").select(walks.child_walk("a/b", F.col("p")).alias("w"))
    assert [tuple(x) for x in row.select("w", walks.parent_of(F.col("w")).alias("p")).collect()] == [("a%2Fb/x/y", "x/y"), (None, None)]


def test_what_is_held_reads_only_the_pieces_since_the_last_bracket_or_blank(spark):
    held = holdback.held_back(spark.createDataFrame([], PIECES))
    plan = held._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert f"RowFrame, -{holdback.HELD_BYTES}" not in plan and f"RangeFrame, -{holdback.HELD_BYTES}" in plan
    rows = [("a", i, p, False) for i, p in enumerate(["x [Na", "", *["m"] * 100, "", *["é"] * 11, "n", "]", "["])]
    got = {r.seq: r.held for r in holdback.held_back(spark.createDataFrame(rows, PIECES)).collect()}
    assert got[0] == got[1] == "[Na"
    assert got[102] == "[Na" + "m" * 100 and got[113] == "[Na" + "m" * 100 + "é" * 11
    assert [got[i] for i in (114, 115, 116)] == ["[Na" + "m" * 100 + "é" * 11 + "n", "", "["]


def test_pages_beyond_the_most_of_a_walk_are_not_placed(spark, monkeypatch):
    n = 300
    pages = spark.range(n).select(F.lit("w").alias("walk"), F.concat(F.lit("t"), "id").alias("token"), F.lit(1).alias("rows"), F.concat(F.lit("t"), F.col("id") + 1).alias("next"))
    starts = spark.createDataFrame([("w", "t0")], "walk string, token string")
    rounds = []
    monkeypatch.setattr(walks, "saved", lambda df, tag, real=walks.saved: (rounds.append(tag), real(df, tag))[1])
    for most, ended in ((1, "max pages"), (5, "max pages"), (n, "missing page")):
        rounds.clear()
        read = sorted(walks.walked(pages, starts, most).collect(), key=lambda x: x.page)
        assert [x.page for x in read] == list(range(1, most + 1)) and read[-1].ended == ended
        assert rounds.count("walk-places") == 1 + max(1, most.bit_length())
