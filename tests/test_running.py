"""Numbers and sums of groups over ranges, and needles found by automata."""

import random

from pyspark.sql import functions as F

from factline.operators import analytics, running


def test_numbers_and_sums_equal_windows(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, 1, 5])) for i in range(2000)]
    r.shuffle(rows)
    found = running.numbered(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], ["i"], {"before": F.col("v")}).collect()
    wanted = {}
    sizes = {g: sum(x[0] == g for x in rows) for g in {x[0] for x in rows}}
    totals = {}
    for g, i, v in sorted(rows, key=lambda x: x[1]):
        n, s = totals.get(g, (0, 0))
        wanted[i] = (n + 1, sizes[g], s)
        totals[g] = (n + 1, s + (v or 0))
    assert {x.i: (x._number, x._of, x.before) for x in found} == wanted
    assert running.numbered(spark.createDataFrame([], "g string, i int"), ["g"], ["i"]).collect() == []


def test_short_needles_are_found_anywhere(spark, monkeypatch):
    monkeypatch.setattr(analytics, "NEEDLE_BLOCK", 3)
    needles = spark.createDataFrame([(1, "Ab"), (2, "b c"), (3, "ab"), (4, " "), (5, "zz"), (6, "c"), (7, None), (8, "one two three")], "needle_id int, needle string")
    docs = spark.createDataFrame([("x", "CAB  c"), ("y", None), ("z", ""), ("w", "xone two threex")], "doc_id string, text string")
    found = sorted(tuple(x) for x in analytics.containments(needles, docs).collect())
    assert found == [(1, "x"), (2, "x"), (3, "x"), (6, "x"), (8, "w")]
