"""Publishing under a guard, two writers, runs killed between their steps, and compaction."""

import threading

import pytest

from factline.operators import mapping
from factline.plans.engine import Engine
from factline.plans.store import Conflict, Store
from test_lifecycle import ADA, GRACE, PEOPLE, listing

ROWS = "x int"


def store_at(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s")


def rows(store):
    return sorted(r.x for r in store.read("t", ROWS).collect())


def put(spark, store, label, x):
    revision = store.begin(label)
    store.stage("t", spark.createDataFrame([(x,)], ROWS), revision)
    return revision


def test_of_two_writers_of_a_source_one_wins(spark, tmp_path):
    store = store_at(spark, tmp_path)
    a, b = put(spark, store, "p", 1), put(spark, store, "p", 2)
    assert a != b
    store.publish(b)
    with pytest.raises(Conflict):
        store.publish(a)
    assert rows(store) == [2]
    store.publish(put(spark, store, "p", 3))
    assert rows(store) == [2, 3]
    assert store.stages() == []


def test_writers_of_other_sources_go_on_top(spark, tmp_path):
    store = store_at(spark, tmp_path)
    a, b = put(spark, store, "p", 1), put(spark, store, "q", 2)
    store.publish(b)
    store.publish(a)
    assert rows(store) == [1, 2]
    c = put(spark, store, "q", 3)
    store.restore(b)
    with pytest.raises(Conflict):  # it went back under the run
        store.publish(c)
    assert rows(store) == [2]


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    store = store_at(spark, tmp_path)
    revisions, failed = [], []

    def work(i):
        try:
            revisions.append(r := store.begin(f"w{i}"))
            store._create(f"t/r{r}/mark", {})
            store.publish(r)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert sorted(store.head().visible) == sorted(revisions) == list(range(1, 7))
    assert [h.n for h in store.heads()] == list(range(6))


def test_a_killed_run_is_settled(spark, tmp_path):
    store = store_at(spark, tmp_path)
    store.publish(put(spark, store, "p", 1))
    begun = put(spark, store, "p", 2)
    publishing = put(spark, store, "p", 3)
    store._create(f"_stages/r{publishing:012d}.publishing", {})
    other = put(spark, store, "q", 4)
    assert store.recover("p") == {begun: "abandoned", publishing: "published"}
    assert rows(store) == [1, 3]
    assert [s.revision for s in store.stages()] == [other]
    # killed after its head was there, and before its claim was settled
    late = put(spark, store, "p", 5)
    store._create(f"_stages/r{late:012d}.publishing", {})
    store._put(type(store.head())(store.head().n + 1, late, (*store.head().visible, late), "p"))
    assert store.recover("p") == {late: "published"}
    assert rows(store) == [1, 3, 5]
    with pytest.raises(ValueError, match="has been published"):
        store.abandon(late)


def test_compaction_keeps_rows_and_history(spark, tmp_path):
    store = store_at(spark, tmp_path)
    first = put(spark, store, "p", 1)
    store.publish(first)
    store.publish(put(spark, store, "p", 2))
    before = sorted(map(tuple, store.read("t", ROWS).collect()))
    store.compact({"t": ROWS, "none": ROWS})
    assert len(store.head().visible) == 1
    assert sorted(map(tuple, store.read("t", ROWS).collect())) == before
    store.publish(put(spark, store, "p", 3))
    assert rows(store) == [1, 2, 3]
    store.restore(first)
    assert rows(store) == [1]


def test_a_run_begins_anew_if_another_published_meanwhile(spark, tmp_path, monkeypatch):
    engine, other = Engine(spark, f"file://{tmp_path}/h"), Engine(spark, f"file://{tmp_path}/h")
    original, calls = Engine._ended, []

    def meanwhile(self, *args):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(Engine, "_ended", original)
            other._run(listing(spark, ADA, GRACE), PEOPLE, 1000, 0, True, None, None, False)
        return original(self, *args)

    monkeypatch.setattr(Engine, "_ended", meanwhile)
    report = engine.run(listing(spark, ADA), PEOPLE, now_ms=2000)
    assert report.outcome == "ran"
    assert len(engine.store.heads()) == 2
    assert {r.subject[-1] for r in engine.assertions().filter("lifecycle = 'Active'").collect()} == {"1"}


def test_cursor_short_cut_and_links(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/h")
    people = listing(spark, ADA, GRACE)
    assert engine.window(PEOPLE, 10**9, 1) == (10**9 - 86_400_000, 10**9)
    assert engine.run(people, PEOPLE, now_ms=10**9).outcome == "ran"
    assert engine.run(people, PEOPLE, now_ms=2 * 10**9).outcome == "unchanged"
    assert engine.window(PEOPLE, 3 * 10**9, 1)[0] == 2 * 10**9 - 300_000
    # held back, so it is looked at again, and its window stays open
    changed = listing(spark, ADA, {**GRACE, "role": "lead"})
    held = engine.run(changed, PEOPLE, now_ms=2 * 10**9 + 1, refresh_days=30)
    assert held.classes == {"unchanged": 1, "held": 1}
    assert engine.run(changed, PEOPLE, now_ms=2 * 10**9 + 2, refresh_days=30).outcome == "ran"
    assert engine.window(PEOPLE, 3 * 10**9, 1)[0] < 2 * 10**9 - 300_000
    assert engine.run(changed, PEOPLE, now_ms=9 * 10**9, refresh_days=30).classes == {"unchanged": 1, "changed": 1}

    linked = Engine(spark, f"file://{tmp_path}/l")
    links = spark.createDataFrame([("hr:people:2", "IN", "v1", 0)], "key string, relation string, tag string, ord int")
    assert linked.run(people, PEOPLE, now_ms=1000, links=links.limit(0)).classes == {"new": 2}
    # only its links changed: at once, without waiting for the days of a change
    assert linked.count(people, PEOPLE, 2000, 30, links) == {"unchanged": 1, "changed": 1}
    assert linked.count(changed, PEOPLE, 2000, 30, links) == {"unchanged": 1, "held": 1}


def test_links_and_cleaning_of_odd_texts(spark):
    texts = ['{"b": "password=hunter2x", "a": [1, "x"]}', "[1]", "no json password=hunter2x", None, "{}", '{"a": "\\u00e9\\"", "a b": null}']
    records = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    none = spark.createDataFrame([], "key string, relation string, tag string, ord int")
    found = {r.key: r.unlinked for r in mapping.linked(records, none).collect()}
    assert found == {"0": '{"a":[1,"x"],"b":"password=hunter2x"}', "1": None, "2": None, "3": None, "4": "{}", "5": '{"a":"é\\"","a b":null}'}
    clean = {r.key: r.c for r in records.select("key", mapping.clean_json(records.text).alias("c")).collect()}
    masked = "password=[masked:secret-assignment]"
    assert clean == {"0": f'{{"b": "{masked}", "a": [1, "x"]}}', "1": "[1]", "2": f"no json {masked}", "3": None, "4": "{}", "5": '{"a": "\\u00e9\\"", "a b": null}'}
