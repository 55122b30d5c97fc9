import json
import random
import time

import pytest
from pyspark.sql import functions as F

from factline.operators import changes, lifecycle, linking, mapping, ordered, redaction
from factline.plans.engine import Engine
from factline.sources import files, markdown, snapshot
from factline.streaming import ingest

PEOPLE = mapping.Mapping(
    adapter="hr", operation="people", node_type="Person", id="id", name="name", aliases=("handle",),
    properties=(mapping.Property("role", "role"), mapping.Property("email", "contact.email"), mapping.Property("age", "age", "Integer")),
    relations=(mapping.Relation("REPORTS_TO", "manager", "Person"),),
)


def listing(spark, *records):
    return spark.createDataFrame([(json.dumps(r), i) for i, r in enumerate(records)], "record string, ord long")


ADA = {"id": "1", "name": "Ada", "role": "lead", "handle": "ada", "contact": {"email": "ada@example.com"}, "age": 40}
GRACE = {"id": "2", "name": "Grace", "role": "dev", "manager": "Ada"}


def test_mapping_of_people(spark):
    rows = listing(spark, ADA, GRACE, {**ADA, "name": "again"}, {"id": "3"}, {"id": "4", "name": "Bad", "age": "old"})
    mapped = mapping.mapped_records(rows, PEOPLE)
    assert {r.identity: r.aliases for r in mapped.collect()}["hr:people:1"] == ["Ada (hr:people:1)", "hr:people:1", "ada"]
    assert {r.identity: r.unconverted for r in mapped.collect()} == {"hr:people:1": [], "hr:people:2": [], "hr:people:4": ["age"]}
    kept = mapping.kept(mapped)
    assert {(r.subject[-1], r.predicate, r.value) for r in mapping.property_facts(kept).collect()} == {("1", "role", "lead"), ("1", "email", "ada@example.com"), ("1", "age", "40"), ("2", "role", "dev")}
    assert [(r.subject, r.target) for r in mapping.relation_facts(kept, PEOPLE).collect()] == [("hr:people:2", "Ada")]
    with pytest.raises(ValueError, match="declared"):
        mapping.ontology([PEOPLE, mapping.Mapping("x", "y", "Person", "id", "name", properties=(mapping.Property("age", "a"),))])


def test_three_revisions_of_a_listing(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/home")
    first = engine.run(listing(spark, ADA, GRACE), PEOPLE, now_ms=1000)
    assert (first.outcome, first.classes, first.facts) == ("ran", {"new": 2}, 5)
    assert engine.count(listing(spark, ADA, {**GRACE, "role": "lead"}), PEOPLE, 2000) == {"unchanged": 1, "changed": 1}
    second = engine.run(listing(spark, ADA, {**GRACE, "role": "lead"}), PEOPLE, now_ms=2000)
    assert (second.facts, second.superseded, second.retracted) == (1, 1, 0)
    active = {(r.subject[-1], r.predicate, r.object) for r in engine.assertions().filter("lifecycle = 'Active'").collect()}
    assert active == {("1", "role", "lead"), ("1", "email", "ada@example.com"), ("1", "age", "40"), ("2", "role", "lead"), ("2", "REPORTS_TO", "Ada")}
    refused = engine.run(listing(spark, ADA), PEOPLE, now_ms=3000, checks=[("retracted", None, "1")])
    assert (refused.outcome, refused.retracted, refused.failed_checks) == ("apply-refused", 2, ["retracted"])
    assert engine.assertions().filter("lifecycle = 'Active'").count() == 5
    partial = engine.run(listing(spark, ADA), PEOPLE, now_ms=3500, complete=False)
    assert (partial.outcome, partial.retracted) == ("ran", 0)
    third = engine.run(listing(spark, ADA), PEOPLE, now_ms=4000)
    assert third.retracted == 2
    assert engine.run(listing(spark, ADA), PEOPLE, now_ms=5000).retracted == 0
    engine.restore(first.revision)
    assert engine.assertions().filter("lifecycle = 'Active'").count() == 5
    assert engine.fingerprint(listing(spark, ADA, GRACE), PEOPLE) == engine.fingerprint(listing(spark, GRACE, ADA), PEOPLE)


def test_cursor():
    start = 10 * changes.DAY_MS
    assert changes.Cursor().window(start, 3) == (7 * changes.DAY_MS, start)
    assert changes.Cursor(last_success=start).window(start + 5, 3) == (start - 300_000, start + 5)
    assert changes.Cursor(start, 77, 50).window(start, 3) == (50, start)
    assert changes.Cursor(1).after(10, 90, True, None, None, False) == changes.Cursor(90, None, None)
    assert changes.Cursor(1).after(10, 90, True, 40, 20, True) == changes.Cursor(1, 20, 20)


def test_batch_size():
    assert ordered.batch_size(7, None, 0, 0) == 7
    assert ordered.batch_size(None, None, 0, 0) == 60_000
    assert ordered.batch_size(None, 8_000, 0, 100) == 8_900
    assert ordered.batch_size(None, 1_000, 900, 100) == 4_000


def test_poison_documents_are_skipped(spark):
    docs = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h")], "key string, hash string")
    failures = spark.createDataFrame([("a", "h", 3, 0), ("b", "old", 3, 0), ("c", "h", 0, 2)], "key string, hash string, runs int, batches int")
    left = changes.without_skipped(docs, failures)
    assert {r.key for r in left.collect()} == {"b", "c"}
    assert {r.key: r.alone for r in changes.asked_alone(left, failures).collect()} == {"b": True, "c": True}


def test_failed_comparison_ends_links(spark):
    tags = spark.createDataFrame([(1, "v1", 10), (1, "v2", 20), (1, "v2b", 20), (1, "v3", 30)], "parent int, tag string, time long")
    made = spark.createDataFrame([(1, "a", 5), (1, "b", 10), (1, "c", 15), (1, "d", 25), (1, "e", 99)], "parent int, change string, time long")
    assert {r.change: r.tag for r in linking.compare_links(made, tags).collect()} == {"a": "v1", "b": "v1", "c": "v2", "d": "v3"}
    failed = spark.createDataFrame([(1, "v2b")], "parent int, tag string")
    assert {r.change: r.tag for r in linking.compare_links(made, tags, failed).collect()} == {"a": "v1", "b": "v1", "c": "v2"}


def test_pseudonyms_mean_the_same_in_a_batch(spark):
    texts = ["a@b.com and 10.0.0.1", "again a@b.com, [Email-1] as written", "nothing", None]
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "doc_id long, batch string, text string")
    hidden, pairs = redaction.pseudonymised(docs, "batch", "doc_id", "text")
    shown = {r.doc_id: r.text for r in hidden.collect()}
    assert shown[0] == "[Email-1] and [IpAddress-1]"
    assert "a@b.com" not in shown[1]
    back = {r.doc_id: (r.text, r.unrestored) for r in redaction.restored(hidden, pairs, "batch", "doc_id", "text").collect()}
    assert back == {i: (t, 0) for i, t in enumerate(texts)}
    assert redaction.left_over(docs, ["IpAddress"]).count() == 1
    assert redaction.left_over(hidden, ["Email", "IpAddress"]).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\ufeff{"ts": "1", "text": "hi <@u1> <@u2|x>"}\n\nnot json\n{"ts": "2", "text": " "}\n')
    (tmp_path / "b.md").write_text("## A\none\n```\n## no\n```\n## A\ntwo")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "d.json").write_text('{"rows": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "names.json").write_text('{"u1": "Ada$1", "u2": " "}')
    root = [f"file://{tmp_path}"]
    records, bad = files.json_lines(files.files(spark, root, "*.jsonl"))
    assert ([r.line for r in records.orderBy("line").collect()], [r.line for r in bad.collect()]) == ([1, 4], [3])
    texts = records.select("line", F.get_json_object("record", "$.text").alias("text"))
    mentions = files.with_mentions(texts, files.lookup(files.files(spark, root, "names.json")), "line", "text")
    assert mentions.filter("line = 1").first().text == "hi @Ada$1 <@u2|x>"
    sections = files.section_records(files.files(spark, root, "*.md"))
    assert [(r.heading, r.body) for r in sections.orderBy("section").collect()] == [("A", "one\n```\n## no\n```"), ("A", "two")]
    assert [r.unique_key for r in markdown.section_keys(sections, ["path"], ["section"]).orderBy("section").collect()] == ["A", "A-2"]
    docs, skipped = files.whole_files(files.files(spark, root))
    assert docs.count() == 4
    assert [r.reason for r in skipped.collect()] == ["not UTF-8"]
    assert files.json_records(files.files(spark, root, "d.json"), "rows").count() == 2
    with pytest.raises(Exception, match="no list of records"):
        files.json_records(files.files(spark, root, "d.json"), "other").collect()


def test_a_stream_of_documents_is_applied_once(spark, tmp_path):
    schema = "key string, text string, origin string, ord long"
    source = f"{tmp_path}/in"
    spark.createDataFrame([("a", "1", "Url", 0), ("b", "1", "Url", 1), ("a", "9", "Url", 2)], schema).coalesce(1).write.json(source)
    store = ingest.Store(spark, f"file://{tmp_path}/store")

    def drain():
        ingest.start(spark, spark.readStream.schema(schema).json(source), store, f"{tmp_path}/cp", 1000, 0).awaitTermination()
        return sorted((r.key, r.text, r["class"]) for r in store.read("documents", "key string, text string, hash string, class string, batch_id long").collect())

    assert drain() == [("a", "1", "new"), ("b", "1", "new")]
    spark.createDataFrame([("a", "1", "Url", 0), ("b", "2", "Url", 1)], schema).coalesce(1).write.mode("append").json(source)
    assert drain() == [("a", "1", "new"), ("b", "1", "new"), ("b", "2", "changed")]
    ingest.apply_batch(store, spark.createDataFrame([("b", "2", "Url", 0)], schema), 9, 2000, 0)
    assert len(drain()) == 3


def test_a_value_that_does_not_convert_ends_nothing_else(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/home")
    engine.run(listing(spark, ADA, GRACE), PEOPLE, now_ms=1000)
    report = engine.run(listing(spark, {**ADA, "age": "old"}, GRACE), PEOPLE, now_ms=2000)
    assert (report.facts, report.unconverted, report.superseded, report.retracted) == (0, 1, 0, 1)
    active = {(r.subject[-1], r.predicate, r.object) for r in engine.assertions().filter("lifecycle = 'Active'").collect()}
    assert active == {("1", "role", "lead"), ("1", "email", "ada@example.com"), ("2", "role", "dev"), ("2", "REPORTS_TO", "Ada")}
    assert engine.count(listing(spark, {**ADA, "age": "old"}, GRACE), PEOPLE, 3000) == {"unchanged": 2}


def test_records_are_parsed_once(spark):
    plan = mapping.mapped_records(listing(spark, ADA), PEOPLE)._jdf.queryExecution().optimizedPlan().toString()
    paths = 6  # id, name, handle, role, contact.email, age
    assert plan.count("get_json_object") + plan.count("GetJsonObject") <= 2 * paths
    assert plan.lower().count("parse_json") <= 1


@pytest.mark.parametrize("n", [3, 130])
def test_chains_of_aliases_are_one_however_long(spark, n):
    things = [("T", f"t{(i * 37) % 1000:04}", f"a{i + k}") for i in range(n) for k in (0, 1)] + [("U", "t0000", "a1"), ("T", "z", "other")]
    found = {(r.type, r.thing): r.component for r in linking.alias_closure(spark.createDataFrame(things, "type string, thing string, alias string")).collect()}
    assert len(found) == n + 2
    assert {c for (t, x), c in found.items() if t == "T" and x != "z"} == {"t0000"}
    assert (found["U", "t0000"], found["T", "z"]) == ("t0000", "z")


ASSERTED = "id string, lifecycle string, subject string, predicate_kind string, predicate string, object string, valid_from long, valid_to long, evidence array<string>"


def test_held_ancestors_keep_their_records(spark):
    records = ["s:o:1", "s:o:1:c:2", "s:o:1:c:2:n:3", "s:o:12:c:2", "s", None]
    mine = spark.createDataFrame([(str(i), "Property", "p", "x", [r]) for i, r in enumerate(records)], "id string, predicate_kind string, predicate string, object string, records array<string>")
    none = spark.createDataFrame([], "record string, predicate string, value string")
    held = spark.createDataFrame([("s:o:1:", None), ("s:o:1", None)], "prefix string, relation string")
    kept = {r.id: r.kept for r in lifecycle.with_kept(mine, none, none.select("record"), held).collect()}
    # a held prefix holds what is under it, not the record of that name
    assert kept == {"0": False, "1": True, "2": True, "3": False, "4": False, "5": False}


def test_supersede_equals_trying_all_kept_ones(spark):
    r = random.Random(9)
    rows = []
    for i in range(400):
        start = r.choice([None, *range(8)])
        stop = r.choice([None, *range(8)])
        rows.append((f"a{i:03}", r.choice(["Property", "Property", "Relation"]), "s", f"p{i % 9}", "x", start, stop, ["r"], r.random() < 0.4))
    marked = spark.createDataFrame(rows, "id string, predicate_kind string, subject string, predicate string, object string, valid_from long, valid_to long, records array<string>, kept boolean")
    found = {x.id: (x.op, x.replaced_by, x.effective_from) for x in lifecycle.ended(marked).collect()}
    wanted = {}
    for id_, kind, _, predicate, _, start, stop, _, kept in rows:
        if kept:
            continue
        fits = [(f, i) for i, k, _, p, _, f, _, _, keep in rows if keep and k == kind == "Property" and p == predicate and f is not None and (start is None or f >= start) and (stop is None or f <= stop)]
        wanted[id_] = ("Supersede", max(fits)[1], max(fits)[0]) if fits else ("Retract", None, None)
    assert found == wanted


def test_twenty_thousand_superseded_in_time(spark):
    n = 20_000
    old = spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("object"), F.lit(1).cast("long").alias("valid_from"))
    new = spark.range(n).select(F.col("id").alias("k"), F.lit("new").alias("object"), F.lit(2).cast("long").alias("valid_from"))
    foreign = spark.range(n).select((F.col("id") + n).alias("k"), F.lit("far").alias("object"), F.lit(1).cast("long").alias("valid_from"))
    record = F.concat(F.lit("s:"), "k")
    every = old.unionByName(new).unionByName(foreign).select(
        F.concat(F.col("object"), "k").alias("id"), F.lit("Active").alias("lifecycle"), record.alias("subject"), F.lit("Property").alias("predicate_kind"), F.lit("status").alias("predicate"), "object", "valid_from",
        F.lit(None).cast("long").alias("valid_to"), F.array(F.concat(F.lit("e:"), record)).alias("evidence"),
    )
    evidence = spark.range(n).select(F.concat(F.lit("e:s:"), "id").alias("evidence_id"), F.concat(F.lit("s:"), "id").alias("record"))
    claims = spark.range(n).select(F.concat(F.lit("s:"), "id").alias("record"), F.lit("status").alias("predicate"), F.lit("new").alias("value"))
    start = time.time()
    marked = lifecycle.with_kept(lifecycle.owned(every, evidence), claims, spark.createDataFrame([], "record string"))
    assert {tuple(x) for x in lifecycle.ended(marked).groupBy("op").count().collect()} == {("Supersede", n)}
    assert time.time() - start < 20


def test_plans_read_each_table_a_few_times(spark, sf):
    from factline.plans import lifecycle as plans

    def scans(df):
        return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan parquet")

    from factline.plans import mapping as mapped

    assert mapped.map_order_facts(spark, sf)._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("regexp_extract(") < 10
    _, operations = plans._operations(spark, sf)
    assert scans(operations) < 10
    assert scans(plans.retracted_edges(spark, sf)) < 20


def physical(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_common_values_and_prefixes_stay_out_of_joins(spark):
    rows = [("a", "Property", "status", "O", ["s:orders:1"]), ("b", "Relation", "BY", "c1", ["s:orders:1", "s:orders:2:n"]), ("c", None, "x", "O", ["s:orders:2"]), ("d", "Property", "status", "O", ["s:orders:2"])]
    mine = spark.createDataFrame(rows, "id string, predicate_kind string, predicate string, object string, records array<string>")
    claims = spark.createDataFrame([("s:orders:1", "status", "O")], "record string, predicate string, value string")
    names = spark.createDataFrame([("c1", "One")], "object string, name string")
    held = spark.createDataFrame([("s:orders:2:", None)], "prefix string, relation string")
    marked = lifecycle.with_kept(mine, claims, claims.limit(0).select("record"), held, names)
    # A record is under itself only where it has a further part.
    assert {r.id: r.kept for r in marked.collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert "array_contains" in physical(marked) or "IN (3" in physical(marked) or "= 3" in physical(marked)
    assert physical(marked).count("Union") > physical(lifecycle.with_kept(mine, claims, claims.limit(0).select("record"), None, names)).count("Union") > 0


def test_edges_with_absent_ends_and_types(spark):
    nodes = spark.createDataFrame([("n1", "A"), ("n2", None), ("n2", "B")], "id string, type string")
    edges = spark.createDataFrame([("e1", None, "T", "n1"), ("e2", "n1", None, None), ("e3", "n1", "T", "n9"), ("e4", "n2", "T", "n2")], "id string, source string, type string, target string")
    ends = spark.createDataFrame([("T", "A", "B")], "type string, source_type string, target_type string")
    found = snapshot.edge_problems(nodes, edges, ends)
    want = {("n2", "node", "repeated id"), ("e1", "source", "absent"), ("e1", "target", "wrong type"), ("e2", "target", "absent"), ("e2", "type", "absent"), ("e3", "target", "missing node"), ("e4", "source", "wrong type")}
    assert {tuple(r) for r in found.collect()} == want


def test_filters_of_facts_convert_nothing_again(spark, sf):
    from factline.plans.mapping import map_order_facts

    plan = map_order_facts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert plan.count("StructsToJsonEvaluator") == 1
    assert plan.count(r"[Tt ](\d{2})") == 1
