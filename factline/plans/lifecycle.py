"""Queries about the store: what a new listing ends, gates, masking, what may be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.masking import found, mask, masked_count
from factline.functions.text import citation_ids, failure_class, percent_encoded
from factline.operators import lifecycle, redaction
from factline.operators.ordered import greedy_batches
from factline.operators.tables import saved
from factline.plans.registry import Registry, table
from factline.sources import markdown, pages
from factline.sources.files import record_documents

registry = Registry()
query = registry.query

# Two revisions of a listing of orders: the second lacks every tenth order, and every seventh has another status.
_STORE_SQL = """
k as (select o_orderkey as k, 'shop:orders:' || o_orderkey as rec, o_orderstatus as st, 'c' || o_custkey as cust from orders),
a as (select 'a' || k as id, rec, rec as subject, 'Property' as pk, 'status' as pred, st as obj, 1 as vf, k from k
  union all select 'b' || k, rec, rec, 'Property', 'status', 'X', 2, k from k where k % 7 = 0 and k % 10 <> 0
  union all select 'r' || k, rec, rec, 'Relation', 'PLACED_BY', cust, 1, k from k),
owned as (select * from a where k % 101 <> 0),
kept as (select *, k % 97 = 0 or (k % 10 <> 0 and (pk = 'Relation' or obj = case when k % 7 = 0 then 'X' else (select null) end or (pk = 'Property' and k % 7 <> 0))) as kept from owned)
"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("k"), F.concat(F.lit("shop:orders:"), key).alias("record"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("c"), F.col("o_custkey")).alias("customer"))


def _assertions(listing: DataFrame) -> DataFrame:
    def row(tag: str, kind: str, predicate: str, value: F.Column, since: int) -> F.Column:
        return F.struct(F.concat(F.lit(tag), F.col("k")).alias("id"), F.lit(kind).alias("predicate_kind"), F.lit(predicate).alias("predicate"), value.alias("object"), F.lit(since).cast("bigint").alias("valid_from"))

    changed = (F.col("k") % 7 == 0) & (F.col("k") % 10 != 0)
    rows = F.array_compact(F.array(row("a", "Property", "status", F.col("status"), 1), F.when(changed, row("b", "Property", "status", F.lit("X"), 2)), row("r", "Relation", "PLACED_BY", F.col("customer"), 1)))
    evidence = F.when(F.col("k") % 101 == 0, F.array(F.concat(F.lit("e:"), F.col("record")), F.lit("elsewhere"))).otherwise(F.array(F.concat(F.lit("e:"), F.col("record"))))
    one = listing.select(F.col("record").alias("subject"), evidence.alias("evidence"), F.explode(rows).alias("a"))
    return one.select("a.*", "subject", "evidence", F.lit("Active").alias("lifecycle"), F.lit(None).cast("bigint").alias("valid_to"))


def _operations(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    listing = _listing(spark, sf_dir)
    assertions = _assertions(listing)
    evidence = listing.select(F.concat(F.lit("e:"), F.col("record")).alias("evidence_id"), "record")
    listed = listing.filter("k % 10 <> 0")
    status = F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("status"))
    claims = listed.select("record", F.lit("status").alias("predicate"), status.alias("value")).unionByName(listed.select("record", F.lit("PLACED_BY").alias("predicate"), F.concat(F.lit("customer "), F.col("customer")).alias("value")))
    names = listing.select(F.col("customer").alias("object"), F.concat(F.lit("customer "), F.col("customer")).alias("name")).distinct()
    unsettled = listing.filter("k % 97 = 0").select("record")
    marked = lifecycle.with_kept(lifecycle.owned(assertions, evidence), claims, unsettled, held, names)
    return assertions, saved(lifecycle.ended(marked), "operations")


_OPS_SQL = f"""
with {_STORE_SQL},
repl as (select g.id, max({{'f': r.vf, 'i': r.id}}) as best from kept g join kept r on r.rec = g.rec and r.pred = g.pred and r.kept and r.pk = 'Property' and r.vf >= g.vf
  where not g.kept and g.pk = 'Property' group by g.id),
ops as (select g.id, g.subject, g.pred, g.obj, g.pk, case when best is not null then 'Supersede' else 'Retract' end as op, best.i as replaced_by,
  cast(best.f as bigint) as effective_from, case when best is null then rec || ' no longer lists this value' end as reason from kept g left join repl on g.id = repl.id where not g.kept)
"""


@query(_OPS_SQL + "select id, op, replaced_by, effective_from, reason from ops")
def ended_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operations(spark, sf_dir)[1]


@query(_OPS_SQL + "select 'e' || subject as id from ops where op = 'Retract' and pk = 'Relation'")
def retracted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertions, operations = _operations(spark, sf_dir)
    relations = assertions.filter("predicate_kind = 'Relation'")
    edges = relations.select(F.concat(F.lit("e"), F.col("subject")).alias("id"), F.col("subject").alias("source"), F.col("predicate").alias("type"), F.col("object").alias("target"))
    return lifecycle.deleted_edges(edges, relations, operations).select("id")


# Notes of comments of orders, three levels deep; calls failed for some orders, some comments, and for one kind of relation of others.
_NOTES = """
with n as (select 'shop:orders:' || l_orderkey || ':c' || l_linenumber || ':n' || (l_partkey % 2) as record, case when l_suppkey % 3 = 0 then 'Relation' else 'Property' end as kind,
  case when l_suppkey % 2 = 0 then 'BY' else 'text' end as pred, 'a' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey as id from lineitem),
h as (select distinct 'shop:orders:' || l_orderkey || ':' as prefix, null as relation from lineitem where l_orderkey % 5 = 0
  union select distinct 'shop:orders:' || l_orderkey || ':c' || l_linenumber || ':', null from lineitem where l_orderkey % 7 = 1
  union select distinct 'shop:orders:' || l_orderkey || ':', 'BY' from lineitem where l_orderkey % 11 = 2)
"""


@query(_NOTES + "select distinct id, exists (select 1 from h where starts_with(record, prefix) and (relation is null or kind = 'Relation' and relation = pred)) as kept from n")
def held_at_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    order = F.concat(F.lit("shop:orders:"), F.col("l_orderkey"))
    comment = F.concat(order, F.lit(":c"), F.col("l_linenumber"))
    mine = lines.select(
        F.concat(F.lit("a"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("id"), F.when(F.col("l_suppkey") % 3 == 0, "Relation").otherwise("Property").alias("predicate_kind"),
        F.when(F.col("l_suppkey") % 2 == 0, "BY").otherwise("text").alias("predicate"), F.lit("x").alias("object"), F.array(F.concat(comment, F.lit(":n"), F.col("l_partkey") % 2)).alias("records"),
    )
    none = F.lit(None).cast("string")
    held = lines.filter("l_orderkey % 5 = 0").select(F.concat(order, F.lit(":")).alias("prefix"), none.alias("relation"))
    held = held.unionByName(lines.filter("l_orderkey % 7 = 1").select(F.concat(comment, F.lit(":")).alias("prefix"), none.alias("relation")))
    held = held.unionByName(lines.filter("l_orderkey % 11 = 2").select(F.concat(order, F.lit(":")).alias("prefix"), F.lit("BY").alias("relation"))).distinct()
    claims, unsettled = spark.createDataFrame([], "record string, predicate string, value string"), spark.createDataFrame([], "record string")
    names = spark.createDataFrame([("x", "nobody")], "object string, name string")
    return lifecycle.with_kept(mine, claims, unsettled, held, names).select("id", "kept").distinct()


# Customers' earlier identities: by their key, by its digest, under another parent, or of nobody today.
@query("""
with c as (select c_custkey as k, c_nationkey as n, substr(sha256('p' || c_nationkey), 1, 16) as pd, substr(sha256('id' || c_custkey), 1, 16) as d from customer)
select 'old:' || k as old, 'new:' || k as new from c where k % 5 < 3 union all select 'old2:' || k, 'new:' || k from c where k % 5 = 1 and k % 2 = 0
""")
def earlier_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("p"), F.col("c_nationkey")).alias("p"), F.concat(F.lit("id"), F.col("c_custkey")).alias("id"))
    child = F.when(F.col("k") % 2 == 0, "notes")
    parent = F.when(F.col("k") % 2 == 0, F.col("p"))
    new = c.select(F.concat(F.lit("new:"), F.col("k")).alias("key"), child.alias("child"), parent.alias("parent"), "id")

    def digest(column: str) -> F.Column:
        return F.substring(F.sha2(column, 256), 1, 16)

    turn = F.col("k") % 5
    id_ = F.when(turn == 0, F.col("id")).when(turn.isin(1, 2), digest("id")).otherwise(F.concat(F.lit("gone"), F.col("id")))
    old = c.select(F.concat(F.lit("old:"), F.col("k")).alias("key"), child.alias("child"), F.when((turn == 2) & parent.isNotNull(), digest("p")).otherwise(parent).alias("parent"), id_.alias("id"))
    more = c.filter("k % 5 = 1 and k % 2 = 0").select(F.concat(F.lit("old2:"), F.col("k")).alias("key"), child.alias("child"), parent.alias("parent"), "id")
    return lifecycle.renamed(old.unionByName(more), new)


@query(_OPS_SQL + "select id, op from ops where pred <> 'PLACED_BY'")
def held_prefix_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.createDataFrame([("shop:orders", "PLACED_BY")], "prefix string, relation string")
    return _operations(spark, sf_dir, held)[1].select("id", "op")


@query("""
with r as (select count(*) as facts, count(*) filter (event_type = 'error') / count(*) as error_rate, sum(cast(round(value * 100) as bigint)) / 100.0 as cost_usd from events)
select 'facts' as measure, cast(round(cast(facts as decimal(38,10)), 4) as decimal(38,4)) as value, facts >= 1000 as passed from r
union all select 'error_rate', cast(round(cast(error_rate as decimal(38,10)), 4) as decimal(38,4)), round(cast(error_rate as decimal(38,10)), 4) <= 0.2 from r
union all select 'cost_usd', cast(round(cast(cost_usd as decimal(38,10)), 4) as decimal(38,4)), cost_usd <= 1.0 from r
union all select 'absent', null, false from r
""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    report = table(spark, sf_dir, "events").agg(F.count("*").alias("facts"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("error_rate"), (cents / 100.0).alias("cost_usd"))
    return lifecycle.gate(report, [("facts", "1000", None), ("error_rate", None, "0.2"), ("cost_usd", None, "1"), ("absent", "0", None)])


_ASSIGNED = r"(?i)(\b(?:[a-z0-9]{1,40}[_-]){0,4}(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|authorization)[\"'']?[ \t]*(?:=>|=|:[ \t])[ \t]*[\"''`]?)[^\s\"''`]{6,}"


@query(rf"""
with m as (select doc_id, text, regexp_replace(text, '{_ASSIGNED}', '\1[masked:secret-assignment]', 'g') as masked from documents)
select doc_id, sha256(masked) as hash, len(regexp_extract_all(masked, '\[masked:[a-z-]+\]')) as masks from m
""")
def mask_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", mask(F.col("text")).alias("masked"))
    return docs.select("doc_id", F.sha2("masked", 256).alias("hash"), masked_count(F.col("text"), F.col("masked")).cast("bigint").alias("masks"))


@query(r"""
with f as (select doc_id,
  len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9._%+''-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}')) as emails,
  len(list_filter(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}'), lambda a: list_max(list_transform(string_split(a, '.'), lambda p: cast(p as integer))) <= 255)) as addresses,
  len(list_filter(regexp_extract_all(text, '\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}'), lambda v: length(regexp_replace(v, '[^0-9]', '', 'g')) between 7 and 15)) as phones
  from documents)
select doc_id, cast(emails as integer) as emails, cast(addresses as integer) as addresses, cast(phones as integer) as phones from f
""")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found(text, "Email")).alias("emails"), F.size(found(text, "IpAddress")).alias("addresses"), F.size(found(text, "Phone")).alias("phones"))


@query(r"""
with c as (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}')), '[^0-9]', '', 'g') as digits from documents)
select doc_id, digits from c where length(digits) between 13 and 19 and
  list_sum(list_transform(range(1, length(digits) + 1), lambda i: case when i % 2 = 1 then cast(reverse(digits)[i] as integer)
    else (2 * cast(reverse(digits)[i] as integer)) // 10 + (2 * cast(reverse(digits)[i] as integer)) % 10 end)) % 10 = 0
""")
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "documents").select("doc_id", F.explode(found(F.col("text"), "PaymentCard")).alias("card"))
    return cards.select("doc_id", F.regexp_replace("card", "[^0-9]", "").alias("digits"))


@query(r"""
with w as (select source, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}\p{M}]*(?:[''’-]\p{L}[\p{L}\p{M}]*)*')) as word from documents)
select source, word, count(*) as uses from w where regexp_matches(word, '\p{Ll}') and lower(word) not in ('the', 'der', 'les', 'el') group by source, word having count(*) <= 1
""")
def rare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.rare_names(table(spark, sf_dir, "documents"), "source", "text", 1, ["the", "der", "les", "el"])


@query("select doc_id, true as same, cast(0 as bigint) as unrestored from documents")
def pseudonymise_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    batches = greedy_batches(docs, 60_000, "source", "doc_id", "cast(octet_length(text) as bigint)")
    keyed = docs.join(batches, ["source", "doc_id"]).withColumn("batch_id", F.concat_ws(":", "source", "batch"))
    hidden, mapping = redaction.pseudonymised(keyed, "batch_id", "doc_id", "text")
    back = redaction.restored(hidden, mapping, "batch_id", "doc_id", "text").select("doc_id", F.col("text").alias("back"), "unrestored")
    return docs.join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"), F.col("unrestored").cast("bigint").alias("unrestored"))


@query(r"""
with t as (select url, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title>', 1)), '') as title from pages)
select url as subject, 'url' as predicate, url as value from t union all select url, 'title', title from t where title is not null
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factline.operators.mapping import page_facts as facts_of

    rows = pages.html_rows(table(spark, sf_dir, "pages")).withColumn("published", F.lit(None).cast("string"))
    return facts_of(rows.withColumn("description", F.lit(None).cast("string")))


@query(r"""
select page_id, case when regexp_matches(url, '[?&]page=') then regexp_extract(url, '[?&]page=([^&#]*)', 1) end as page from pages
""")
def url_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.link_parameter(F.col("url"), "page").alias("page"))


@query("""
select conv_id || '-' || turn as key, role || ': ' || text as text from conversations where role in ('user', 'assistant') and trim(text) <> ''
""")
def record_filter_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn")
    docs = record_documents(rows, key, "{text}", {"text": F.col("text")}, F.col("role"), (F.col("role"), ["user", "assistant"]))
    return docs.select("key", "text")


@query(r"""
select doc_id, s.i - 1 as section, 'Part ' || s.i || ' of ' || doc_id as heading, case s.i when 1 then 'first body' else 'source ' || source end as body
from documents, (values (1), (2)) s(i)
""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit("---\ntitle: x\n---\nbefore\n\n## Part 1 of "), n, F.lit("\n\nfirst body\n\nPart 2 of "), n, F.lit("\n-----\n source "), F.col("source"), F.lit(" \n")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", content.alias("content"))
    one = docs.select("doc_id", F.posexplode(markdown.markdown_sections(F.col("content"))).alias("section", "s"))
    return one.select("doc_id", "section", "s.heading", "s.body")


@query(r"""
select doc_id, 'node:' || doc_id || ',evidence:' || source as cited, case doc_id % 3 when 0 then 'too-large' when 1 then 'unavailable' else 'failed' end as class,
  'a%20b%2Fc~d%2A' || doc_id as encoded from documents
""")
def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    answer = F.concat(F.lit("See [node:"), n, F.lit("] and [evidence:"), F.col("source"), F.lit("], again [node:"), n, F.lit("]."))
    message = F.when(F.col("doc_id") % 3 == 0, "The prompt is too long").when(F.col("doc_id") % 3 == 1, "Model overloaded, try later").otherwise("No such tool")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(citation_ids(answer), ",").alias("cited"), failure_class(message).alias("class"), percent_encoded(F.concat(F.lit("a b/c~d*"), n)).alias("encoded"))
