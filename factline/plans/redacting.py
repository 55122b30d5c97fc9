"""Queries about a policy's redaction: who claims which stretch of a text, known names in any form, words outside, numbers.

Values are planted behind whole documents, after a line break, so that SQL can say where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators import redactor
from factline.operators.redactor import Policy, Rule
from factline.operators.running import numbered
from factline.plans.registry import Registry, table

registry = Registry()
query = registry.query


def _planted(spark: SparkSession, sf_dir: str, planted: Column) -> DataFrame:
    """``doc_id``, the whole text with a line behind it, and where that line begins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("head"))
    return docs.select("doc_id", F.concat("head", planted).alias("text"), F.length("head").alias("base"))


def _claims(claimed: DataFrame) -> DataFrame:
    """Claims behind the place where the planted line begins, counted from there."""
    each = claimed.select("doc_id", "base", F.explode("claims").alias("c")).filter(F.col("c.start") >= F.col("base"))
    return each.select("doc_id", F.col("c.label").alias("label"), (F.col("c.start") - F.col("base")).alias("first"), (F.col("c.end") - F.col("base")).alias("last"), F.col("c.value").alias("value"))


# Every customer has a name with a letter that has two normal forms; a document mentions one as its number says.
_CUSTOMERS = "select row_number() over (order by c_custkey) - 1 as n, c_custkey, count(*) over () as every from customer"


@query(f"""
with c as ({_CUSTOMERS}), d as (select doc_id, cast(c_custkey as varchar) as k from documents join c on n = doc_id % every)
select doc_id, 0 as first, length('ZOÉ  ' || k) as last, case doc_id % 3 when 0 then 'ZOÉ  ' when 1 then 'zoé  ' else 'Zoé  ' end || k as value from d where doc_id % 3 < 2
union all select doc_id, 0, 11 + length(k), 'Zoe' || chr(769) || chr(10) || ' ' || k || ' Ltd.' from d where doc_id % 3 = 2
union all select doc_id, length('ZOÉ  ' || k) + 2, length('ZOÉ  ' || k) + 2 + length('ZOE. ' || k), 'Zoe' || chr(769) || ' ' || k from d where doc_id % 3 < 2
union all select doc_id, 15 + length(k), 20 + 2 * length(k), 'Zoe' || chr(769) || ' ' || k from d where doc_id % 3 = 2
""")
def known_name_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    names = customers.select(F.concat(F.lit("Zoé "), "k").alias("name")).unionByName(customers.select(F.concat(F.lit("Zoé "), "k", F.lit(" Ltd.")).alias("name")))
    keys = numbered(table(spark, sf_dir, "customer").select("c_custkey"), [], ["c_custkey"]).select((F.col("_number") - 1).alias("_n"), F.col("c_custkey").cast("string").alias("_key"))
    every = keys.count()
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("head"), (F.col("doc_id") % max(1, every)).alias("_n")).join(keys, "_n")
    key = F.col("_key")
    turn = F.col("doc_id") % 3
    said = F.when(turn == 0, F.concat(F.lit("ZOÉ  "), key)).when(turn == 1, F.concat(F.lit("zoé  "), key)).otherwise(F.concat(F.lit("Zoé\n "), key, F.lit(" Ltd.")))
    again = F.when(turn == 2, F.lit(" or ")).otherwise(F.lit(", "))
    planted = F.concat(said, again, F.lit("Zoé "), key, F.lit("; xZoé "), key, F.lit(", Zoe "), key, F.lit(", Zoéy "), key)
    text = docs.select("doc_id", F.concat("head", planted).alias("text"), F.length("head").alias("base"))
    found = redactor.with_claims(text, Policy(), names)
    return _claims(found).select("doc_id", "first", "last", "value")


@query("""
with d as (select doc_id, sha256(cast(doc_id as varchar)) as h, doc_id % 6 as turn from documents)
select doc_id, 'Team' as label, 6 as first, 16 as last, 'Widget 007' as value from d where turn = 0
union all select doc_id, 'known_names', 20, 28, 'Jane Doe' from d where turn = 0
union all select doc_id, 'Credential', 6, 42, 'glpat-JaneDoe' || substr(h, 1, 23) from d where turn = 1
union all select doc_id, 'Email', 5, 25, 'jane.doe@example.org' from d where turn = 2
union all select doc_id, 'known_names', 30, 38, 'JANE DOE' from d where turn = 2
union all select doc_id, 'Url', 4, 35, 'https://example.org/Jane_Doe(1)' from d where turn = 3
union all select doc_id, 'IpAddress', 5, 16, '2001:db8::1' from d where turn = 4
union all select doc_id, 'IpAddress', 21, 29, '10.0.0.7' from d where turn = 4
union all select doc_id, 'Phone', 5, 22, '+49 30 1234567 x9' from d where turn = 5
union all select doc_id, 'PaymentCard', 27, 46, '4111 1111 1111 1111' from d where turn = 5
union all select doc_id, 'Code', 51, 57, 'ZZ-' || substr(h, 1, 3) from d where turn = 5
""")
def redaction_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest, turn = F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id") % 6
    planted = (
        F.when(turn == 0, F.lit("About Widget 007 or Jane Doe.")).when(turn == 1, F.concat(F.lit("Token glpat-JaneDoe"), F.substring(digest, 1, 23)))
        .when(turn == 2, F.lit("Mail jane.doe@example.org and JANE DOE")).when(turn == 3, F.lit("See https://example.org/Jane_Doe(1)).")).when(turn == 4, F.lit("From 2001:db8::1 and 10.0.0.7."))
        .otherwise(F.concat(F.lit("Ring +49 30 1234567 x9 and 4111 1111 1111 1111 and ZZ-"), F.substring(digest, 1, 3)))
    )
    policy = Policy(("Credential", "Url", "Email", "PaymentCard", "IpAddress", "Phone"), (Rule("Team", "Widget [0-9]{3}", "[team]"), Rule("Code", "ZZ-[0-9a-f]{3}")))
    names = spark.createDataFrame([("Jane Doe",), ("Doe",), ("Widget 007 or Jane",)], "name string")
    return _claims(redactor.with_claims(_planted(spark, sf_dir, planted), policy, names))


@query(r"""
with t as (select source, regexp_replace(coalesce(text, ''), '[0-9A-Za-z.]+@[0-9A-Za-z.]+', chr(1), 'g') as t from documents),
w as (select source, unnest(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_\x01]+(?:[''’]\p{Lu}[\p{L}\p{M}\p{N}_\x01]*|-\p{L}[\p{L}\p{M}\p{N}_\x01]*)*')) as word from t)
select source, word, count(*) as uses from w
where regexp_full_match(word, '\p{Lu}[\p{L}\p{M}]*(?:(?:[''’]\p{Lu}|-\p{L})[\p{L}\p{M}]*)*') and regexp_matches(word, '\p{Ll}') group by source, word
""")
def words_outside_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Policy(rules=(Rule("Address", "[0-9A-Za-z.]+@[0-9A-Za-z.]+", "[address]"),))
    docs = table(spark, sf_dir, "documents").select("source", "text")
    return redactor.word_counts(redactor.with_words(redactor.with_claims(docs, policy)), "source")


@query(r"""
with recursive g as (
  select doc_id, list_transform(range(0, 9), lambda i: lpad(cast(cast('0x' || substr(sha256(doc_id || ':' || i), 1, 7) as bigint) % cast(pow(10, 1 + (doc_id + i) % 5) as bigint) as varchar), cast(1 + (doc_id + i) % 5 as integer), '0')) as g
  from documents),
w as (select doc_id, i, j, g[i:j] as some, array_to_string(g[i:j], '') as digits, array_to_string(g[i:j], ' ') as value from g, (select unnest(range(1, 10)) as i), (select unnest(range(1, 10)) as j) where j between i and i + 7),
fit as (
  select doc_id, i, max(j) as j, max_by(value, j) as value from w where length(digits) between 13 and 19 and
    list_sum(list_transform(range(1, length(digits) + 1), lambda p: case when p % 2 = 1 then cast(reverse(digits)[p] as integer)
      else (2 * cast(reverse(digits)[p] as integer)) // 10 + (2 * cast(reverse(digits)[p] as integer)) % 10 end)) % 10 = 0 group by doc_id, i),
taken as (
  select doc_id, i, j, value from (select *, row_number() over (partition by doc_id order by i) as nth from fit) where nth = 1
  union all
  select doc_id, i, j, value from (select f.*, row_number() over (partition by f.doc_id order by f.i) as nth from taken t join fit f on f.doc_id = t.doc_id and f.i > t.j) where nth = 1)
select doc_id, value from taken
""")
def longest_card_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def group(i: int) -> Column:
        width = (1 + (F.col("doc_id") + i) % 5).cast("int")
        number = F.conv(F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(f":{i}")), 256), 1, 7), 16, 10).cast("long") % F.pow(F.lit(10), width).cast("long")
        return F.lpad(number.cast("string"), width, "0")

    planted = F.concat_ws(" ", *[group(i) for i in range(9)])
    return _claims(redactor.with_claims(_planted(spark, sf_dir, planted), Policy(("PaymentCard",)))).select("doc_id", "value")


@query("""
with d as (select doc_id, lpad(cast(doc_id % 1000 as varchar), 3, '0') as n from documents)
select doc_id, case doc_id % 5 when 0 then '555-' || n || '7' when 1 then '(030) ' || n || ' 12' else '12 34 56' end as value from d where doc_id % 5 < 3
""")
def numbers_to_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, turn = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.col("doc_id") % 5
    planted = (
        F.when(turn == 0, F.concat(F.lit("Please call me on 555-"), n, F.lit("7."))).when(turn == 1, F.concat(F.lit("Tel.: (030) "), n, F.lit(" 12, thanks")))
        .when(turn == 2, F.lit("Handy 12 34 56")).when(turn == 3, F.lit("Call 0900-1700 on 2026-10-05, phone 12345")).otherwise(F.lit("order 555-1234567, called 0123456789ab"))
    )
    docs = _planted(spark, sf_dir, planted)
    return redactor.called_numbers(docs.select("doc_id", F.substring(F.col("text"), F.col("base"), F.length("text")).alias("text")), "doc_id")


@query("""
with d as (select doc_id, doc_id // 50 as batch, 'ZZ-' || (doc_id * 7 % 40) as a, 'ZZ-' || (doc_id % 3) as b, coalesce(text, '') as base from documents),
v as (select batch, a as value, doc_id, 0 as place from d union all select batch, b, doc_id, 1 from d),
f as (select batch, value, min((doc_id, place)) as first from v group by batch, value),
m as (select batch, value, '[Code-' || row_number() over (partition by batch order by first) || ']' as shown from f)
select doc_id, sha256(base || chr(10) || x.shown || ' and ' || y.shown || ' [team] [=Code-1] [==Late-2]') as hash
from d join m x on x.batch = d.batch and x.value = d.a join m y on y.batch = d.batch and y.value = d.b
""")
def hidden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.concat(F.lit("ZZ-"), F.col("doc_id") * 7 % 40), F.concat(F.lit("ZZ-"), F.col("doc_id") % 3)
    docs = _planted(spark, sf_dir, F.concat(first, F.lit(" and "), second, F.lit(" Widget 007 [Code-1] [=Late-2]"))).withColumn("batch", F.floor(F.col("doc_id") / 50))
    policy = Policy(rules=(Rule("Team", "Widget [0-9]{3}", "[team]"), Rule("Code", "ZZ-[0-9]{1,2}")))
    return redactor.hidden(redactor.with_claims(docs, policy), "batch", "doc_id")[0].select("doc_id", F.sha2("text", 256).alias("hash"))
