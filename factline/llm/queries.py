"""The operators applied, with production parameters, to their whole tables; and the SQL that says the same, where any can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.llm import ann, capfilters, centroids, chat, decontam, langid, licenses, packing, simhash, substrings, tokenbin, tokencount, turns

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.written(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return tokenbin.read(spark, path)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digests(turns.repair(*damaged(_table(spark, sf_dir, "conversations"))))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults put in by a hash of their place, and which of them are still there."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(place.cast("binary")) % 20).alias("damage"))
    broken = rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), "damage",
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    )
    return broken, F.col("damage") != 0


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, final = centroids.clustered(_table(spark, sf_dir, "embeddings"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(final.tolist())]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    about = named.join(sums, "cluster").crossJoin(total)  # a row per centroid with the one total
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_embedding_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_id, op2_nearest_neighbours, op3_simhash, op4_decontamination, op5_repeated_passages,
        op6_token_ids, op7_chat_format, op8_license_scan, op9_packing, op10_token_counts,
        op11_conversation_repair, op12_centroid_clusters, op13_embedding_near_copies,
    )
    return {f.__name__: f for f in found}


OP4_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct size from windows),
places as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
found as (select p.doc_id, p.i, p.size, w.item_id from places p join windows w on p.size = w.size and p.phrase = w.phrase),
hit as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + size)) as k from found) group by doc_id),
items as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
  cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(items.ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join items on d.doc_id = items.doc_id
"""

OP7_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
x as (
  select *, regexp_replace(text, '(\\|\[INST\]|\[/INST\]|</s>|<s>|<\|assistant\|>|<\|role\|>|<\|text\|>)', '\\\1', 'g') as escaped,
    regexp_replace(role, '(\\|\[INST\]|\[/INST\]|</s>|<s>|<\|assistant\|>|<\|role\|>|<\|text\|>)', '\\\1', 'g') as escaped_role from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(escaped) + case role when 'user' then 13 when 'assistant' then 17 else 20 + length(escaped_role) end) as bigint) as formatted_chars
from x group by conv_id
"""


OP11_SQL = r"""
with recursive
-- crc32 bit by bit: DuckDB has none
placed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place from conversations),
hashed as (
  select *, xor(list_reduce(list_transform(range(1, length(place) + 1), lambda i: cast(ascii(place[i]) as bigint)),
    lambda c, b: list_reduce(range(8), lambda x, j: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) % 20 as damage from placed),
broken as (
  select conv_id, turn, case when damage = 4 then 'user' else role end as role,
    case damage when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when damage = 3 then [0, 1] else [0] end) as again from hashed where damage <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) as i,
    row_number() over (partition by conv_id, role, text order by turn nulls first, again) as nth from broken),
faulty as (
  select *, role[1] as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when nth > 1 then 'd'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else '' end as fault,
    lag(role[1]) over (partition by conv_id order by i) as before from numbered),
figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) as n,
    count(*) filter (i > 1 and (before || initial) not in ('su', 'ua', 'au')) as illegal from faulty group by conv_id),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
inserts(s, t, edit, lines) as (values (0, 0, '', []::varchar[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
  (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
edits(s, t, edit, initial, cost) as (values (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
  (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (3, 2, 'R', '', 2), (2, 3, 'R', '', 2), (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3)),
reached as (
  select f.conv_id, cast(0 as bigint) as i, x.t as state, cast(2 * len(x.edit) as bigint) as cost, x.edit as audit, x.lines from figures f join inserts x on x.s = 0
  union all
  select conv_id, i, state, way.cost, way.audit, way.lines from (
    select w.conv_id, w.i + 1 as i, x.t as state, min({'cost': w.cost + e.cost + 2 * len(x.edit) + case when f.fault = 't' and e.edit <> 'D' then 1 else 0 end,
      'audit': w.audit || e.edit || x.edit, 'lines': list_concat(w.lines, case e.edit when 'K' then [f.role || ':' || f.text]
        when 'R' then [case e.t when 2 then 'user:' else 'assistant:' end || f.text] else [] end, x.lines)}) as way
    from reached w join faulty f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
    join edits e on e.s = w.state and (e.edit = 'D' or f.fault not in ('b', 'd')) and (e.edit <> 'K' or e.initial = f.initial)
    join inserts x on x.s = e.t group by w.conv_id, w.i + 1, x.t)),
best as (
  select r.conv_id, min({'cost': r.cost, 'audit': r.audit, 'lines': r.lines}) as way
  from reached r join figures f on f.conv_id is not distinct from r.conv_id and f.n = r.i where r.state in (0, 3) group by r.conv_id)
select c.conv_id, cast(coalesce(f.gaps, 0) as bigint) as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate,
  coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal, coalesce(b.way.cost, 0) as cost, coalesce(b.way.audit, '') as audit,
  sha256(coalesce(array_to_string(b.way.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join figures f on f.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id
"""


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after another; sums are of exact integers."""
    steps = [
        """v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)""",
        f"""c0 as (
  select cast(row_number() over (order by h, x) - 1 as integer) as c, x from (
    select sha256('2:' || coalesce(cast(vec_id as varchar), '')) as h, x from v order by h, x limit {k}))""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} as (
  select vec_id, p.x, min({{'d': list_sum(list_transform(list_zip(p.x, q.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'c': c}}) as best
  from (select *, row_number() over () as place from v) p cross join c{n} q group by place, vec_id, p.x)"""
        )
        if n < rounds:
            steps.append(
                f"""s{n} as (
  select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as x from (
    select best.c as c, i, sum(x[i]) as s, count(*) as n from a{n} cross join (select unnest(range(1, 65)) as i) group by best.c, i) group by c),
c{n + 1} as (select q.c, coalesce(s.x, q.x) as x from c{n} q left join s{n} s on s.c = q.c)"""
            )
    return f"""with {", ".join(steps)}
select vec_id, best.c as cluster, cast(best.d as bigint) as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
  cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(q.x, ',')) as centroid_sha256
from a{rounds} join c{rounds} q on q.c = best.c"""


OP13_SQL = """
with recursive v as (
  select vec_id, case when len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 then list_transform(embedding, lambda x: cast(x as double)) end as x from embeddings),
links as (
  select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id <> q.vec_id and len(p.x) = len(q.x) where list_cosine_similarity(p.x, q.x) >= 0.95),
reached(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reached r join links l on l.a = r.b),
least as (select a, min(b) as component_id from reached group by a)
select v.vec_id, coalesce(n.n, 0) as n_links, least.component_id, v.vec_id = least.component_id as kept
from v join least on least.a = v.vec_id left join (select a, count(*) as n from links group by a) n on n.a = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_embedding_near_copies": OP13_SQL, "op12_centroid_clusters": _op12_sql(), "op11_conversation_repair": OP11_SQL, "op4_decontamination": OP4_SQL, "op7_chat_format": OP7_SQL}
