"""Measures over the store and its answers: quality, evaluation, spend, source status, answer records, figures."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factline.functions.sums import micros
from factline.functions.text import normal
from factline.operators.running import numbered

OUTCOMES = ("ran", "fetch-failed", "extraction-failed", "apply-refused")
BARS, ENTRIES, NODES, EDGES = 50, 200, 100, 300
BAR_WIDTH = 360
WILSON_Z = 1.96


def sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``size`` rows drawn by a hash of their key: the same rows for the same seed, however they are partitioned."""
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("_draw", draw).orderBy("_draw", key).limit(size).drop("_draw")


def judged(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts with their first verdict (fact, verdict, ord) of yes, no or unclear; unclear where there is none."""
    first = verdicts.groupBy("fact").agg(F.min_by("verdict", "ord").alias("_v"))
    known = F.col("_v").isin("yes", "no", "unclear")
    return facts.join(first, "fact", "left").withColumn("verdict", F.when(known, F.col("_v")).otherwise("unclear")).drop("_v")


def quality(judged_: DataFrame) -> DataFrame:
    """One row: judged, passed, unclear, rate of passed of those decided, and its Wilson interval."""
    n = F.count_if(F.col("verdict") != "unclear").cast("double")
    good = F.count_if(F.col("verdict") == "yes")
    rate = F.when(n > 0, good / n)
    z2 = WILSON_Z * WILSON_Z
    middle, spread = (rate + z2 / (2 * n)) / (1 + z2 / n), WILSON_Z * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return judged_.agg(
        F.count("*").alias("judged"), good.alias("passed"), F.count_if(F.col("verdict") == "unclear").alias("unclear"),
        F.round(rate, 6).alias("rate"), F.round(middle - spread, 6).alias("lower"), F.round(middle + spread, 6).alias("upper"),
    )


def eval_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Cases (case, facts, nodes) beside answers (case, text, cited): expected facts that the text has, and nodes it cites.

    A fact is there if its normalised text is part of the normalised answer; a case without an answer has missed all.
    """
    joined = cases.join(answers, "case", "left")
    text = F.coalesce(normal(F.col("text")), F.lit(""))
    facts = F.size(F.filter("facts", lambda f: text.contains(normal(f))))
    nodes = F.size(F.array_intersect("nodes", F.coalesce("cited", F.array().cast("array<string>"))))
    passed = (facts == F.size("facts")) & (nodes == F.size(F.array_distinct("nodes")))
    return joined.select("case", F.size("facts").alias("facts"), facts.alias("facts_found"), F.size("nodes").alias("nodes"), nodes.alias("nodes_found"), passed.alias("passed"))


#: Needles without an inner word that are broadcast at a time.
NEEDLE_BLOCK = 10_000


def _holding(docs: DataFrame, needles: list[tuple], needle_id: T.StructField) -> DataFrame:
    """``(needle_id, doc_id)`` of documents (doc_id, _doc) that have a needle anywhere in them."""
    shared = docs.sparkSession.sparkContext.broadcast(needles)
    schema = T.StructType([T.StructField("needle_id", needle_id.dataType), docs.schema["doc_id"]])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for number, (_, text) in enumerate(shared.value):
            automaton.add_word(text, [*automaton.get(text, []), number])
        automaton.make_automaton()
        kind = to_arrow_schema(schema)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("_doc").to_pylist(), strict=True):
                hits = {n for _, some in automaton.iter(text) for n in some} if text and len(automaton) else ()
                if hits:
                    ids = [shared.value[n][0] for n in hits]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, kind.field(0).type), pa.array([doc_id] * len(ids), kind.field(1).type)], schema=kind)

    return docs.select("doc_id", "_doc").mapInArrow(find, schema)


def containments(needles: DataFrame, haystack: DataFrame, words: int = 8) -> DataFrame:
    """``(needle_id, doc_id)`` where the document's normalised text has the needle's in it, exactly.

    Both meet by the needle's inner words, up to ``words`` of them: the first and last may stand inside longer words of the
    document, those between are whole words there. Only ids and keys are shuffled for that; the texts are compared for what
    met. Needles of fewer than three words have no inner one; an automaton of ``NEEDLE_BLOCK`` of them at a time reads each document once.
    """
    asked = needles.withColumn("_text", normal(F.col("needle"))).filter("_text <> ''").select("needle_id", "_text", F.split("_text", " ").alias("_own"))
    inner = F.slice("_own", 2, F.least(F.size("_own") - 2, F.lit(words)))
    keyed = asked.filter(F.size("_own") > 2).withColumn("_size", F.size(inner)).withColumn("_key", F.array_join(inner, " "))
    docs = haystack.select("doc_id", normal(F.col("text")).alias("_doc"))
    sizes = F.broadcast(keyed.select("_size").distinct())  # at most ``words`` rows
    runs = F.transform(F.sequence(F.lit(1), F.size("_words") - F.col("_size") + 1), lambda i: F.array_join(F.slice("_words", i, F.col("_size")), " "))
    split = docs.select("doc_id", F.split("_doc", " ").alias("_words"))
    grams = split.join(sizes, F.size("_words") >= F.col("_size")).select("doc_id", F.explode(F.array_distinct(runs)).alias("_key"))
    met = keyed.select("needle_id", "_text", "_key").join(grams, "_key").select("needle_id", "_text", "doc_id").distinct()
    found = met.join(docs, "doc_id").filter(F.col("_doc").contains(F.col("_text"))).select("needle_id", "doc_id")
    short = asked.filter(F.size("_own") <= 2)
    blocks = -(-short.count() // NEEDLE_BLOCK)
    for k in range(blocks):
        block = short.filter(F.pmod(F.xxhash64("needle_id"), F.lit(blocks)) == k).select("needle_id", "_text").collect()
        found = found.unionAll(_holding(docs, [(r.needle_id, r._text) for r in block], needles.schema["needle_id"]))
    return found.distinct()


def daily_spend(answers: DataFrame) -> DataFrame:
    """Micro-dollars and tokens per UTC day of answers (at_ms, cost_usd, tokens): costs are rounded each, then summed."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at_ms") / 86_400_000).cast("int"))
    poisoned = F.when(F.count("*") == F.count("tokens"), F.sum("tokens"))
    return answers.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.sum(micros(F.coalesce("cost_usd", F.lit(0.0)))).alias("spent_micros"), poisoned.alias("tokens"))


def daily_ceiling(answers: DataFrame, cap_micros: int) -> DataFrame:
    """Answers with what their day had left before each, and whether it was allowed: anything left at all."""
    spent = numbered(answers, ["day"], ["at_ms", "id"], {"_spent": F.col("micros")})
    return spent.withColumn("remaining", F.lit(cap_micros) - F.col("_spent")).withColumn("allowed", F.col("remaining") > 0).drop("_spent", "_number", "_of")


def left_out(rows: DataFrame) -> DataFrame:
    """``(operation, reason, found, words)`` of records that a fetch left out (operation, reason), in words for a report."""
    counted = rows.groupBy("operation", "reason").agg(F.count("*").alias("found"))
    number = F.concat(F.col("found").cast("string"), F.when(F.col("found") == 1, " record ").otherwise(" records "))
    return counted.withColumn("words", F.concat("operation", F.lit(": "), number, "reason"))


def outcome_counts(runs: DataFrame, sources: DataFrame, outcomes: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """Runs of every source by every outcome, also where there are none."""
    every = sources.select("source", F.explode(F.array(*[F.lit(o) for o in outcomes])).alias("outcome"))
    counted = runs.groupBy("source", "outcome").agg(F.count("*").alias("n"))
    return every.join(counted, ["source", "outcome"], "left").select("source", "outcome", F.coalesce("n", F.lit(0)).cast("bigint").alias("runs"))


def metric_lines(counts: DataFrame, metric: str) -> DataFrame:
    """Counts in the text format of metrics, labels escaped."""
    label = F.replace(F.replace(F.replace(F.col("source").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return counts.select(F.format_string(f'{metric}{{source="%s",outcome="%s"}} %d', label, F.col("outcome"), F.col("runs")).alias("line"))


def last_runs(runs: DataFrame) -> DataFrame:
    """Of every source its last run, by time then order: ``source, last_outcome, last_run_at, runs``."""
    return runs.groupBy("source").agg(F.max_by("outcome", F.struct("at_ms", "ord")).alias("last_outcome"), F.max("at_ms").alias("last_run_at"), F.count("*").alias("runs"))


def disabled(runs: DataFrame, failures: tuple[str, ...] = OUTCOMES[1:], after: int = 2) -> DataFrame:
    """Sources with ``failures`` of ``after`` consecutive runs since their last good one: ``source, consecutive, disabled``."""
    good = runs.groupBy("source").agg(F.max(F.when(~F.col("outcome").isin(*failures), F.struct("at_ms", "ord"))).alias("_good"))
    joined = runs.join(good, "source")
    bad = F.col("outcome").isin(*failures) & (F.col("_good").isNull() | (F.struct("at_ms", "ord") > F.col("_good")))
    return joined.groupBy("source").agg(F.count_if(bad).alias("consecutive")).withColumn("disabled", F.col("consecutive") >= after)


# --- answer records, votes, reviews


def review_causes(answers: DataFrame, votes: DataFrame, slow_ms: int) -> DataFrame:
    """Review items that answers (id, outcome, latency_ms, at_ms) and votes (answer, value, at_ms) open, one for each cause.

    An answer that wasn't given failed, unless its client went away; a slow one is slow, also if it failed; a down vote
    has it looked at. The first opening of a review stands.
    """
    failed = (F.col("outcome") != "answered") & (F.col("outcome") != "client-closed")
    open_ = F.col("outcome") != "client-closed"
    causes = F.array_compact(F.array(F.when(failed, F.lit("failed")), F.when(open_ & (F.col("latency_ms") > slow_ms), F.lit("slow"))))
    own = answers.select(F.col("id").alias("answer"), F.explode(causes).alias("cause"), "at_ms")
    down = votes.filter(F.col("value") == "down").join(answers.select(F.col("id").alias("answer")), "answer", "left_semi")
    every = own.unionByName(down.select("answer", F.lit("voted-down").alias("cause"), "at_ms"))
    first = every.groupBy("answer", "cause").agg(F.min("at_ms").alias("opened_at"))
    return first.select(F.concat(F.col("answer").cast("string"), F.lit(":"), F.col("cause")).alias("review"), "answer", "cause", "opened_at")


def cast_votes(votes: DataFrame, answers: DataFrame) -> DataFrame:
    """One vote of a reader on an answer: the last; votes on answers that aren't there don't count."""
    held = votes.join(answers.select(F.col("id").alias("answer")), "answer", "left_semi")
    last = held.groupBy("answer", "reader").agg(F.max_by(F.struct("value", "at_ms"), F.struct("at_ms", "ord")).alias("v"))
    return last.select(F.concat_ws(":", "answer", "reader").alias("vote"), "answer", "reader", "v.value", "v.at_ms")


def closed(reviews: DataFrame, closings: DataFrame) -> DataFrame:
    """Reviews with the first of their closings (review, reason, at_ms); a later one finds the review closed."""
    first = closings.groupBy("review").agg(F.min_by("reason", "at_ms").alias("reason"), F.min("at_ms").alias("closed_at"))
    return reviews.join(first, "review", "left").withColumn("state", F.when(F.col("closed_at").isNull(), "Open").otherwise("Closed"))


def purged(answers: DataFrame, dependents: DataFrame, before_ms: int) -> tuple[DataFrame, DataFrame]:
    """What stays of answers, and of votes or reviews (by ``answer``), once answers older than ``before_ms`` are gone."""
    stays = answers.filter(F.col("at_ms") >= before_ms)
    return stays, dependents.join(stays.select(F.col("id").alias("answer")), "answer", "left_semi")


def new_cases(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    """Closed reviews with expectations that aren't evaluation cases yet."""
    ready = reviews.filter((F.col("state") == "Closed") & (F.size("expectations") > 0))
    return ready.join(cases.select("review"), "review", "left_anti")


# --- figures


def bars(rows: DataFrame, label: str, count: str) -> DataFrame:
    """At most ``BARS`` bars, largest first, with integer widths against the largest; a count above zero shows."""
    top = rows.orderBy(F.desc(count), label).limit(BARS)
    most = F.max(count).over(Window.partitionBy())
    width = F.greatest(F.floor(F.col(count) * BAR_WIDTH / most).cast("bigint"), F.when(F.col(count) > 0, 1).otherwise(0).cast("bigint"))
    return top.select(F.col(label).alias("label"), F.col(count).alias("count"), F.when(most > 0, width).otherwise(F.lit(0).cast("bigint")).alias("width"))


def graph_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Why a relationship graph can't be drawn: ends that aren't nodes, and node ids that repeat."""
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    ends = edges.select(F.explode(F.array("source", "target")).alias("_id")).distinct()
    missing = ends.join(ids, "_id", "left_anti").select(F.lit("unknown end").alias("problem"), F.col("_id").alias("id"))
    repeated = nodes.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), "id")
    return missing.unionByName(repeated)


def xml_text(text: Column) -> Column:
    """Text for XML: the five entities, control characters as replacement characters."""
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�")
