"""Stored web pages and pages of listings: rows to documents, where a walk ends, what the next call asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.values import blank_to_null


def website_documents(rows: DataFrame) -> DataFrame:
    """Rows (url, title, description, content, published) as documents: the text is the content, else the description."""
    text = F.coalesce(blank_to_null(F.col("content")), blank_to_null(F.col("description")))
    kept = rows.withColumn("text", text).filter(blank_to_null(F.col("url")).isNotNull() & F.col("text").isNotNull())
    return kept.select(F.col("url").alias("key"), F.lit("Url").alias("origin"), "title", "description", "published", "text")


def html_rows(pages: DataFrame) -> DataFrame:
    """``url, title, description, content`` of raw pages: the title element, the description, and the text without tags."""
    html = F.col("html")
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1))
    description = F.regexp_extract(html, r"(?is)<meta\s+name=[\"']description[\"']\s+content=[\"']([^\"']*)[\"']", 1)
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), r"<[^>]*>", " ")
    return pages.select("page_id", "url", blank_to_null(title).alias("title"), blank_to_null(description).alias("description"), F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("content"))


def link_parameter(link: Column, name: str) -> Column:
    """The first value of a query parameter of a link as written; null where there is none."""
    value = F.regexp_extract(link, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(link.rlike(rf"[?&]{name}="), value)


def percent_decoded(text: Column) -> Column:
    """Percent escapes decoded; a percent sign that starts none stays; null where the bytes aren't UTF-8."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_validate_utf8(F.try_url_decode(safe))


def walked(pages: DataFrame, max_pages: int) -> DataFrame:
    """Pages (operation, page, rows, token, next) that a walk reads, and why it ends: ``ended`` on the last of them.

    It ends after a page without rows, one without a next token, one whose next token was met before, or ``max_pages``.
    """
    w = Window.partitionBy("operation").orderBy("page")
    seen_before = F.array_contains(F.collect_list("token").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("next"))
    reason = F.when(F.col("rows") == 0, "empty page").when(F.col("next").isNull(), "no next").when(seen_before, "repeated token").when(F.row_number().over(w) >= max_pages, "max pages")
    marked = pages.withColumn("ended", reason)
    before = F.count("ended").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.withColumn("_before", before).filter("_before = 0").drop("_before")


def until_older(records: DataFrame, group: str, order: str, time_ms: str, since_ms: int) -> DataFrame:
    """Records in order up to the first that is older than the window; unreadable times never stop."""
    cut = F.min(F.when(F.col(time_ms) < since_ms, F.col(order))).over(Window.partitionBy(group))
    return records.withColumn("_cut", cut).filter(F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))).drop("_cut")


def picked_connection(connections: DataFrame) -> DataFrame:
    """Per adapter and profile its connection, if exactly one is live: ``adapter, profile, live, connection``."""
    live = F.when(~F.col("revoked"), F.col("connection"))
    counted = connections.groupBy("adapter", "profile").agg(F.count_distinct(live).alias("live"), F.min(live).alias("connection"))
    return counted.withColumn("connection", F.when(F.col("live") == 1, F.col("connection")))


def child_calls(parents: DataFrame, calls: DataFrame, ladder: int = 3) -> DataFrame:
    """What failed child calls (parent, failures) make of their parents: ``read``, ``held`` for the window, or ``skipped``."""
    joined = parents.join(calls, "parent", "left")
    n = F.coalesce("failures", F.lit(0))
    return joined.withColumn("state", F.when(n == 0, "read").when(n < ladder, "held").otherwise("skipped"))
