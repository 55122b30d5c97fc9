"""Walks over stored pages that name their next one: in which order pages are read, and why a walk ends.

Pages are found by token, in no order. Their places are worked out by doubling: a table of jumps of 1, 2, 4, ... pages, each joined
with itself for the next, carries the pages placed so far as far ahead again, so a walk of n pages takes log2(n) rounds of equi-joins,
for all walks, those of parents and of their children, at once; pages beyond the most that a walk reads are not placed. A cycle shows as a round that places no page that wasn't.

Defined cases: a null token is the first page's where a walk starts without one; of pages stored twice under one token the least counts;
a walk whose first page isn't stored reads none; a next token without a page ends it as ``missing page``; tokens are compared as they
are, and a null walk is a walk of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.operators.tables import dropped, saved
from factline.sources.pages import link_parameter, percent_decoded


def next_token(style: str, given: Column, current: Column, param: str = "cursor") -> Column:
    """What a page says is next: a blank says nothing.

    ``PageNumber`` without a value counts on from the current page (1 without one); ``NextLink`` reads a parameter of the link.
    """
    named = F.when(F.trim(given) != "", given)
    if style == "PageNumber":
        return F.coalesce(named, (F.coalesce(F.trim(current).try_cast("long"), F.when(current.isNull(), F.lit(1))) + 1).cast("string"))
    if style == "NextLink":
        value = percent_decoded(link_parameter(named, param))
        return F.when(value != "", value)
    return named


def placed(pages: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``(walk, token, page)`` of every page that a walk gets to, from 1, up to page ``most``; pages (walk, token, next), starts (walk, token)."""
    links = saved(pages.select(_named("walk").alias("w"), _named("token").alias("t"), F.col("next").alias("n")).groupBy("w", "t").agg(F.min(F.struct("n"))["n"].alias("n")), "walk-links")
    have = links.select("w", F.col("t"))
    first = starts.select(_named("walk").alias("w"), _named("token").alias("t")).distinct().join(have, ["w", "t"], "left_semi")
    places = saved(first.select("w", "t", F.lit(1).cast("long").alias("page")), "walk-places")
    known = links.select("w", "t", F.concat(F.lit("="), "n").alias("n")).filter("n is not null")
    jumps = saved(known.join(have.withColumnRenamed("t", "n"), ["w", "n"], "left_semi"), "walk-jumps")
    step, count = 1, places.count()
    while True:
        ahead = places.join(jumps, ["w", "t"]).select("w", F.col("n").alias("t"), (F.col("page") + step).alias("page"))
        before, places = places, saved(places.unionByName(ahead).groupBy("w", "t").agg(F.min("page").alias("page")), "walk-places")
        dropped(before)
        new = places.count()
        if new == count or most is not None and 2 * step >= most:  # pages 1 to 2 * step are placed
            break
        count, step = new, 2 * step
        onward = jumps.select("w", F.col("t").alias("n"), F.col("n").alias("m"))
        before, jumps = jumps, saved(jumps.join(onward, ["w", "n"]).select("w", "t", F.col("m").alias("n")), "walk-jumps")
        dropped(before)
    dropped(links, jumps)
    if most is not None:
        places = places.filter(F.col("page") <= most)
    return places.select(_bare("w").alias("walk"), _bare("t").alias("token"), "page")


def _named(column: str) -> Column:
    """A text that joins by equality where null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _bare(column: str) -> Column:
    return F.when(F.col(column) != "", F.substring(F.col(column), F.lit(2), F.length(column)))


def walked(pages: DataFrame, starts: DataFrame, max_pages: int) -> DataFrame:
    """``(walk, page, token, rows, ended, unread)`` of the pages read: pages (walk, token, rows, next), starts (walk, token).

    ``ended`` is on the last page of each walk: ``empty page``, ``no next``, ``missing page``, ``repeated token`` or ``max pages``. ``unread`` is true
    where that leaves pages unread: at ``max pages``, and at an empty page that still names a next one.
    """
    keyed = pages.select(_named("walk").alias("w"), _named("token").alias("t"), "rows", "next").groupBy("w", "t").agg(F.min(F.struct("next", "rows")).alias("p"))
    # The page after the last one tells whether there is one.
    order = placed(pages, starts, max_pages + 1).select(_named("walk").alias("w"), _named("token").alias("t"), "page")
    read = order.join(keyed, ["w", "t"]).select("w", "t", "page", F.col("p.rows").alias("rows"), F.concat(F.lit("="), "p.next").alias("next"))
    target = order.select("w", F.col("t").alias("next"), F.col("page").alias("to"))
    # Only the first page's token is asked for without having been named by a page.
    led = read.join(target, ["w", "next"], "left")
    reason = (
        F.when(F.col("rows") == 0, "empty page").when(F.col("next").isNull(), "no next").when(F.col("to").isNull(), "missing page")
        .when(F.col("to") <= F.col("page"), "repeated token").when(F.col("page") >= max_pages, "max pages")
    )
    marked = led.withColumn("ended", reason)
    stop = marked.groupBy("w").agg(F.min(F.when(F.col("ended").isNotNull(), F.col("page"))).alias("stop"))
    kept = marked.join(stop, "w").filter(F.col("page") <= F.col("stop"))
    unread = (F.col("ended") == "max pages") | ((F.col("ended") == "empty page") & F.col("next").isNotNull())
    return kept.select(_bare("w").alias("walk"), "page", _bare("t").alias("token"), "rows", "ended", F.coalesce(unread, F.lit(False)).alias("unread"))


def parent_of(child: Column) -> Column:
    """The parent in the name that ``child_walk`` gives a walk."""
    return F.element_at(F.split(child, "/", 2), 2)


def child_walk(operation: str, parent: Column) -> Column:
    """A name for the walk over a parent's children, so that both are walks of one table."""
    return F.concat(F.lit(operation.replace("/", "%2F") + "/"), parent)
