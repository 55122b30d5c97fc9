"""Files as documents: whole files, JSON lines, JSON records, markdown sections, lookup files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.functions.values import passes_text, render
from factline.sources.markdown import markdown_sections

FILE_BYTES = 16 << 20


def files(spark: SparkSession, roots: list[str], glob: str = "*") -> DataFrame:
    """``path, length, content`` of every file under the roots; content is null where the file is too large to read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
        .select("path", "length", F.when(F.col("length") <= FILE_BYTES, F.col("content")).alias("content"))
    )


def whole_files(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of non-blank UTF-8 files, by path; and the files skipped, with the reason."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = found.withColumn("text", text)
    docs = read.filter("text is not null and trim(text) <> ''").select(F.col("path").alias("key"), F.lit("File").alias("origin"), "text")
    reason = F.when(F.col("content").isNull(), "too large").when(F.col("text").isNull(), "not UTF-8")
    return docs, read.withColumn("reason", reason).filter("reason is not null").select("path", "reason")


def json_lines(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of JSON-lines files (path, line, record), lines counted from 1; and lines that aren't JSON. Blank ones don't count."""
    text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^﻿", "")
    lines = found.withColumn("_text", text).select("path", F.posexplode(F.split("_text", "\n")).alias("_at", "record")).filter(F.trim(F.regexp_replace("record", "\r$", "")) != "")
    lines = lines.withColumn("line", F.col("_at") + 1).withColumn("_json", F.try_parse_json("record").isNotNull())
    return lines.filter("_json").select("path", "line", "record"), lines.filter(~F.col("_json")).select("path", "line")


def json_records(found: DataFrame, records: str) -> DataFrame:
    """Records of the list at a path of each JSON file (path, ord, record); a file that can't be read so fails the scan."""
    path = "$" if records == "$" else "$." + records.removeprefix("$.")
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    listed = found.withColumn("_list", F.from_json(F.get_json_object(text, path), "array<string>"))
    held = F.when(F.col("_list").isNull(), F.raise_error(F.concat(F.lit("no list of records in "), F.col("path"))).cast("array<string>")).otherwise(F.col("_list"))
    return listed.select("path", F.posexplode(held).alias("ord", "record"))


def lookup(found: DataFrame) -> DataFrame:
    """``id, name`` of JSON objects of strings; blank ids and names are left out, a file of another form fails the scan."""
    entries = F.from_json(F.col("content").cast("string"), "map<string,string>")
    held = F.when(entries.isNull(), F.raise_error(F.concat(F.lit("no object in "), F.col("path"))).cast("map<string,string>")).otherwise(entries)
    return found.select(F.explode(held).alias("id", "name")).filter("trim(id) <> '' and trim(name) <> ''")


def with_mentions(records: DataFrame, names: DataFrame, key: str, text: str) -> DataFrame:
    """``<@id>`` and ``<@id|label>`` in a text as ``@name`` where the id is known; others stay."""
    pattern = r"<@([^>|]+)(?:\|[^>]*)?>"
    ids = records.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("id"))
    known = ids.join(names, "id").groupBy(key).agg(F.collect_list(F.struct("id", "name")).alias("_names"))
    joined = records.join(known, key, "left")
    empty = F.array().cast("array<struct<id:string,name:string>>")

    def swap(t: Column, n: Column) -> Column:
        labelled = F.regexp_replace(t, F.concat(F.lit(r"<@\Q"), n["id"], F.lit(r"\E\|[^>]*>")), F.concat(F.lit("@"), F.regexp_replace(n["name"], r"([\\$])", r"\\$1")))
        return F.replace(labelled, F.concat(F.lit("<@"), n["id"], F.lit(">")), F.concat(F.lit("@"), n["name"]))

    return joined.withColumn(text, F.aggregate(F.coalesce("_names", empty), F.col(text), swap)).drop("_names")


def record_documents(records: DataFrame, key: Column, template: str, fields: dict[str, Column], author: Column | None = None, include: tuple[Column, list[str]] | None = None) -> DataFrame:
    """Documents of file records: an include filter, a text template, an author in front; blank texts are left out."""
    kept = records.filter(passes_text(include[0], include[1])) if include else records
    body = render(template, fields)
    text = F.when(author.isNotNull(), F.concat(author, F.lit(": "), body)).otherwise(body) if author is not None else body
    return kept.withColumn("_body", body).withColumn("text", text).withColumn("key", key).filter("trim(_body) <> ''").drop("_body").withColumn("origin", F.lit("FileRecord"))


def section_records(found: DataFrame) -> DataFrame:
    """``path, section, heading, body`` of every second-level section of markdown files."""
    return found.select("path", F.posexplode(markdown_sections(F.col("content").cast("string"))).alias("section", "s")).select("path", "section", "s.heading", "s.body")
