"""Hashes, identities, evidence and small text rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD_BYTES = 16_384
EVIDENCE_SCHEMA = "factline.payload.v1"


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def content_hash(payload: Column) -> Column:
    """Hash of an evidence payload, under its format's name."""
    return F.sha2(F.concat(F.encode(F.lit(EVIDENCE_SCHEMA), "utf-8"), payload.cast("binary")), 256)


def escape(part: Column) -> Column:
    """``%``, ``:`` and ``,`` written as ``%`` and two hex digits, so that parts can be joined by them."""
    for c in "%:,":
        part = F.replace(part, F.lit(c), F.lit(f"%{ord(c):02x}"))
    return part


def identity(prefix: Column, record_id: Column, masked_id: Column | None = None) -> Column:
    """Prefix and id; an id that masking would alter is replaced by the first 16 hex digits of its hash."""
    own = record_id if masked_id is None else F.when(masked_id != record_id, F.substring(F.sha2(record_id, 256), 1, 16)).otherwise(record_id)
    return F.concat(prefix, F.lit(":"), escape(own))


def child_key(prefix: Column, operation: str, parent: Column, child: Column) -> Column:
    return F.concat(prefix, F.lit("/" + operation + ":"), escape(parent), F.lit(":"), escape(child))


def aliases(name: Column, identity_: Column, mapped: Column) -> Column:
    """``name (identity)``, the identity, then mapped aliases: distinct, in that order, none null."""
    first = F.array(F.concat(name, F.lit(" ("), identity_, F.lit(")")), identity_)
    return F.array_distinct(F.array_compact(F.concat(first, mapped)))


def one_line(text: Column) -> Column:
    """Control characters and line separators as spaces."""
    return F.regexp_replace(text, r"[\p{Cc}  ]", " ")


def normal(text: Column) -> Column:
    """Lower-cased, white space runs as one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def evidence_text(source: Column, title: Column, published: Column, description: Column, lead: Column, text: Column) -> Column:
    """Header lines of what is known, a blank line, the lead, the text."""
    header = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), one_line(c)) for n, c in (("Source", source), ("Title", title), ("Published", published), ("Description", description))])
    return F.concat_ws("\n\n", header, lead, text)


def evidence_fields(payload: Column) -> Column:
    """``struct(source, title, published, description, body)`` of what ``evidence_text`` wrote; a field without a line is null."""
    blank = F.instr(payload, "\n\n")
    header = F.when(blank > 0, F.substring(payload, F.lit(1), blank - 1)).otherwise(payload)
    fields = [F.nullif(F.regexp_extract(header, rf"(?m)^{n}: (.*)$", 1), F.lit("")).alias(n.lower()) for n in ("Source", "Title", "Published", "Description")]
    return F.struct(*fields, F.when(blank > 0, F.substring(payload, blank + 2, F.length(payload))).alias("body"))


def split_context(text: Column) -> Column:
    """``struct(body, context)``: the text before and from the first context mark on."""
    place = F.instr(text, "\n\n[context")
    body = F.when(place > 0, F.substring(text, F.lit(1), place - 1)).otherwise(text)
    return F.struct(body.alias("body"), F.when(place > 0, F.substring(text, place, F.length(text))).alias("context"))


def percent_encoded(text: Column) -> Column:
    """RFC 3986 unreserved characters kept, all others as upper-case percent bytes."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def citation_ids(answer: Column) -> Column:
    """Ids cited as ``[node:…]`` or ``[evidence:…]``, each once, in the order met."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[((?:node|evidence):[^\]\s]+)\]"), F.lit(1)))


def failure_class(message: Column) -> Column:
    """What a failed call says about itself: ``too-large``, ``unavailable`` or ``failed``."""
    low = F.lower(message)
    large = low.contains("too long") | low.contains("too large") | low.contains("context length") | low.contains("maximum context")
    away = low.contains("rate limit") | low.contains("overloaded") | low.contains("unavailable") | low.contains("timed out") | low.contains("connection")
    return F.when(large, "too-large").when(away, "unavailable").otherwise("failed")
