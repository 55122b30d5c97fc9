"""JSON paths, scalars, templates and typed values, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.functions.spans import let

STRING, INTEGER, DECIMAL, BOOLEAN, TIMESTAMP = "String", "Integer", "Decimal", "Boolean", "Timestamp"
KINDS = (STRING, INTEGER, DECIMAL, BOOLEAN, TIMESTAMP)


def blank_to_null(text: Column) -> Column:
    """The text, or null where nothing but white space is in it."""
    return F.when(F.trim(text) != "", text)


def json_path(path: str) -> str:
    """``a.b`` or ``$.a.b`` as a JSON path; ``$`` is the whole record. There is no indexing of arrays."""
    if path == "$":
        return path
    return "$." + path.removeprefix("$.")


def at(record: Column, path: str) -> Column:
    """JSON text at a dotted path of a record; null where it is absent."""
    return F.get_json_object(record, json_path(path))


def kind_at(record: Column, path: str) -> Column:
    """The JSON kind at a path: OBJECT, ARRAY, STRING, BOOLEAN, a number type, VOID, or null where absent."""
    return _kind(F.try_parse_json(record), path)


def _kind(parsed: Column, path: str) -> Column:
    return shape_name(F.try_variant_get(parsed, json_path(path), "variant"))


def shape_name(value: Column) -> Column:
    """The kind of a variant without what it holds: the schema up to its first bracket."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def scalar_at(record: Column, path: str) -> Column:
    """A non-blank string, a number or a Boolean at a path, as text; null for anything else."""
    kind = kind_at(record, path)
    return F.when(~kind.isin("OBJECT", "ARRAY", "VOID"), blank_to_null(at(record, path)))


def worked_out(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` beside columns that are worked out once for each row: a filter over them is not moved below, where it would work them out again."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))) if columns else rows


def with_scalars(records: DataFrame, record: str, paths: dict[str, str]) -> DataFrame:
    """``records`` beside a column for each path, given by the column's name: the scalar there, as ``scalar_at`` gives it.

    A record is parsed once for all kinds, and read once for each path; expressions over the columns read nothing again.
    """
    parsed = records.withColumn("_parsed", F.try_parse_json(F.col(record)))
    read = worked_out(parsed, {name: F.struct(_kind(F.col("_parsed"), path).alias("kind"), at(F.col(record), path).alias("text")) for name, path in paths.items()})
    return read.select(*records.columns, *[F.when(~F.col(name)["kind"].isin("OBJECT", "ARRAY", "VOID"), blank_to_null(F.col(name)["text"])).alias(name) for name in paths])


def scalars_at(record: Column, path: str) -> Column:
    """Every scalar at a path as an array of text: the elements of an array, or the one value."""
    kind = kind_at(record, path)
    elements = F.from_json(at(record, path), "array<string>")
    listed = F.filter(elements, lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.substring(F.trim(x), 1, 1).isin("{", "["))
    return F.when(kind == "ARRAY", listed).otherwise(F.array_compact(F.array(scalar_at(record, path))))


_FIELD = re.compile(r"\{([^{}]*)\}")


def _parts(template: str) -> list[tuple[bool, str]]:
    """Template text split into (is a field, text)."""
    parts, last = [], 0
    for m in _FIELD.finditer(template):
        parts += [(False, template[last : m.start()]), (True, m[1])]
        last = m.end()
    return [p for p in [*parts, (False, template[last:])] if p[1] or p[0]]


def template_fields(template: str) -> list[str]:
    return [text for is_field, text in _parts(template) if is_field]


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template in which an absent field is empty; an opening brace without its closing one stays."""
    cells = [F.coalesce(fields[t].cast("string"), F.lit("")) if f and t in fields else F.lit("" if f else t) for f, t in _parts(template)]
    return F.concat(F.lit(""), *cells)


def render_strict(template: str, fields: dict[str, Column]) -> Column:
    """A template that is null if any of its fields is missing or blank."""
    cells = [(blank_to_null(fields[t].cast("string")) if t in fields else F.lit(None).cast("string")) if f else F.lit(t) for f, t in _parts(template)]
    return F.concat(F.lit(""), *cells)


def convert(kind: str, text: Column, json_kind: Column | None = None) -> Column:
    """Text to the canonical text of a kind, as ``struct(value, ok)``.

    A null or blank value is no value and no error; a value that isn't of the kind is an error. Integers are 64-bit;
    decimals stay as written; Booleans are ``true`` and ``false`` in any case; timestamps become epoch milliseconds.
    """
    held = blank_to_null(text)
    if kind == STRING:
        value = held
    elif kind == INTEGER:
        value = F.when(held.rlike(r"^[+-]?[0-9]+$"), held.try_cast("bigint")).cast("string")
    elif kind == DECIMAL:
        number = r"^[+-]?[0-9]+(\.[0-9]+)?$" if json_kind is None else r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
        value = F.when(held.rlike(number), held)
    elif kind == BOOLEAN:
        value = F.when(F.lower(held).isin("true", "false"), F.lower(held))
    elif kind == TIMESTAMP:
        from factline.functions.times import rfc3339_ms

        value = rfc3339_ms(held).cast("string")
    else:
        raise ValueError(f"there is no kind {kind!r}")
    return let(value, lambda v: F.struct(v.alias("value"), (held.isNull() | v.isNotNull()).alias("ok")))


def resolve_kinds(named: dict[str, str | None], declared: dict[str, str]) -> dict[str, str]:
    """A mapping's kinds: the one it names, else what the store declares, else String; a contradiction is refused."""
    clashes = [f"{p}: {k} here, {declared[p]} in the store" for p, k in named.items() if k and p in declared and declared[p] != k]
    if clashes:
        raise ValueError("; ".join(sorted(clashes)))
    return {p: k or declared.get(p, STRING) for p, k in named.items()}


def same_json(left: Column, left_kind: Column, right: Column, right_kind: Column) -> Column:
    """Equal scalars of one JSON kind; numbers by value, whole ones never through a lossy double."""
    numeric = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT")
    both = left_kind.isin(*numeric) & right_kind.isin(*numeric)
    return F.when(both, left.try_cast("decimal(38,12)") == right.try_cast("decimal(38,12)")).otherwise((left_kind == right_kind) & (left == right))


def passes_text(value: Column, values: list[str], include: bool = True) -> Column:
    """An include or exclude filter; an absent value equals nothing."""
    return F.coalesce(value.isin(*values), F.lit(False)) == F.lit(include)
