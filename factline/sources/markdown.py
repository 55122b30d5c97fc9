"""Second-level sections of markdown, which need the lines in order: a small fold over one file's lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_UNDERLINE = re.compile(r"^ {0,3}-+\s*$")
_NOT_PARAGRAPH = re.compile(r"^(?: {4}|\t| {0,3}(?:[-*+>#]|\d{1,9}[.)] ))")


def sections(text: str) -> Iterator[dict[str, str]]:
    """Sections under ``## `` headings and headings underlined with dashes: ``{heading, body}``, both trimmed.

    Front matter and whatever stands before the first heading are dropped. Inside a fence, which closes at one of its kind
    at least as long, nothing is a heading.
    """
    lines = text.removeprefix("﻿").split("\n")
    lines = [line.removesuffix("\r") for line in lines]
    if lines[0].rstrip() == "---":
        close = next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() in ("---", "...")), None)
        if close is not None:
            lines = lines[close + 1 :]
    fence = ""
    heading: str | None = None
    body: list[str] = []
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        elif line.startswith("## "):
            if heading is not None:
                yield {"heading": heading, "body": "\n".join(body).strip()}
            heading, body = line[3:].strip().rstrip("#").strip(), []
            continue
        elif _UNDERLINE.match(line) and i and lines[i - 1].strip() and not _NOT_PARAGRAPH.match(lines[i - 1]) and (i < 2 or not lines[i - 2].strip()):
            if heading is not None:
                yield {"heading": heading, "body": "\n".join(body[:-1]).strip()}
            heading, body = lines[i - 1].strip(), []
            continue
        body.append(line)
    if heading is not None:
        yield {"heading": heading, "body": "\n".join(body).strip()}


def _sections(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: list(sections(t)) if t is not None else None)


def markdown_sections(text: Column) -> Column:
    """A text's sections as an array of ``struct(heading, body)``."""
    return F.pandas_udf(_sections, "array<struct<heading:string,body:string>>")(text)


def section_keys(rows, group: list[str], order: list[str]):  # noqa: ANN001, ANN201
    """Keys of sections: their heading, a repeated one with ``-2`` and so on in file order."""
    from factline.operators.ordered import suffixed_keys

    return suffixed_keys(rows, group, "heading", order)
