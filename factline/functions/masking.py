"""Credentials masked for good, and personal data found: patterns that run inside the JVM.

Java's matcher backtracks, so every pattern keeps its repeats apart by what may follow them, and none nests one unbounded
repeat in another; ``tests/test_functions.py`` holds the time on long texts of near misses to a line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions.credentials import JOINT, name_pattern
from factline.functions.spans import let

# Names of shapes, which masks show, and the openings, alphabets and least lengths of tokens as issuers give them out;
# evidence that is stored holds these masks, so they can't be others. Group 1 is what stays in front of the mask and group 2 what
# stays behind it.
_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "access_key", "private_key", "credential", "credentials", "authorization", "secret_key")
_KEY = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_NAME = name_pattern(_NAMES)
_UNMASKED = r"(?!\[masked:)"
CREDENTIALS: tuple[tuple[str, str], ...] = (
    ("private-key", rf"()-----BEGIN {_KEY}(?:(?!-----(?:END|BEGIN) )[\s\S])*+-----END {_KEY}()"),
    # Without an end line: header lines and lines of the body, ended as such or as an escape, and what a cut left of the last one.
    ("private-key", rf"()-----BEGIN {_KEY}(?:(?:\s|\\[nrt])++(?:[A-Za-z0-9-]{{1,40}}:[^\n\\]*+|[A-Za-z0-9+/=]{{16,}}+|[A-Za-z0-9+/=]++(?=\s*+\z)))*+()"),
    ("aws-access-key", r"()\b(?:AKIA|ASIA)[0-9A-Z]{16,}+\b()"),
    ("gitlab-token", r"()\bglpat-[A-Za-z0-9_\-]{20,}+()"),
    ("github-token", r"()\b(?:gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+)()"),
    ("slack-token", r"()\bxox[abprs]-[A-Za-z0-9\-]{10,}+()"),
    ("tavily-key", r"()\btvly-[A-Za-z0-9_\-]{16,}+()"),
    ("api-key", r"()\bsk-[A-Za-z0-9_\-]{20,}+()"),
    ("jwt", r"()\beyJ[A-Za-z0-9_\-]{8,}+\.eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+()"),
    # A password ends at the last @ before the path, so it may hold one.
    ("url-password", rf"(?i)(\b[a-z][a-z0-9+.\-]{{0,30}}://[^\s/?#@:]*+:){_UNMASKED}[^\s/?#\"<>`{{}}|\\^]+(@)"),
    ("secret-assignment", rf"(?i)((?<![\w-])--?[a-z0-9_-]{{0,40}}?(?:{_NAME})(?:[ \t]{{1,8}}|=)([\"'])){_UNMASKED}[^\"'\r\n]{{6,}}+(\2)"),
    ("secret-assignment", rf"(?i)((?:{_NAME}){JOINT}){_UNMASKED}[^\s\"'`<>\\]{{6,}}+()"),
    ("secret-assignment", rf"(\b[A-Z0-9_]{{0,40}}_PASS\\?[\"']?(?:[ \t]{{0,8}}=[ \t]{{0,8}}|:[ \t]{{1,8}})\\?[\"']?){_UNMASKED}[^\s\"'`<>\\]{{6,}}+()"),
    ("secret-assignment", rf"(?i)(<(?:[a-z0-9_.-]{{0,40}}:)?[a-z0-9_-]{{0,40}}?(?:{_NAME})(?:\s[^<>]{{0,200}})?>\s*+){_UNMASKED}[^\s<>][^<>]{{4,}}+(</)"),
    # Behind a flag stands a secret if it is no variable, no word of prose and no name of a value in capitals.
    ("secret-assignment", rf"(?i)((?<![\w-])--?[a-z0-9_-]{{0,40}}?(?:{_NAME})[ \t]{{1,8}}){_UNMASKED}(?![$<(\[{{]|\p{{L}}++(?:[\s.,;:!?)\]}}]|\z)|(?-i:[A-Z_-]++)(?:\s|\z))[^\s\"']{{6,}}+()"),
)
#: A text that none of these stand in has nothing to mask.
_HINT = "(?i)PRIVATE KEY|AKIA|ASIA|glpat-|gh[pousr]_|github_pat_|xox[abprs]-|tvly-|sk-|eyJ|://|_PASS|" + "|".join(n.replace("_", "[_-]?") for n in _NAMES)

# Candidates of personal data, by class.
PERSONAL: dict[str, str] = {
    "Email": r"[A-Za-z0-9][A-Za-z0-9._%+'-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "PaymentCard": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}",
    "IpAddress": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "Phone": r"\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}",
}


def mask(text: Column) -> Column:
    """Every credential shape as ``[masked:<shape>]``; what is masked already stays as it is."""

    def replaced(out: Column, rule: tuple[str, str]) -> Column:
        behind = 3 if r"(\2)" in rule[1] else 2
        return F.regexp_replace(out, rule[1], f"$1[masked:{rule[0]}]${behind}")

    return F.when(text.rlike(_HINT), reduce(replaced, CREDENTIALS, text)).otherwise(text)


def mask_key(key: Column) -> Column:
    """A document key masked as a text is, except that a value ends at ``&``, ``#`` and their escapes, so that the rest of a link stays."""
    return F.array_join(F.transform(F.split(key, r"(?=[&#]|%(?:25){0,3}2[36])"), mask), "")


#: A text literal of JSON; what follows a key is a colon.
_LITERAL = r'"(?:[^"\\]|\\.)*+"'


def clean_json(record: Column, mask_text: Callable[[Column], Column] = mask) -> Column:
    """A record's JSON with every text value masked, at any depth; keys, numbers and all that stands between stay as written.

    The literals and what stands between them make up the record in turns, so each literal is read, masked and written by itself. A text that
    isn't JSON is masked as a whole, and null stays null.
    """
    literals = F.regexp_extract_all(record, F.lit(_LITERAL), F.lit(0))
    gaps = F.split(record, _LITERAL, -1)

    def clean(literal: Column, after: Column) -> Column:
        value = F.from_json(F.concat(F.lit('{"v":'), literal, F.lit("}")), "v string")["v"]
        masked = let(value, mask_text)
        written = let(F.to_json(F.struct(masked.alias("v"))), lambda j: F.substring(j, F.lit(6), F.length(j) - 6))
        return F.when(after.rlike(r"^\s*:"), literal).when(mask_text(value) == value, literal).otherwise(written)

    cleaned = F.zip_with(literals, F.slice(gaps, F.lit(2), F.size(literals)), lambda v, after: F.concat(clean(v, after), after))
    whole = F.concat(gaps[0], F.array_join(cleaned, ""))
    return F.when(F.try_parse_json(record).isNull(), mask_text(record)).otherwise(whole)


def masked_count(before: Column, after: Column) -> Column:
    """How many masks a text got."""
    pattern = F.lit(r"\[masked:[a-z-]+\]")
    return F.size(F.regexp_extract_all(after, pattern, F.lit(0))) - F.size(F.regexp_extract_all(before, pattern, F.lit(0)))


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def octets_fit(address: Column) -> Column:
    """Whether every part of a dotted address is at most 255."""
    return F.forall(F.split(address, r"\."), lambda p: p.cast("int") <= 255)


def found(text: Column, kind: str) -> Column:
    """All values of a class in a text, refined: cards pass the check digit, addresses are in range, phones have 7 to 15 digits."""
    values = F.regexp_extract_all(text, F.lit(PERSONAL[kind]), F.lit(0))
    if kind == "PaymentCard":
        return F.filter(values, lambda v: F.length(digits_of(v)).between(13, 19) & luhn(digits_of(v)))
    if kind == "IpAddress":
        return F.filter(values, octets_fit)
    if kind == "Phone":
        return F.filter(values, lambda v: F.length(digits_of(v)).between(7, 15))
    return values


def capitalised(text: Column) -> Column:
    """Words that begin with a capital and have a small letter; an apostrophe or hyphen before a letter goes on."""
    words = F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*"), F.lit(0))
    return F.filter(words, lambda w: w.rlike(r"\p{Ll}"))
