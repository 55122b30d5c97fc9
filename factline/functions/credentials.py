"""Credentials found and masked for good inside the JVM; values that only stand in for one are left.

``mask`` in ``masking`` covers what is masked in every document. The shapes here are the wider class that a reader may ask for on
top of it. A token is an opening that no other text has by chance and the whole run of its alphabet behind it, however long, so no tail
of a token is left. The other shapes are values behind something that says what they are.

Every repeat that has no bound is possessive or stands at the end of its pattern, so time grows with the text and no more.

Defined cases: a null text has none and stays null; a value that occurs twice is found twice and masked at both places; shapes that
overlap are settled in the order of ``shapes()``, the first keeping its stretch; a mask is no value, so masking again changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from factline.functions.spans import SPAN, Found, found_at, replaced_at, settled

# Fixed values from here to TOKENS: names of shapes, which masks show, openings, alphabets and least lengths of what follows, as
# issuers give them out. They decide what is masked and so can't be others.
_ALNUM, _WORD, _URL64, _UPPER, _HEX = "A-Za-z0-9", "A-Za-z0-9_", r"A-Za-z0-9_\-", "A-Z0-9", "a-f0-9"
#: Shape, openings, alphabet of the rest, its least length, whether no letter or digit of another alphabet may follow.
TOKENS: tuple[tuple[str, tuple[str, ...], str, int, bool], ...] = (
    ("aws-access-key", ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ANVA", "AIPA"), _UPPER, 16, True),
    ("google-api-key", ("AIza",), _URL64, 35, False),
    ("google-oauth-token", ("ya29.",), _URL64, 20, False),
    ("digitalocean-token", ("dop_v1_", "doo_v1_", "dor_v1_"), _HEX, 64, True),
    ("gitlab-token", ("glpat-", "gldt-", "glrt-", "glptt-", "glcbt-", "gloas-", "glsoat-", "glft-", "glimt-", "glagent-"), _URL64, 20, False),
    ("github-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), _ALNUM, 36, False),
    ("github-token", ("github_pat_",), _WORD, 40, False),
    ("bitbucket-token", ("ATBB",), _URL64 + "=", 32, False),
    ("npm-token", ("npm_",), _ALNUM, 36, True),
    ("pypi-token", ("pypi-AgEIcHlwaS5vcmc",), _URL64, 50, False),
    ("slack-token", ("xoxa-", "xoxb-", "xoxp-", "xoxo-", "xoxs-", "xoxr-"), r"A-Za-z0-9\-", 10, False),
    ("slack-token", tuple(f"xapp-{n}-" for n in range(10)), r"A-Za-z0-9\-", 20, False),
    ("slack-webhook", tuple(f"https://hooks.slack.com/{kind}/" for kind in ("services", "workflows", "triggers")), _URL64 + "/", 20, False),
    ("stripe-key", ("sk_live_", "sk_test_", "rk_live_", "rk_test_"), _ALNUM, 20, False),
    ("model-provider-key", ("sk-",), _URL64, 20, False),
    ("model-provider-key", ("hf_",), _ALNUM, 34, False),
    ("model-provider-key", ("gsk_",), _ALNUM, 40, False),
    ("model-provider-key", ("r8_",), _ALNUM, 37, False),
    ("model-provider-key", ("xai-",), _ALNUM, 40, False),
    ("model-provider-key", ("pplx-",), _ALNUM, 40, False),
    ("model-provider-key", ("tvly-",), _URL64, 16, False),
)
#: Names of what holds a secret.
SECRET_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "access_key", "private_key", "credential", "credentials", "authorization", "secret_key")
#: What a value that only stands in for one says.
STANDS_IN = ("xxxx", "****", "....", "redacted", "changeme", "change_me", "example", "placeholder", "your_", "your-", "dummy")
#: Names of digests, which are no secrets.
DIGESTS = ("sha1", "sha224", "sha256", "sha384", "sha512", "sha3", "md5", "blake2", "blake2b", "blake2s")

#: A secret is drawn at random; an end of so many characters with fewer different ones than this was typed.
DRAWN_END, DRAWN_KINDS = 12, 4
#: An assigned value is a secret if it has letters and digits, or this many characters.
LONG_VALUE = 20
#: Digits and letters of a digest at least.
DIGEST_CHARS = 16


class Shape(NamedTuple):
    """What a secret is called, its pattern, whose last characters are the secret (all, or the group), and which of the secrets count."""

    name: str | Callable[[Column], Column]
    pattern: str
    group: int
    counts: Callable[[Column], Column]


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike(r"\p{L}")


def stands_in(value: Column) -> Column:
    """Whether a value only stands in for a secret: it says so, is templated or masked, a setting's name, a digest, or a typed filler."""
    low = F.lower(value)
    says = F.exists(F.array(*map(F.lit, STANDS_IN)), lambda word: F.contains(low, word))
    templated = F.left(value, F.lit(1)).isin("[", "<", "{", "$") | value.rlike("^%(?![0-9A-Fa-f]{2})")
    setting = F.contains(value, F.lit("_")) & value.rlike("^[A-Z]") & (F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_", "") == "")
    named = F.split(low, "[:=-]", 2)
    digest = named[0].isin(*DIGESTS) & (F.length(F.try_element_at(named, F.lit(2))) >= DIGEST_CHARS)
    kinds = F.size(F.array_distinct(F.split(F.substring(value, -DRAWN_END, DRAWN_END), "")))
    return F.coalesce(says | templated | setting | digest | (kinds < DRAWN_KINDS), F.lit(False))


def _drawn(value: Column) -> Column:
    return ~stands_in(value)


def _mixed_and_drawn(value: Column) -> Column:
    return _mixed(value) & ~stands_in(value)


def _assigned(value: Column) -> Column:
    return (_mixed(value) | (F.length(value) >= LONG_VALUE)) & ~stands_in(value)


def _flagged(value: Column) -> Column:
    """A value behind a command-line flag: no variable, no word of prose, no name of a value in capitals."""
    word = F.regexp_replace(value, r"^[(\[{<]+|[.,;:!?)\]}>]+$", "")
    prose = word.rlike(r"^\p{L}\p{Ll}*$") | word.rlike("^[A-Z_-]+$")
    return ~prose & ~stands_in(value)


def name_pattern(names: tuple[str, ...] = SECRET_NAMES) -> str:
    """A name of a secret, at its end: what stands before it in one word is joined by ``_``, ``-`` or a percent escape.

    ``password`` may be glued to what stands before. Nothing before the name is read, so no run is read twice.
    """
    words = "|".join(n.replace("_", "[_-]?") for n in sorted(names, key=len, reverse=True))
    return rf"(?:(?<![A-Za-z0-9])|(?<=%[0-9A-Fa-f]{{2}}))(?:{words})(?![A-Za-z0-9])|pass(?:word|wd)(?![A-Za-z0-9])"


#: Between a name and its value: a closing quote or markup, then ``=``, ``=>``, ``:`` or an escape of one, then an opening quote.
JOINT = r"""(?:\\?["'`]|[*_~]{1,3})?[ \t]{0,8}(?:=>|=|:[*_~]{0,3}[ \t]|:(?=\\?["'])|%(?:25){0,3}3[AaDd])[ \t]{0,8}(?:\\?["'`])?"""
_VALUE = r"""([^\s"'`<>\\]{6,}+)"""
_KEY = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"


def _token_name(value: Column) -> Column:
    """The shape of a token, by its opening, the longest one first."""
    openings = sorted(((o, shape) for shape, some, _, _, _ in TOKENS for o in some), key=lambda x: -len(x[0]))
    name = F.when(value.startswith("eyJ"), "jwt").when(value.startswith("SG."), "sendgrid-key").when(value.rlike("^[0-9]"), "telegram-bot-token").when(F.contains(value, F.lit("/api/webhooks/")), "discord-webhook")
    for shape in dict.fromkeys(shape for _, shape in openings):
        some = "|".join(re.escape(o) for o, named in openings if named == shape)
        name = name.when(value.rlike(f"^(?:{some})"), shape)
    return name


def shapes() -> tuple[Shape, ...]:
    """All shapes in the order in which they claim text; all tokens are found in one pass."""

    def token(openings: tuple[str, ...], alphabet: str, least: int, alone: bool) -> str:
        end = r"(?![A-Za-z0-9_])" if alone else ""
        return rf"\b(?:{'|'.join(map(re.escape, openings))})[{alphabet}]{{{least},}}+{end}"

    u, name = f"[{_URL64}]", name_pattern()
    joined = (
        rf"https://(?:(?:ptb|canary)\.)?discord(?:app)?\.com/api/webhooks/[0-9]++/{u}{{20,}}+", rf"\b[0-9]{{8,10}}:AA{u}{{33,}}+",
        rf"\bSG\.{u}{{22,}}+\.{u}{{43,}}+", rf"\beyJ{u}{{8,}}+\.eyJ{u}{{8,}}+\.{u}{{8,}}+",
    )
    tokens = Shape(_token_name, "|".join([*[token(*t[1:]) for t in TOKENS], *joined]), 0, _drawn)
    behind = (
        Shape("azure-account-key", r"(?i)\baccountkey=([a-z0-9+/]{40,}+={0,2})", 1, _drawn),
        Shape("basic-auth", r"(?i)\bauthorization\s{0,8}[:=]\s{0,8}basic\s{1,8}([a-z0-9+/]{12,}+={0,2})", 1, _drawn),
        Shape("bearer", r"(?i)\bbearer\s{1,8}([a-z0-9._~+/\-]{16,}+=*+)", 1, _mixed_and_drawn),
        Shape("url-password", r"(?i)\b[a-z][a-z0-9+.\-]{0,30}://[^\s/?#@:]*+:([^\s/?#@\"<>`{}|\\^]++)(?=@)", 1, _drawn),
        Shape("secret-assignment", rf"(?i)(?<![\w-])--?[a-z0-9_-]{{0,40}}?(?:{name})(?:[ \t]{{1,8}}|=)[\"']([^\"'\r\n]{{6,}}+)(?=[\"'])", 1, _drawn),
        Shape("secret-assignment", rf"(?i)(?:{name}){JOINT}{_VALUE}", 1, _assigned),
        Shape("secret-assignment", rf"\b[A-Z0-9_]{{0,40}}_PASS\\?[\"']?(?:[ \t]{{0,8}}=[ \t]{{0,8}}|:[ \t]{{1,8}})\\?[\"']?{_VALUE}", 1, _assigned),
        Shape("secret-assignment", rf"(?i)<(?:[a-z0-9_.-]{{0,40}}:)?[a-z0-9_-]{{0,40}}?(?:{name})(?:\s[^<>]{{0,200}})?>\s*+([^\s<>][^<>]{{4,}}+)(?=</)", 1, _drawn),
        Shape("secret-assignment", rf"(?i)(?<![\w-])--?[a-z0-9_-]{{0,40}}?(?:{name})[ \t]{{1,8}}([^\s\"']{{6,}}+)", 1, _flagged),
    )
    whole = Shape("private-key", rf"-----BEGIN {_KEY}(?:(?!-----(?:END|BEGIN) )[\s\S])*+-----END {_KEY}", 0, lambda v: F.lit(True))
    return (whole, tokens, *behind)


def hint() -> str:
    """Matches somewhere in every text that has a secret; one pass spares most texts the others."""
    openings = [re.escape(o) for _, some, _, _, _ in TOKENS for o in some]
    names = [n.replace("_", "[_-]?") for n in SECRET_NAMES]
    return "(?i)" + "|".join([*openings, *names, "PRIVATE KEY", "/api/webhooks/", ":AA", r"\bSG\.", "eyJ", "accountkey=", "bearer", "://", "_PASS"])


def found_in(text: Column, without: tuple[str, ...] = ()) -> list[Found]:
    """Spans of each shape but those named, in the order in which they claim text."""
    return [found_at(text, s.pattern, s.group, s.name, s.counts) for s in shapes() if s.name not in without]


def credentials(text: Column, without: tuple[str, ...] = ()) -> Column:
    """All secrets of a text as an array of ``label``, ``start``, ``end`` and ``value``, in their order, none overlapping.

    A reader who asks for tokens alone names the shapes to leave out.
    """
    return F.when(text.rlike(hint()), settled(found_in(text, without))).otherwise(F.array().cast(SPAN))


def scrub(text: Column, without: tuple[str, ...] = ()) -> Column:
    """Every secret, but of the shapes left out, as ``[masked:<shape>]``; nothing else of the text changes."""
    return F.when(text.rlike(hint()), replaced_at(text, settled(found_in(text, without)), lambda c: F.concat(F.lit("[masked:"), c["label"], F.lit("]")))).otherwise(text)


def scrub_key(key: Column) -> Column:
    """A document key scrubbed as a text is, except that a value ends at ``&``, ``#`` and their escapes, so that what follows in a link stays."""
    parts = F.split(key, r"(?=[&#]|%(?:25){0,3}2[36])")
    return F.array_join(F.transform(parts, lambda part: scrub(part)), "")
