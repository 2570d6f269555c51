"""Scalar text functions: canonical forms, hashes, redaction, tokens, references and times."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Zero-width characters that canonical text drops.
ZERO_WIDTH = ["​", "‌", "‍", "﻿"]
UNIT, RECORD = "\x1f", "\x1e"
_ZERO = re.compile("[" + "".join(ZERO_WIDTH) + "]")


def _canonical(t: str) -> str:
    return " ".join(_ZERO.sub("", unicodedata.normalize("NFKC", t)).split())


@F.pandas_udf(StringType())
def normalize_for_hash(t: pd.Series) -> pd.Series:
    """Compatibility form, no zero-width characters, single spaces, case folded; null is empty."""
    return t.map(lambda x: "" if x is None else _canonical(x).casefold())


@F.pandas_udf(StringType())
def normalize_text(t: pd.Series) -> pd.Series:
    """The same with its case; nothing left is null."""
    return t.map(lambda x: (_canonical(x) or None) if x is not None else None)


@F.pandas_udf(StringType())
def unescape_html(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if x is None else html.unescape(x))


def content_hash(*parts: Column, namespace: str | None = None) -> Column:
    """SHA-256 of the canonical parts, kept apart by a separator, in an optional namespace."""
    body = F.concat_ws(UNIT, *[normalize_for_hash(p) for p in parts])
    return F.sha2(F.concat(F.lit(f"{namespace}{RECORD}"), body) if namespace else body, 256)


def content_digest(*parts: str | None, namespace: str) -> str:
    """``content_hash`` of plain strings, for functions that have them at hand."""
    body = UNIT.join("" if p is None else _canonical(p).casefold() for p in parts)
    return hashlib.sha256(f"{namespace}{RECORD}{body}".encode()).hexdigest()


def ascii_key(text: Column) -> Column:
    """Key of a text by its bytes: white space collapsed, lower case, hashed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), 256)


def url_key(url: Column) -> Column:
    """host and path in lower case without a trailing slash; null if there is no host."""
    u = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^?#]*)", 0)
    bare = F.regexp_replace(F.lower(u), r"^[a-z][a-z0-9+.-]*://|/+$", "")
    return F.when(u != "", bare)


def truncated(text: Column, n: int) -> tuple[Column, Column]:
    return F.substring(text, 1, n), F.length(text) > n


def strip_tags(text: Column) -> Column:
    """Tags become spaces; white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))


def strip_html(text: Column) -> Column:
    """Tags become spaces, then references are decoded, then white space collapses."""
    return F.trim(F.regexp_replace(unescape_html(F.regexp_replace(text, r"<[^>]*>", " ")), r"(?U)\s+", " "))


# What a secret looks like, in the order in which it is redacted.
SECRETS = [
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=\-]+", "$1 ***"),
    (r"(?i)\b(authorization)\b[\"']?\s*[:=]\s*[^\s,;]+", "$1=***"),
    (r"\bsk-[A-Za-z0-9_\-]{4,}", "sk-***"),
    (r"(?i)\b(api[_-]?key)\b[\"']?\s*[:=]\s*[^\s,;]+", "$1=***"),
    (r"(?i)\b(access[_-]?token|refresh[_-]?token|secret|token)\b[\"']?\s*[:=]\s*[^\s,;]+", "$1=***"),
]
SENSITIVE = ["apikey", "auth", "authorization", "bearer", "cookie", "credential", "credentials", "key", "keys", "passwd", "password", "pwd", "secret",
             "secrets", "session", "sessions", "signature", "token", "tokens"]


def redact(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def safe_text(text: Column, n: int = 300) -> Column:
    return F.substring(redact(text), 1, n)


def safe_url(url: Column, n: int = 300) -> Column:
    """scheme://host/path, without user, query and fragment."""
    return F.substring(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1"), 1, n)


def is_sensitive_key(key: Column) -> Column:
    return F.exists(F.split(F.lower(key), "[^a-z0-9]+"), lambda x: x.isin(SENSITIVE))


def sanitize_map(m: Column, entries: int = 50) -> Column:
    """Without sensitive keys, with redacted values, at most ``entries`` of them by key."""
    kept = F.map_filter(m, lambda k, _: ~is_sensitive_key(k))
    few = F.slice(F.array_sort(F.map_entries(kept)), 1, entries)
    return F.transform_values(F.map_from_entries(few), lambda _, v: safe_text(v))


def sanitize_json(text: Column, entries: int = 32, items: int = 8, most: int = 300) -> Column:
    """A JSON object as one of scalars and short lists: what may be written into an audit.

    Keys that are blank, longer than 100 characters or name credentials go, as do values that are objects; of a list
    the scalars among its first ``items`` stay. Texts are redacted and cut, those under a key with url, uri or link reduced to
    scheme, host and path; other scalars keep their kind. At most ``entries`` keys stay, in their order. Null unless it is an object.
    """
    kind = F.schema_of_variant
    shown = lambda v: F.substring(redact(v.cast("string")), 1, most)
    as_json = lambda v: F.parse_json(F.to_json(v.cast("variant")))

    def scalar(v: Column) -> Column:
        return F.when(kind(v) == "STRING", as_json(shown(v))).otherwise(v)

    def value(k: Column, v: Column) -> Column:
        lists = F.filter(F.slice(v.cast("array<variant>"), 1, items), lambda x: ~F.coalesce(kind(x).rlike("^(OBJECT|ARRAY|VOID)"), F.lit(True)))
        link = (kind(v) == "STRING") & F.lower(k).rlike("url|uri|link")
        return (F.when(F.startswith(kind(v), F.lit("ARRAY")), as_json(F.transform(lists, scalar)))
                .when(link, as_json(F.substring(F.coalesce(safe_url(v.cast("string")), shown(v)), 1, most))).otherwise(scalar(v)))

    m = F.from_json(text, "map<string,variant>")
    fine = F.filter(F.map_entries(m), lambda e: (F.trim(e.key) != "") & (F.length(F.trim(e.key)) <= 100) & ~is_sensitive_key(e.key) & ~F.startswith(kind(e.value), F.lit("OBJECT")))
    few = F.transform(F.slice(fine, 1, entries), lambda e: F.struct(F.trim(e.key).alias("key"), value(e.key, e.value).alias("value")))
    return F.when(m.isNotNull(), F.to_json(F.map_from_entries(few)))


CJK = r"[㐀-䶿一-鿿豈-﫿]+"


def tokens(text: Column, n: int = 2) -> Column:
    """Character n-grams of CJK runs (short runs whole) and ASCII words of normalised text."""
    runs = F.regexp_extract_all(text, F.lit(CJK), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < n, F.array(r)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(n))))))
    return F.concat(grams, F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)))


def normalize_number(text: Column) -> Column:
    """First number of a text without grouping and trailing zeros; else the text in lower case."""
    clean = F.replace(F.translate(text, "，－—", ",--"), F.lit(","), F.lit(""))
    found = F.regexp_extract(clean, r"-?\d+(?:\.\d+)?", 0)
    bare = F.when(found.contains("."), F.regexp_replace(F.regexp_replace(found, "0+$", ""), r"\.$", "")).otherwise(found)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").when(found != "", bare).otherwise(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


# Spellings of categories.
SYNONYMS = {
    "stance": {"long": "LONG", "多": "LONG", "看多": "LONG", "做多": "LONG", "short": "SHORT", "空": "SHORT", "看空": "SHORT", "做空": "SHORT",
               "flat": "FLAT", "neutral": "FLAT", "观望": "FLAT", "震荡": "FLAT", "unknown": "UNKNOWN", "未知": "UNKNOWN"},
    "horizon": {"15m": "15M", "15min": "15M", "30m": "30M", "30min": "30M", "1h": "1H", "60m": "1H", "4h": "4H", "240m": "4H", "1d": "1D", "daily": "1D"},
}


def normalize_category(field: str, text: Column) -> Column:
    flat = F.lower(F.regexp_replace(text, r"[\s_\-/]+", ""))
    known = F.create_map(*[F.lit(x) for kv in SYNONYMS[field].items() for x in kv])
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(F.coalesce(F.element_at(known, flat), F.upper(flat)))


def length_bucket(n: Column) -> Column:
    return F.when(n < 80, "short").when(n < 240, "medium").otherwise("long")


def valid_reference(ref: Column) -> Column:
    """An https URL without user and port 0, or a relative path below docs/legal/."""
    host = F.regexp_extract(ref, r"^https://([^/?#]+)", 1)
    url = (host != "") & ~host.contains("@") & ~host.rlike(r":0*$")
    path = ref.startswith("docs/legal/") & ~ref.contains("..") & ~ref.contains("\\")
    return F.coalesce(url | path, F.lit(False))


def effective_time(published: Column, collected: Column, floor: Column | None = None) -> Column:
    return F.greatest(published, collected, *([floor] if floor is not None else []))


def strict_time(text: Column) -> Column:
    """ISO 8601 with an offset, else null."""
    fine = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(fine, F.try_to_timestamp(F.regexp_replace(text, " ", "T")))


def feed_time(text: Column) -> tuple[Column, Column]:
    """(time, ambiguous) of an RFC 822 or ISO time; one without a zone is ambiguous and has no time."""
    iso = strict_time(text)
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    zone = text.rlike(r"(Z|GMT|UTC|[+-]\d{2}:?\d{2})$")
    return F.coalesce(iso, mail), F.coalesce(~zone, F.lit(False))


def slot_floor(t: Column, minutes: int = 30) -> Column:
    s = F.unix_seconds(t.cast("timestamp"))
    return F.timestamp_seconds(s - F.pmod(s, F.lit(60 * minutes)))


def in_future(t: Column, now: Column, tolerance_seconds: int) -> Column:
    return F.unix_seconds(t.cast("timestamp")) > F.unix_seconds(now.cast("timestamp")) + tolerance_seconds
