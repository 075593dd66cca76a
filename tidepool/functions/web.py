"""Addresses, file names, versions, timestamps and loose JSON, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HAS_SCHEME = r"^https?://"


def entry_url(kind: Column, item_id: Column, base: str, kinds: Sequence[str]) -> Column:
    """The public page of an item of a known kind; NULL for others."""
    return F.when(kind.isin(*kinds), F.concat_ws("/", F.lit(base), kind, item_id))


def asset_url(value: Column, base: str | None) -> Column:
    """An asset's address: absolute ones as they are, others below the base; NULL for none."""
    given = F.when(F.coalesce(value, F.lit("")) != "", value)
    return given if base is None else F.when(F.rlike(given, F.lit(HAS_SCHEME)), given).otherwise(F.concat(F.lit(f"{base}/"), given))


def absolute_url(value: Column, base: str | None) -> Column:
    """A reference resolved against a base without a path."""
    given = F.when(F.coalesce(value, F.lit("")) != "", value)
    if base is None:
        return given
    scheme = base.split("://")[0]
    return (
        F.when(F.rlike(given, F.lit(HAS_SCHEME)), given)
        .when(F.startswith(given, F.lit("//")), F.concat(F.lit(f"{scheme}:"), given))
        .otherwise(F.concat(F.lit(f"{base}/"), F.regexp_replace(given, "^/+", "")))
    )


def media_url_fault(url: Column, host: str, ports: Sequence[int] = (80, 443)) -> Column:
    """Why an address isn't fetched for a viewer; NULL for one of the host or below it."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    name, port = F.lower(F.regexp_replace(place, r":[^:]*$", "")), F.regexp_extract(place, r":([^:]*)$", 1)
    number = port.try_cast("int")
    return (
        F.when((port != "") & (number.isNull() | ~number.between(0, 65535)), "invalid asset url")
        .when(~scheme.isin("http", "https"), "unsupported asset url")
        .when((name != host) & ~F.endswith(name, F.lit(f".{host}")), "unsupported asset host")
        .when(F.contains(authority, F.lit("@")) | ~F.coalesce(number.isin(*ports), F.lit(True)), "unsupported asset authority")
    )


def media_suffix(url: Column) -> Column:
    """Suffix of an address's last path part, with its dot; empty for none."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def with_suffix_of(path: Column, url: Column) -> Column:
    """A file's path under the suffix of a new address; as it is where that has none."""
    suffix = media_suffix(url)
    return F.when(suffix == "", path).otherwise(F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), suffix))


def media_id(url: Column, pattern: str) -> Column:
    """The first group of a pattern in an address; NULL where it doesn't match."""
    return F.when(F.rlike(url, F.lit(pattern)), F.regexp_extract(url, pattern, 1))


def version(text: Column) -> Column:
    """Numbers between dots, other parts 0; versions compare as arrays."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda x: F.coalesce(F.trim(x).try_cast("int"), F.lit(0)))


def timestamp(text: Column) -> Column:
    """An ISO 8601 time; without an offset it is UTC; NULL for anything else."""
    clean = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
    zoned = F.when(F.regexp_extract(clean, shape, 1) != "", clean).when(F.length(clean) == 10, F.concat(clean, F.lit("T00:00:00Z"))).otherwise(F.concat(clean, F.lit("Z")))
    return F.when(F.rlike(clean, F.lit(shape)), F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def json_object(text: Column) -> Column:
    """The JSON object that a text is, or that stands between its first and last brace; NULL for none."""

    def strict(part: Column) -> Column:
        # The parser stops behind the first value; within an array and within an object nothing may follow it.
        alone = F.try_parse_json(F.concat(F.lit("["), part, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), part, F.lit("}"))).isNotNull()
        found = F.try_parse_json(part)
        return F.when(alone & F.startswith(F.schema_of_variant(found), F.lit("OBJECT")), F.to_json(found))

    return F.coalesce(strict(F.trim(text)), strict(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def escaped(text: Column) -> Column:
    """HTML-escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlight(text: Column, terms: Sequence[str]) -> Column:
    """Escaped text with the terms marked, longest first."""
    out = escaped(F.coalesce(text, F.lit("")))
    for t in sorted(dict.fromkeys(filter(None, terms)), key=lambda t: -len(t)):
        out = F.replace(out, escaped(F.lit(t)), F.concat(F.lit("<mark>"), escaped(F.lit(t)), F.lit("</mark>")))
    return out


# Fragments of a query that are no clue where they stand.
OVERLAP_STOPS = ("什么", "以前", "一个", "一种", "一套", "这个", "那个", "就是", "好像", "感觉", "来回", "系统", "节目", "哪期", "那期", "记得", "忘了")


def overlap_terms(query: str, text: Column, most: int = 6, sizes: Sequence[int] = (6, 5, 4, 3, 2)) -> Column:
    """Fragments of the query that the text holds, long ones first, none within another."""
    clean = "".join(query.split())
    fragments = [f for n in sizes for i in range(len(clean) - n + 1) if (f := clean[i : i + n]) not in OVERLAP_STOPS]
    empty = F.array().cast("array<string>")
    if not fragments:
        return empty
    held = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    hit = F.filter(F.array(*map(F.lit, dict.fromkeys(fragments))), lambda f: F.contains(held, f))
    taken = lambda acc, f: (F.size(acc) >= most) | F.exists(acc, lambda x: F.contains(x, f) | F.contains(f, x))
    return F.aggregate(hit, empty, lambda acc, f: F.when(taken(acc, f), acc).otherwise(F.concat(acc, F.array(f))))
