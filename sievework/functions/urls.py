"""URL rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework import rules
from sievework.functions.text import contains_any

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, _PARTS, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def _decode(c: Column) -> Column:
    # a bare percent sign stands for itself
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_query_string(query: Column) -> Column:
    """Drop blank and tracking parameters, order by name, encode again."""
    pieces = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(
        pieces,
        lambda p, i: F.struct(
            _decode(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"),
            i.alias("i"),
            _decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*rules.TRACKING_PARAMETERS)))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"
    )


def normalize_url(url: Column) -> Column:
    """U01."""
    scheme = F.lower(part(url, 1))
    authority = host(url)
    authority = (
        F.when(scheme == "http", F.regexp_replace(authority, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(authority, ":443$", ""))
        .otherwise(authority)
    )
    whole_path = part(url, 3)
    params = F.regexp_extract(whole_path, r"(?s)^(?:.*/)?[^/;]*(;[^/]+)$", 1)
    path = F.lower(F.regexp_extract(whole_path, r"(?s)^((?:.*/)?[^/;]*)(?:;[^/]*)?$", 1))
    path = F.regexp_replace(path, r"(?s)(?<=.)/$", "")
    raw_query = part(url, 4)
    query = F.when(raw_query == "", F.lit("")).otherwise(normalize_query_string(raw_query))
    rooted = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when(
        (authority != "") | scheme.isin("http", "https", "ftp"),
        F.concat(F.lit("//"), authority, rooted),
    ).otherwise(path)
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(
        F.concat(
            F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
            body,
            params,
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        )
    )


def fingerprint(url: Column) -> Column:
    """U02."""
    return F.md5(normalize_url(url))


def site_type(url: Column) -> Column:
    """First matching family wins."""
    low = F.lower(url)
    out = None
    for kind, needles in rules.SITE_TYPES:
        test = contains_any(low, needles)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("generic")


def is_skipped(url: Column, which: str = "discover") -> Column:
    """U05."""
    return contains_any(F.lower(url), rules.SKIP_SETS[which])


def resolve_link(page_url: Column, href: Column) -> Column:
    """Absolute form of a link; relative ones hang off the host root."""
    root = F.concat(part(page_url, 1), F.lit("://"), part(page_url, 2))
    return (
        F.when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("http://") | href.startswith("https://"), href)
        .otherwise(F.concat(root, F.lit("/"), href))
    )
