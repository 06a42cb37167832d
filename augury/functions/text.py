"""Names and keys of requests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(c: Column) -> Column:
    """Trimmed and without quotes, but for topic ids, which start with a slash."""
    bare = F.trim(c)
    return F.when(bare.startswith("/"), bare).otherwise(F.trim(F.regexp_replace(bare, "[\"'׳״]", "")))


def slugify(c: Column) -> Column:
    """Lower case; runs of other characters than letters and digits of any script, underscores and hyphens become one hyphen, as do
    runs of hyphens; none at the ends; ``q`` where nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\-]+", "-")
    bare = F.regexp_replace(F.regexp_replace(bare, "-{2,}", "-"), "^-+|-+$", "")
    return F.when(bare == "", "q").otherwise(bare)


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def request_key(keywords: Column, geo: Column, timeframe: Column, cat: Column | int = 0, gprop: Column | str = "") -> Column:
    """Ten hex digits that name a request of at most five keywords; more raise an error.

    They begin the SHA-1 of the request as JSON with sorted names, a blank after each colon and comma, and no escapes of letters."""
    ok = F.assert_true(F.size(keywords) <= 5, F.lit("a request holds at most five keywords"))
    text = F.concat(
        F.lit('{"cat": '), F.lit(cat).cast("string"), F.lit(', "geo": '), quoted(F.upper(F.trim(geo))), F.lit(', "gprop": '), quoted(F.lit(gprop)),
        F.lit(', "keywords": ['), F.array_join(F.transform(keywords, quoted), ", "), F.lit('], "timeframe": '), quoted(F.trim(timeframe)), F.lit("}"))
    return F.when(ok.isNull(), F.substring(F.sha1(text), 1, 10))


def request_slug(keywords: Column, geo: Column, timeframe: Column, cat: Column | int = 0, gprop: Column | str = "") -> Column:
    """Folder name of a request: place, first keyword, count, timeframe, what is not standard, key."""
    place = F.when(F.trim(geo) == "", "WW").otherwise(F.upper(F.trim(geo)))
    more = F.when(F.size(keywords) > 1, F.concat(F.lit("_x"), F.size(keywords))).otherwise("")
    extra = F.concat(F.when(F.lit(cat) != 0, F.concat(F.lit("_cat"), F.lit(cat).cast("string"))).otherwise(""), F.when(F.lit(gprop) != "", F.concat(F.lit("_"), F.lit(gprop))).otherwise(""))
    return F.concat(place, F.lit("__"), F.substring(slugify(keywords[0]), 1, 40), more, F.lit("__"), F.substring(slugify(timeframe), 1, 24), extra, F.lit("__"), request_key(keywords, geo, timeframe, cat, gprop))


def cache_key(*parts: Column) -> Column:
    """Ten hex digits that name a cached answer: the SHA-1 of its parts, joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def timeframe_for(freq: str, today: str, start: str | None = None, end: str | None = None) -> str:
    """The explicit window where both its ends are given, or the longest one with a value a month, week or day."""
    if start and end:
        return f"{start} {end}"
    # The service's first month, and its names of relative windows.
    return {"M": f"2004-01-01 {today}", "W": "today 5-y", "D": "today 3-m"}[freq.upper()[0]]
