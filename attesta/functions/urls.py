"""URLs, paths and cache keys as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.text import strip


def looks_like_path(value: Column) -> Column:
    """A URL of any scheme, or a file path: absolute, relative with a slash, or from the home folder."""
    v = strip(value)
    return F.contains(v, F.lit("/")) | F.startswith(v, F.lit("~"))


def normalized(url: Column) -> Column:
    """Scheme and network location in lower case; the rest as it is. URLs of another shape stay unchanged."""
    shape = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([\s\S]*)$"
    part = lambda i: F.regexp_extract(url, shape, i)
    return F.concat(F.lower(part(1)), F.lower(part(2)), part(3))


def authority(url: Column) -> Column:
    """The network location, with user and port; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """The path, ``/`` where it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def cache_key(url: Column, etag: Column) -> Column:
    return F.concat(F.substring(F.sha2(F.concat(normalized(url), F.lit("|"), F.coalesce(etag, F.lit(""))), 256), 1, 40), F.lit(".json"))


def url_from_line(line: Column) -> Column:
    """The URL of a line in a source list: a link's target, else a URL, else a single bare word; null if none."""
    empty = lambda c: F.when(c != "", c)
    bare = F.regexp_replace(strip(line), r"\.+$", "")
    word = F.when((bare != "") & ~F.contains(bare, F.lit(" ")) & ~F.startswith(bare, F.lit("#")), bare)
    return F.coalesce(empty(F.regexp_extract(line, r"\[[^\]]*\]\(\s*([^()\s]+)\s*\)", 1)), empty(F.regexp_extract(line, f"({K.URL_TOKEN})", 1)), word)


def retry_after(value: Column) -> Column:
    """Seconds to wait: a non-negative number, 30 at most; else null."""
    n = strip(value).try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n), F.least(n, F.lit(K.RETRY_AFTER_CAP)))


def anchored(url: Column, base: Column) -> Column:
    """A bare relative path under the folder ``base``, with ``.`` and ``..`` folded; other URLs unchanged."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), url), "/+"), lambda p: ~p.isin("", "."))
    up = F.lit("..")
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    whole = F.concat(F.when(F.startswith(base, F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))
    return F.when(F.contains(url, F.lit("://")) | F.startswith(url, F.lit("/")) | F.startswith(url, F.lit("~")), url).otherwise(whole)
