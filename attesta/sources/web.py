"""Pages from the network and from local files, in the order of the fetch rules: shape, local policy, cache, local read,
robots, request."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from urllib import robotparser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import constants as K
from attesta.functions.urls import normalized, origin
from attesta.sources.pages import PAGE, allowed_local, fetchable, fresh, local_shaped

#: url -> (status, headers in lower case, body); raises OSError where nothing came back.
Opener = Callable[[str], tuple[int, dict[str, str], bytes]]
PAGES = pa.schema([("url", pa.string()), ("ok", pa.bool_()), ("status_code", pa.int32()), ("html", pa.string()), ("etag", pa.string()), ("error", pa.string())])
AGENT = "attesta"


def open_url(url: str, seconds: float = K.REQUEST_SECONDS) -> tuple[int, dict[str, str], bytes]:
    """One request with the standard library; redirects are followed."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as r:  # noqa: S310  the scheme is checked before
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def wait_of(header: str | None, attempt: int) -> float:
    """Seconds before the next attempt: what the server asks for, at most the cap, else the back-off of the attempt."""
    try:
        asked = float((header or "").strip())
    except ValueError:
        asked = -1.0
    return min(asked, K.RETRY_AFTER_CAP) if asked >= 0 else K.BACKOFF_SECONDS[attempt]


def get_page(url: str, opener: Opener = open_url, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A raw page after at most ``len(BACKOFF_SECONDS)`` retries, of transport errors and of statuses 429 and 503."""
    error = None
    for attempt in range(len(K.BACKOFF_SECONDS) + 1):
        last = attempt == len(K.BACKOFF_SECONDS)
        try:
            status, headers, body = opener(url)
        except OSError as e:
            error = f"{type(e).__name__}: {e}"
            if not last:
                sleep(K.BACKOFF_SECONDS[attempt])
            continue
        if status in K.RETRIED_STATUSES and not last:
            sleep(wait_of(headers.get("retry-after"), attempt))
            continue
        return {"url": url, "ok": status < 400, "status_code": status, "html": body.decode("utf-8", "replace"), "etag": headers.get("etag"), "error": None if status < 400 else f"HTTP {status}"}
    return {"url": url, "ok": False, "error": error}


def robots_text(site: str, opener: Opener = open_url) -> str | None:
    """The robots file of an origin; null where there is none or it can't be read, which allows everything."""
    try:
        status, _, body = opener(f"{site}/robots.txt")
    except OSError:
        return None
    return body.decode("utf-8", "replace") if status < 400 else None


def may_fetch(rules: str | None, url: str, agent: str = AGENT) -> bool:
    parser = robotparser.RobotFileParser()
    parser.parse((rules or "").splitlines())
    return parser.can_fetch(agent, url)


def invalid_address(url: Column) -> Column:
    """An error for network addresses that no client takes: a bad port or IPv6 literal; null for the rest."""
    place = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@", "")
    good = place.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^\[\]:]*)(:\d{0,5})?$")
    return F.when(~good, F.lit("invalid URL"))


def _mapped(urls: DataFrame, one: Callable[[dict], dict], per_task: int) -> DataFrame:
    """``one`` over rows, ``per_task`` at a time in a task. A raised error is a failed page, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def safe(row: dict) -> dict:
            try:
                return one(row)
            except Exception as e:  # noqa: BLE001
                return {"url": row["url"], "ok": False, "error": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(per_task) as pool:
            for batch in batches:
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in PAGES} for r in pool.map(safe, batch.to_pylist())], schema=PAGES)

    return urls.mapInArrow(run, PAGE)


def read_file(url: str) -> dict:
    path = Path(url.removeprefix("file://").removeprefix("file:"))
    if not path.is_file():
        return {"url": url, "ok": False, "error": "no such file"}
    return {"url": url, "ok": True, "status_code": 200, "html": path.read_bytes().decode("utf-8", "replace")}


def dispatched(urls: DataFrame, *, opener: Opener = open_url, cache: DataFrame | None = None, now: Column | None = None, roots: tuple[str, ...] = (), any_local: bool = False, per_task: int = K.IN_FLIGHT, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A raw page (columns of ``pages.PAGE``) for each distinct URL of ``urls``; null URLs get none.

    In this order: a URL of wrong shape or scheme fails; a local path that the policy refuses fails as if it weren't
    there, before any cache is asked; a page of ``cache`` (see ``pages.fresh``) that is young enough at ``now`` is taken;
    a local path is read (on executors, so from a folder that all see); a path that its site's robots file refuses is
    "blocked by robots.txt"; the rest is requested. A robots file is fetched once for each origin. ``pages.write_cache``
    keeps the ok ones.
    """
    u = urls.select("url").where("url is not null").distinct()
    error = F.coalesce(fetchable(F.col("url")), invalid_address(F.col("url")))
    u = u.withColumn("error", error).withColumn("local", local_shaped(F.col("url")))
    failed = lambda d: d.select("url", F.lit(False).alias("ok"), F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("etag"), "error")
    bad, good = failed(u.where("error is not null")), u.where("error is null").select("url", "local")

    def refused(row: dict) -> dict:
        return {"url": row["url"], "ok": allowed_local(row["url"], list(roots), any_local)}

    local = _mapped(good.where("local").select("url"), refused, 1)
    denied = failed(local.where("not ok").withColumn("error", F.lit("no such file")))
    asked = local.where("ok").select("url", F.lit(True).alias("local")).unionByName(good.where("not local"))
    found = None
    if cache is not None:
        kept = fresh(cache, F.current_timestamp() if now is None else now).select("norm_url", F.struct(*[c if c in cache.columns else F.lit(None).alias(c) for c in ("status_code", "html", "etag")]).alias("c"))
        asked = asked.withColumn("norm_url", normalized(F.col("url"))).join(kept, "norm_url", "left")
        hit = asked.where("c is not null")
        found = hit.select("url", F.lit(True).alias("ok"), F.col("c.status_code").cast("int").alias("status_code"), F.col("c.html").cast("string").alias("html"), F.col("c.etag").cast("string").alias("etag"), F.lit(None).cast("string").alias("error"))
        asked = asked.where("c is null").select("url", "local")
    read = _mapped(asked.where("local").select("url"), lambda row: read_file(row["url"]), 1)
    online = asked.where("not local").select("url", origin(F.col("url")).alias("site"))
    robots = _mapped(online.select(F.col("site").alias("url")).distinct(), lambda row: {"url": row["url"], "html": robots_text(row["url"], opener)}, per_task)
    ruled = online.join(robots.select(F.col("url").alias("site"), F.col("html").alias("rules")), "site", "left").select("url", "rules")

    def requested(row: dict) -> dict:
        if not may_fetch(row["rules"], row["url"]):
            return {"url": row["url"], "ok": False, "error": "blocked by robots.txt"}
        return get_page(row["url"], opener, sleep)

    out = bad.unionByName(denied).unionByName(read).unionByName(_mapped(ruled, requested, per_task))
    return out if found is None else out.unionByName(found)


