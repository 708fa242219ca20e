"""WARC revisits: a "304 Not Modified" capture gets its body from the latest earlier full response.

Captures (full responses and revisits) are matched by canonical URL. The as-of join has two
levels, buckets of capture time, then captures within a bucket, so a URL with any number of
captures is spread over tasks: each (url, bucket) hands its last full response on, a running
"last" over the buckets gives what holds at a bucket's start, and a running "last" within the
bucket does the rest. DataFrame functions throughout; bodies only travel in ``resolved_bodies``.

A revisit's validators must agree with the response's: its ETag if it has one (weak comparison,
RFC 9110 section 8.8.3.2), else its Last-Modified. The stored headers are then updated with the
revisit's (RFC 9111 section 3.2), but for those that describe the message that carried them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

#: Seconds of capture time in a bucket of the as-of join.
BUCKET_S = 86_400

# Headers a 304 may not change, and query parameters that don't name a page.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"


# Default ports, and the escapes of characters that need none (RFC 3986, section 2.3).
PORTS = {"http": "80", "https": "443", "ftp": "21"}
UNRESERVED = {f"{ord(c):02X}": c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"}


def _plain_escapes(text: Column) -> Column:
    """Escapes in capitals, those of unreserved characters undone; a stray percent sign stays."""
    known = F.create_map(*[F.lit(x) for pair in UNRESERVED.items() for x in pair])

    def one(part: Column, i: Column) -> Column:
        code, rest = F.upper(F.substring(part, 1, 2)), F.substring(part, 3, 1 << 30)
        escaped = F.when(code.rlike("^[0-9A-F]{2}$"), F.concat(F.coalesce(known[code], F.concat(F.lit("%"), code)), rest))
        return F.when(i == 0, part).otherwise(F.coalesce(escaped, F.concat(F.lit("%"), part)))

    return F.array_join(F.transform(F.split(text, "%"), one), "")


def _without_dots(path: Column) -> Column:
    """A path without its segments ``.`` and ``..`` (RFC 3986, section 5.2.4)."""
    empty = F.array().cast("array<string>")
    step = lambda done, s: F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s)))
    joined = F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")
    return F.when(path.rlike("(^|/)[.]{1,2}$") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def standard_url(url: Column) -> Column:
    """A URL normalised as RFC 3986 says (sections 6.2.2 and 6.2.3), without its fragment.

    Scheme and host in small letters, escapes of unreserved characters undone and others in capitals,
    dot segments resolved, the scheme's default port and an empty path made alike. Only what names
    the same resource by the standard shares a key. Null stays null; text that is no URL is trimmed.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    form = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$"
    part = lambda k: F.regexp_extract(whole, form, k)
    scheme, place = F.lower(part(1)), _plain_escapes(part(2))
    user, host = F.regexp_extract(place, "^(.*@)?(.*)$", 1), F.lower(F.regexp_extract(place, "^(.*@)?(.*)$", 2))
    port = F.coalesce(F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])[scheme], F.lit(""))
    host = F.when((port != "") & host.endswith(F.concat(F.lit(":"), port)), F.substring(host, F.lit(1), F.length(host) - F.length(port) - 1)).otherwise(F.regexp_replace(host, ":$", ""))
    path = _without_dots(_plain_escapes(part(3)))
    path = F.when(path == "", "/").otherwise(path)
    return F.when(whole.rlike(form), F.concat(scheme, F.lit("://"), user, host, path, _plain_escapes(part(4)))).otherwise(whole)


def crawl_url(url: Column, hosts: str = "www|m", parameters: str = TRACKING) -> Column:
    """A looser key, as crawls use it: pages that only differ in scheme, leading ``hosts``, default port,
    fragment, tracking ``parameters`` or a last slash share it. A null URL stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), f"^({hosts})[.]|:(80|443)$", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    asked = F.regexp_replace(F.regexp_extract(rest, "[?](.*)$", 1), f"(^|&)({parameters})=[^&]*", "")
    asked = F.regexp_replace(asked, "^&", "")
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))


def _header(headers: Column, name: str) -> Column:
    """Value of a header, whatever the case of its name; null if absent or empty."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.nullif(F.trim(F.get(entries, F.lit(0))["value"]), F.lit(""))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers updated by a revisit's, names in lower case; of equal names
    in one message the first holds, and a header without a value changes nothing."""
    lower = lambda m: F.aggregate(
        F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda done, e: F.when(F.exists(done, lambda d: d["key"] == e["key"]), done).otherwise(F.concat(done, F.array(e))),
    )
    allowed = F.filter(lower(fresh), lambda e: ~e["key"].isin(*KEPT_HEADERS) & (F.coalesce(e["value"], F.lit("")) != ""))
    stays = F.filter(lower(stored), lambda e: ~F.exists(allowed, lambda a: a["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(stays, allowed)))


def resolved(records: DataFrame, bucket_s: int = BUCKET_S, canonical: Callable[[Column], Column] = standard_url) -> DataFrame:
    """Every revisit (status 304) of ``records`` with the full response (status 200) it stands for.

    ``records``: record_id, url, captured (timestamp), status (int), headers (map). URLs match by
    ``canonical``: by the standard unless a looser rule, such as ``crawl_url``, is given. Returns
    record_id, canonical, captured, base_id, verdict and headers, a row per revisit row. Earlier
    means an earlier capture time; of responses at one time the largest record_id counts as the
    latest. Verdicts: ``resolved``; ``no_response`` (none earlier, or no URL or time);
    ``no_validator`` (the revisit has neither); ``mismatch`` (its validator isn't the response's).
    Only resolved rows have a base_id and merged headers. Rows that repeat a record are revisits of
    their own; statuses other than 200 and 304, null included, play no role; an empty table gives
    no rows; other columns are ignored.
    """
    rows = records.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical(F.col("url")).alias("canonical"), F.col("captured"), (F.col("status") == 200).alias("full"), "headers"
    )
    rows = written(rows.withColumn("bucket", F.floor(F.unix_seconds("captured") / bucket_s)), "captures")
    known = F.col("canonical").isNotNull() & F.col("captured").isNotNull()
    at = F.struct("captured", "record_id")
    last = rows.where(F.col("full") & known).groupBy("canonical", "bucket").agg(F.max(at).alias("last"))
    every = rows.where(known).select("canonical", "bucket").distinct().join(last, ["canonical", "bucket"], "left")
    before = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(F.col("canonical").alias("c"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(before).alias("carried"))
    # captures of one time don't precede each other, so each time counts once
    seen = rows.where(known).groupBy("canonical", "bucket", "captured").agg(F.max(F.when(F.col("full"), at)).alias("here"))
    strictly = Window.partitionBy("canonical", "bucket").orderBy("captured").rowsBetween(Window.unboundedPreceding, -1)
    steps = seen.withColumn("inside", F.last("here", ignorenulls=True).over(strictly))
    steps = steps.join(carried, (F.col("canonical") == F.col("c")) & (F.col("bucket") == F.col("b"))).select(
        F.col("canonical").alias("s_url"), F.col("captured").alias("s_time"), F.coalesce("inside", "carried").alias("base")
    )
    steps = written(steps.where("base is not null"), "as-of")
    revisits = rows.where(~F.col("full")).join(steps, (F.col("canonical") == F.col("s_url")) & (F.col("captured") == F.col("s_time")), "left")
    revisits = revisits.select("record_id", "canonical", "captured", "headers", F.col("base.record_id").alias("base_id"), F.col("base.captured").alias("base_time"))
    responses = rows.where("full").groupBy("canonical", "captured", "record_id").agg(F.max(F.map_entries("headers")).alias("entries"))
    responses = written(responses.select(F.col("canonical").alias("r_url"), F.col("captured").alias("r_time"), F.col("record_id").alias("r_id"), F.map_from_entries("entries").alias("r_headers")), "responses")
    joined = revisits.join(responses, (F.col("canonical") == F.col("r_url")) & (F.col("base_time") == F.col("r_time")) & (F.col("base_id") == F.col("r_id")), "left")
    etag, modified = _header(F.col("headers"), "etag"), _header(F.col("headers"), "last-modified")
    same = F.when(etag.isNotNull(), _opaque(etag) == _opaque(_header(F.col("r_headers"), "etag"))).otherwise(modified == _header(F.col("r_headers"), "last-modified"))
    verdict = (
        F.when(F.col("base_time").isNull(), "no_response").when(etag.isNull() & modified.isNull(), "no_validator").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("mismatch")
    )
    out = joined.withColumn("verdict", verdict)
    good = F.col("verdict") == "resolved"
    return out.select("record_id", "canonical", "captured", F.when(good, F.col("base_id")).alias("base_id"), "verdict", F.when(good, merged_headers(F.col("r_headers"), F.col("headers"))).alias("headers"))


def resolved_bodies(records: DataFrame, body: str, bucket_s: int = BUCKET_S, canonical: Callable[[Column], Column] = standard_url) -> DataFrame:
    """``resolved`` with the ``body`` column of the response, for the revisits that are resolved.

    Joins on the response's id, which record_id must name; a much revisited response is one side
    of a join that adaptive execution splits.
    """
    done = written(resolved(records, bucket_s, canonical).where("verdict = 'resolved'"), "resolved")
    bodies = records.where("status = 200").select(F.col("record_id").alias("base_id"), F.col(f"`{body}`").alias("body"))
    return done.join(bodies, "base_id").select("record_id", "canonical", "captured", "base_id", "headers", "body")


def page_records(pages: DataFrame) -> DataFrame:
    """A capture log of raw ``pages`` (page_id, url, html): each page a full response at second
    page_id, and a revisit of it half an hour later whose validator depends on page_id.

    Revisits: of pages 0, 3, 6 ... by ETag; 1, 4, 7 ... by Last-Modified; of 2, 5, 8 ... with a
    weak ETag, which is another one for multiples of 5; none for multiples of 7. Ids are
    2 * page_id and 2 * page_id + 1.
    """
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    time = F.timestamp_seconds(F.col("page_id"))
    date = F.concat(F.lit("second "), F.col("page_id").cast("string"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        time.alias("captured"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("Last-Modified"), date, F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.octet_length("html").cast("string")).alias("headers"),
        F.col("html"),
    )
    k = F.col("page_id") % 3
    other = F.when(F.col("page_id") % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    by_tag = F.when(F.col("page_id") % 7 == 0, F.lit("")).when(k == 0, F.concat(F.lit('"'), tag, F.lit('"'))).when(k == 2, F.concat(F.lit('W/"'), tag, other, F.lit('"'))).otherwise(F.lit(""))
    by_date = F.when((F.col("page_id") % 7 != 0) & (k == 1), date).otherwise(F.lit(""))
    seen = F.timestamp_seconds(F.col("page_id") + 1800)
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        "url",
        seen.alias("captured"),
        F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), by_tag, F.lit("last-modified"), by_date, F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=120"), F.lit("Date"), F.concat(F.lit("second "), (F.col("page_id") + 1800).cast("string"))).alias("headers"),
        F.lit(None).cast("string").alias("html"),
    )
    return full.unionByName(again)
