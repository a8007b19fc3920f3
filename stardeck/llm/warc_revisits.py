"""Resolution of "not modified" revisits in crawl records.

A revisit has headers but no payload. It is joined, by canonical URL, to the latest full response of an
earlier time. If the validators of both agree (entity tags compared weakly; without one on either side,
the times of last modification), the revisit stands for that response, with the headers that it may change.

The as-of join works on different (URL, time) pairs, cut by quantiles of time into spans: a window takes
the last response inside each span, a second one, over one row for each URL and span, carries the last
response of earlier spans forward. There are more spans where there are more records, so a URL that holds a third
of them makes many groups of bounded size. Revisits that found a response fetch its headers by id; Spark splits
the revisits of a response that many refer to, as a response is one row. Those that found none don't take part.

Cases: a null URL or time matches nothing; responses of equal URL and time count as one, that of the
greatest id; of responses with one id the greatest sorted headers; null headers are no headers; a header's null value counts as absent; repeated revisits are
resolved each; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that describe the message or its missing payload; a 304 does not change them in the stored response.
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host without www and default port, path without a last slash, sorted parameters without utm_*; no scheme or fragment."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^.*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    asked = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    asked = F.array_join(F.array_sort(F.filter(asked, lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def record_kind(warc_type: Column, profile: Column, http_status: Column) -> Column:
    """What resolve() calls a WARC record: "revisit" for one by a server's "not modified", "response" for a full one, else null.

    A revisit that says its payload is identical has headers of its own and a payload elsewhere: it isn't one of these.
    """
    unchanged = F.coalesce(F.lower(profile).rlike("server-not-modified/?$"), http_status == 304, F.lit(False))
    kind = F.lower(F.trim(warc_type))
    return F.when((kind == "revisit") & unchanged, "revisit").when((kind == "response") & F.coalesce(http_status.between(200, 299), F.lit(True)), "response")


#: Records in one span of time, about.
SPAN_ROWS = 500_000


def _span_of(cuts: list[int]) -> Callable[[Column], Column]:
    """The number of cuts below a time, by binary search; null for null."""
    at = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def place(ts: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, ts.to_numpy(), side="left").astype(np.int32))

    return place if cuts else lambda _: F.lit(0)


def resolve(records: DataFrame, spans: int | None = None) -> DataFrame:
    """record_id, url_key, refers_to, status and headers for every revisit among `records`.

    records: record_id long, ts long, url string, kind ("response" or "revisit"), headers map<string,string>
    with lower-case names. status: "merged" (validators agree; headers are the response's, updated),
    "mismatch", "unchecked" (no validator on both sides) or "missing" (no earlier response); headers are the
    revisit's own in the last three. spans: of time; by default one for each SPAN_ROWS records, 64 at least, so that what a task
    orders of one URL stays as it is however many records there are. Of responses at one time the greatest record_id counts. A
    record_id that several responses have is one response: that whose headers, as sorted lines, are the greatest text.
    """
    of = F.map_filter(F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    rows = records.select("record_id", "ts", canonical_url(F.col("url")).alias("url_key"), "kind", of.alias("headers"))
    full = rows.where(F.col("kind") == "response")
    revisits = rows.where(F.col("kind") == "revisit")
    if spans is None:
        spans = max(64, -(-rows.count() // SPAN_ROWS))
    # as fine as the spans need, and never finer than the sketch holds: a row of numbers at the driver
    cuts = rows.agg(F.percentile_approx("ts", [k / spans for k in range(1, spans)], max(10_000, 4 * spans)).alias("at")).first()["at"] or []
    span = _span_of(sorted(set(cuts)))
    known = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    responses = full.where(known).groupBy("url_key", "ts").agg(F.max("record_id").alias("response_id"))
    asked = revisits.where(known).select("url_key", "ts").distinct().withColumn("response_id", F.lit(None).cast("long"))
    points = responses.unionByName(asked).groupBy("url_key", "ts").agg(F.max("response_id").alias("response_id"), F.count(F.when(F.col("response_id").isNull(), 1)).alias("asked"))
    points = points.withColumn("span", span(F.col("ts")))
    latest = F.max(F.when(F.col("response_id").isNotNull(), F.struct("ts", "response_id")))
    inside = points.withColumn("found", latest.over(Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)))
    carried = points.groupBy("url_key", "span").agg(latest.alias("last"))
    carried = carried.withColumn("before", F.max("last").over(Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    as_of = inside.where("asked > 0").join(carried, ["url_key", "span"]).select("url_key", "ts", F.coalesce("found", "before")["response_id"].alias("refers_to"))
    with_id = revisits.join(as_of, ["url_key", "ts"], "left")
    # of several responses of one id the one whose sorted headers are the greatest text; they are compared before the join, in part on the map side
    stored = full.groupBy(F.col("record_id").alias("refers_to")).agg(F.max(F.struct(header_lines("headers").alias("lines"), F.map_entries("headers").alias("h"))).alias("s"))
    stored = stored.select("refers_to", F.map_from_entries("s.h").alias("stored"))
    met = with_id.where(F.col("refers_to").isNotNull()).join(stored, "refers_to", "left")
    alone = with_id.where(F.col("refers_to").isNull()).withColumn("stored", F.lit(None).cast("map<string,string>"))
    return met.unionByName(alone).select("record_id", "url_key", "refers_to", *_merged())


def _merged() -> tuple[Column, Column]:
    mine, stored = F.col("headers"), F.col("stored")
    tag, old_tag = mine["etag"], stored["etag"]
    when, old_when = mine["last-modified"], stored["last-modified"]
    tags = tag.isNotNull() & old_tag.isNotNull()
    times = when.isNotNull() & old_when.isNotNull()
    status = (
        F.when(F.col("refers_to").isNull(), "missing")
        .when(tags, F.when(_weak(tag) == _weak(old_tag), "merged").otherwise("mismatch"))
        .when(times, F.when(F.trim(when) == F.trim(old_when), "merged").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    new = F.map_filter(mine, lambda k, _: ~k.isin(NOT_MERGED))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return status.alias("status"), F.when(status == "merged", F.map_concat(kept, new)).otherwise(mine).alias("headers")


def header_lines(headers: str) -> Column:
    """A header map as sorted "name: value" lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(F.array_sort(lines), "\n")


def crawls(pages: DataFrame) -> DataFrame:
    """Records of pages crawled again and again: three full responses and two revisits of each page.

    Times are pseudo-random in 0 to 9,999, so the responses and revisits of a URL interleave, some revisits come before
    any response and some times are equal. The entity tags of the responses differ. A revisit asks under the page's URL
    with another fragment and sends the tag of one of the responses; every seventh page in turn sends another, every
    fifth none, and every third of those has no time of last modification either. A null page_id has null times.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", F.md5(html.cast("binary")).alias("md5"), F.octet_length(html).cast("string").alias("size"))
    p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    full = F.col("k") < 3
    text = lambda s: F.lit(s).cast("string")
    tag = lambda k: F.concat(F.lit('"'), "md5", F.lit("-"), k.cast("string"), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    sent = F.when(F.col("page_id") % 7 == 3, text('"changed"')).when(F.col("page_id") % 5 != 1, F.concat(F.lit("W/"), tag(F.col("page_id") % 3)))
    changed = F.when(~((F.col("page_id") % 5 == 1) & (F.col("page_id") % 3 == 0)), day)
    stored = F.create_map(text("etag"), tag(F.col("k")), text("last-modified"), day, text("content-length"), F.col("size"), text("content-type"), text("text/html"), text("cache-control"), text("max-age=60"))
    again = F.create_map(text("etag"), sent, text("last-modified"), changed, text("content-length"), text("0"), text("cache-control"), text("max-age=120"))
    return p.select(
        (8 * F.col("page_id") + F.col("k")).alias("record_id"),
        F.when(full, (F.col("page_id") * 7919 + F.col("k") * 3571) % 10_000).otherwise((F.col("page_id") * 104_729 + F.col("k") * 4999) % 10_000).alias("ts"),
        F.when(full, F.col("url")).otherwise(F.concat("url", F.lit("#again"))).alias("url"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, stored).otherwise(again).alias("headers"),
    )
