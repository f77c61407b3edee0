"""Not-modified revisits of a crawl, resolved to the responses they stand for.

A revisit is joined as of its time with the latest earlier full response of the same canonical URL. If a validator
agrees (the entity tag, else the modification date, else the payload digest, whichever the revisit has first), the
response stands, with those headers of the revisit laid over its own that a not-modified answer may change.

The as-of join is a running last value. A URL's records are cut into time buckets: BINS quantiles of the times of all
records, each cut evenly so that a bucket holds about bucket_rows; a few stray times change no other bin. Each
bucket's last response is carried to the next ones over one row a bucket, and within buckets a window does the
rest, so a URL with a third of all records is many tasks.

Order within a URL is by time, then record id. Nulls: revisits without a URL or a time are unresolved; responses
without a URL or a time serve none. Equal rows are records of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may change.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
BUCKET_ROWS, BINS = 10_000, 128


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without fragment, default port, utm_ parameters, empty query and closing slashes."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    place = F.lower(F.regexp_extract(plain, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1))
    rest = F.substring(plain, F.length(place) + 1, F.length(plain))
    place = F.regexp_replace(F.regexp_replace(place, "^(http://[^/?]*):80$", "$1"), "^(https://[^/?]*):443$", "$1")
    rest = F.regexp_replace(rest, "([?&])utm_[a-z]+=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "\\?&", "?"), "[?&]+$", "")
    return F.concat(place, F.regexp_replace(rest, "/+$", ""))


def strong(tag: Column) -> Column:
    """An entity tag without its mark of weakness: revalidation compares weakly."""
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (record_id, url_key, outcome, response_id, headers), one for each revisit.

    records: record_id, url, time (long), kind ('response' or 'revisit'), etag, last_modified, digest,
    headers (map of lower-case names). outcome: resolved, mismatch, unvalidated, no_response or no_key; response_id
    and headers are null unless resolved. Other columns are ignored.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "time", "kind", "etag", "last_modified", "digest", "headers")
    usable = rows.filter("url_key IS NOT NULL AND time IS NOT NULL")
    first, last, n, quantiles = usable.agg(F.min("time"), F.max("time"), F.count("*"), F.percentile_approx("time", [i / BINS for i in range(BINS)])).first()
    lows = sorted({first or 0, *(quantiles or [])})
    highs = [*lows[1:], (last or 0) + 1]
    parts = max(1, n // (len(lows) * bucket_rows))
    at = lambda values, i: F.get(F.array(*[F.lit(x).cast("long") for x in values]), i - 1)
    bin_of = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in lows]), lambda low: low <= F.col("time")))
    share = (F.col("time") - at(lows, F.col("bin"))) / (at(highs, F.col("bin")) - at(lows, F.col("bin")))
    bucket = F.col("bin") * F.lit(parts).cast("long") + F.floor(share * parts)
    full = F.when(F.col("kind") == "response", F.struct("time", "record_id", "etag", "last_modified", "digest", "headers"))
    placed = usable.withColumn("bin", bin_of).withColumn("bucket", bucket).drop("bin").withColumn("full", full)
    order = [F.col("time"), F.col("record_id")]
    latest = placed.groupBy("url_key", "bucket").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(*order))).alias("latest"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(F.col("url_key").alias("k"), F.col("bucket").alias("b"), F.last("latest", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("url_key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = (
        placed.withColumn("near", F.last("full", ignorenulls=True).over(within))
        .filter("kind = 'revisit'")
        .join(carried, (F.col("url_key") == F.col("k")) & (F.col("bucket") == F.col("b")))
        .withColumn("of", F.coalesce("near", "carried"))
    )
    agrees = (
        F.when(F.col("etag").isNotNull(), strong(F.col("etag")).eqNullSafe(strong(F.col("of.etag"))))
        .when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("of.last_modified")))
        .when(F.col("digest").isNotNull(), F.col("digest").eqNullSafe(F.col("of.digest")))
    )
    outcome = F.when(F.col("of").isNull(), "no_response").when(agrees.isNull(), "unvalidated").when(agrees, "resolved").otherwise("mismatch")
    changed = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    held = F.map_filter(F.coalesce("of.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(changed), k))
    resolved = joined.withColumn("outcome", outcome).select(
        "record_id", "url_key", "outcome",
        F.when(F.col("outcome") == "resolved", F.col("of.record_id")).alias("response_id"),
        F.when(F.col("outcome") == "resolved", F.map_concat(held, changed)).alias("headers"),
    )
    lost = rows.filter("kind = 'revisit' AND (url_key IS NULL OR time IS NULL)")
    nothing = resolved.schema
    return resolved.union(lost.select("record_id", "url_key", F.lit("no_key"), F.lit(None).cast(nothing["response_id"].dataType), F.lit(None).cast(nothing["headers"].dataType)))


def capture_log(pages: DataFrame) -> DataFrame:
    """A crawl log derived from pages (page_id, url, html): four visits to each, a full response first.

    The second visit is a revisit by tag, with a wrong one for every fourth page; the third is a changed response
    for every third page, else a revisit by date; the fourth a revisit by digest, or without any validator for
    every fifth page. Later visits spell the URL in other ways.
    """
    p, visit = F.col("page_id"), F.col("visit")
    changed = p % 3 == 0
    kind = F.when((visit == 0) | ((visit == 2) & changed), "response").otherwise("revisit")
    now_digest = F.when((visit >= 2) & changed, F.sha1(F.concat("html", F.lit("+")))).otherwise(F.sha1("html"))
    tag = F.concat(F.lit('"'), F.substring(now_digest, 1, 12), F.lit('"'))
    etag = F.when((visit == 1) & (p % 4 == 0), '"stale"').when(visit == 1, F.concat(F.lit("W/"), tag)).when(kind == "response", tag)
    date = F.when((kind == "response") | (visit == 2), F.concat(F.lit("day "), p % 7))
    digest = F.when((kind == "response") | ((visit == 3) & (p % 5 != 0)), now_digest)
    url = F.when(visit == 1, F.concat("url", F.lit("#again"))).when(visit == 3, F.regexp_replace("url", "^https?://", "HTTPS://")).otherwise(F.col("url"))
    headers = F.create_map(
        F.lit("date"), F.concat(F.lit("t"), F.col("time")), F.lit("etag"), etag, F.lit("content-length"), F.when(kind == "response", F.length("html").cast("string")).otherwise("0"),
        F.lit("cache-control"), F.concat(F.lit("max-age="), p % 100 + visit),
    )
    visits = pages.withColumn("visit", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("time", p * 3 + visit * 1000)
    return visits.select(
        (p * 4 + visit).alias("record_id"), url.alias("url"), "time", kind.alias("kind"), etag.alias("etag"), date.alias("last_modified"), digest.alias("digest"), headers.alias("headers")
    )
