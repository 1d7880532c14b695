"""Not-modified revisits of web archives, resolved to the response they confirm.

A revisit record of the server-not-modified kind has no body: it stands for the latest earlier full response of its
canonical URL. `resolve` finds that response by an as-of join, checks the revisit's validators against it (its entity tag
if it has one, else its modification date) and merges the headers that a 304 may update into the stored ones.

The as-of join is by windows in two steps, so that one URL with a third of all records is no single task: time is cut
into slices, by quantiles of all records' times and evenly between two of these, so that a far-off time spoils no slice but
its own (records of one URL and one time share a slice); within a URL's slice the latest response so far is a window function, and the slices' last responses, at
most one row for each URL and slice, give what earlier slices leave.

Defined results: a response counts if its status is 200 and its time before the revisit's; of equal times the largest
record_id. Outcomes: resolved, no_earlier (none found), mismatch (a validator differs or is missing in the response),
unchecked (the revisit has no validator). Null or malformed URLs are their own canonical form as far as they can be cut,
and null URLs never match. Records without a time are never earlier and resolve to nothing. Repeated records are each
resolved. Header names are compared in lower case; null headers are none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields that a 304 leaves as stored (RFC 9111, 3.2) and hop-by-hop fields (RFC 9110, 7.6.1).
KEPT = ("content-length", "content-encoding", "content-type", "content-range", "content-location", "content-md5")
HOPS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?"
TRACKING = r"^(utm_.*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$"


def canonical(url: Column) -> Column:
    """A URL without scheme, user, www or mobile prefix, default port, fragment, tracking fields and last slash; host in
    lower case, query fields sorted."""
    authority = F.lower(F.regexp_extract(url, PARTS, 2))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^//([^@]*@)?", ""), r"^(www[0-9]*|m)\.", ""), r":(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(url, PARTS, 3), r"/+$", "")
    fields = F.array_sort(F.filter(F.split(F.substring(F.regexp_extract(url, PARTS, 4), 2, 1 << 30), "&"), lambda f: (f != "") & ~F.lower(f).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def lowered(headers: Column) -> Column:
    """Headers by lower-case name; the last of those that differ in case only."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    clean = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(clean, lambda e, i: ~F.exists(F.slice(clean, i + 2, F.size(clean) + 1), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def merged(stored: Column, update: Column) -> Column:
    """The stored headers with those of the update that it may set."""
    named = F.transform(F.split(F.lower(F.coalesce(update["connection"], F.lit(""))), ","), lambda t: F.trim(t))
    fixed = F.array(*[F.lit(x) for x in (*KEPT, *HOPS)])
    new = F.map_filter(update, lambda k, v: ~F.array_contains(fixed, k) & ~F.array_contains(named, k) & v.isNotNull())
    rest = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(rest, new)


def slice_of(held: DataFrame, slices: int) -> Column:
    """The number of the slice of time that `ts` is in, which grows with it: between quantiles, and evenly within."""
    asked = [k / slices for k in range(1, slices)]
    span = held.agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n"), F.percentile_approx("ts", asked, 10 * slices).alias("q")).first()
    edges = sorted({span["low"] or 0, *(span["q"] or [])})
    parts = max(1, (span["n"] or 0) // (slices * 1_000_000))
    widths = [max(1, -(-(high - low) // parts)) for low, high in zip(edges, [*edges[1:], (span["high"] or 0) + 1], strict=True)]
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    begins, ts = array(edges), F.col("ts")
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: at + F.when((at + s < len(edges)) & (F.get(begins, at + s) <= ts), s).otherwise(0))
    return place.cast("long") * (parts + 1) + F.floor((ts - F.get(begins, place)) / F.get(array(widths), place))


def resolve(records: DataFrame, slices: int = 256) -> DataFrame:
    """record_id, url, canonical_url, outcome, response_id and headers (merged; null unless resolved) of each revisit.

    records: record_id long, kind (response or revisit), url, ts long, status int, headers map.
    """
    held = records.select("record_id", "kind", "url", F.col("ts").cast("long"), "status", lowered(F.col("headers")).alias("headers"), canonical(F.col("url")).alias("canonical_url"))
    at_slice = slice_of(held, slices)
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    revisit = F.col("kind") == "revisit"
    found = F.when(full, F.struct(F.col("record_id").alias("id"), "headers"))
    timed = held.where(full | revisit).select("*", found.alias("response"), at_slice.alias("slice"))
    by_time = Window.partitionBy("canonical_url", "slice").orderBy("ts", revisit.cast("int").desc(), "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = timed.withColumn("here", F.last("response", ignorenulls=True).over(by_time)).where(revisit)
    ends = timed.groupBy("canonical_url", "slice").agg(F.max_by("response", F.when(full, F.struct("ts", "record_id"))).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.withColumn("before", F.last("last", ignorenulls=True).over(before)).where("canonical_url is not null and slice is not null").select("canonical_url", "slice", "before")
    met = inside.join(earlier, ["canonical_url", "slice"], "left").withColumn("at", F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("here", "before")))
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    theirs = F.col("at.headers")
    same = F.when(tag.isNotNull(), F.coalesce(weak(tag) == weak(theirs["etag"]), F.lit(False))).when(date.isNotNull(), F.coalesce(date == theirs["last-modified"], F.lit(False)))
    outcome = F.when(F.col("at").isNull(), "no_earlier").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    return met.select("record_id", "url", "canonical_url", outcome.alias("outcome"), F.col("at.id").alias("response_id"), F.when(outcome == "resolved", merged(theirs, F.col("headers"))).alias("headers"))


def weak(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def records_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl that saw each page, and came back later to an alias of its URL and was told not modified.

    Of five revisits one has an outdated entity tag and one a date alone; of eleven one asks for an address never seen.
    """
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit("")).cast("binary")), 1, 16), F.lit('"'))
    date = F.concat(F.lit("t"), (i * 10).cast("string"))
    text = lambda *c: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    seen = F.struct(
        (i * 4).alias("record_id"), F.lit("response").alias("kind"), F.col("url"), (i * 10).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text("d", (i * 10).cast("string"))).alias("headers"),
    )
    alias = F.when(F.pmod(i, F.lit(11)) == 0, text("http://never.example/", i.cast("string"))).otherwise(F.regexp_replace("url", "^https?://(m\\.)?", "HTTP://WWW."))
    given = F.when(F.pmod(i, F.lit(5)) == 0, F.lit('"outdated"')).when(F.pmod(i, F.lit(5)) == 1, F.lit(None)).otherwise(text("W/", tag))
    again = F.struct(
        (i * 4 + 1).alias("record_id"), F.lit("revisit").alias("kind"), alias.alias("url"), (i * 10 + 5 + F.pmod(i, F.lit(7)) * 1000).alias("ts"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), given, F.lit("last-modified"), date, F.lit("Content-Length"), F.lit("0"), F.lit("Date"), text("r", i.cast("string")), F.lit("Connection"), F.lit("close, X-Hop"), F.lit("X-Hop"), F.lit("1"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    return pages.select(F.explode(F.array(seen, again)).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolve(records_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return done.select("record_id", "url", "canonical_url", "outcome", "response_id", F.array_join(lines, "\n").alias("headers"))


SQL = r"""
WITH pages_in AS (
  SELECT page_id AS i, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, strlen(coalesce(html, '')) AS n FROM pages
), records AS (
  SELECT i * 4 AS record_id, 'response' AS kind, url, i * 10 AS ts, tag, 't' || (i * 10) AS modified, n, i FROM pages_in
  UNION ALL
  SELECT i * 4 + 1, 'revisit',
    CASE WHEN ((i % 11) + 11) % 11 = 0 THEN 'http://never.example/' || i ELSE regexp_replace(url, '^https?://(m\.)?', 'HTTP://WWW.') END,
    i * 10 + 5 + (((i % 7) + 7) % 7) * 1000,
    CASE ((i % 5) + 5) % 5 WHEN 0 THEN '"outdated"' WHEN 1 THEN NULL ELSE tag END, 't' || (i * 10), n, i FROM pages_in
), cut AS (
  SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?', 2)) AS authority,
    regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?', 3), '/+$', '') AS path,
    substr(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?', 4), 2) AS query FROM records
), named AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(authority, '^//([^@]*@)?', ''), '^(www[0-9]*|m)\.', ''), ':(80|443)?$', '') || path
    || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'),
    lambda f: f <> '' AND NOT regexp_matches(lower(f), '^(utm_.*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$'))) AS fields FROM cut) x
), met AS (
  SELECT r.record_id, r.url, r.canonical_url, r.tag, r.modified, r.i, s.record_id AS response_id, s.tag AS their_tag, s.modified AS their_modified, s.n AS their_n,
    row_number() OVER (PARTITION BY r.record_id ORDER BY s.ts DESC NULLS LAST, s.record_id DESC) AS place
  FROM (SELECT * FROM named WHERE kind = 'revisit') r
  LEFT JOIN (SELECT * FROM named WHERE kind = 'response') s ON r.canonical_url = s.canonical_url AND s.ts < r.ts
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_earlier'
    WHEN tag IS NOT NULL THEN CASE WHEN tag = their_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN modified = their_modified THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met WHERE place = 1
)
SELECT record_id, url, canonical_url, outcome, response_id,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || their_n || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: r' || i || chr(10) || 'etag: ' || CASE WHEN tag IS NULL THEN their_tag ELSE 'W/' || tag END || chr(10) || 'last-modified: ' || modified END AS headers
FROM judged
"""
