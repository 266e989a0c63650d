"""WARC records and the resolution of not-modified revisits.

A revisit record says that a page had not changed; it has no body. Each one takes the latest earlier full response of
its canonical address (an as-of join), if that response's validators agree with what the revisit says, and the headers
that a 304 answer may update replace the response's own. The as-of join runs in time buckets of an address, and the last
response of earlier buckets is carried over, so one address with very many captures is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairscope.functions.shaping import computed_once
from pairscope.llm.common import let
from pairscope.session import cut_lineage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
BUCKET_SECONDS = 86_400
BLANK = "\r\n\r\n"
#: Fixed list: headers of a 304 answer that update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without scheme, user, `www.`, standard port, fragment, tracking parameters and closing slash.

    The other parameters are sorted. A null address is null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^([^@]*@)?(www[0-9]*[.])?", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    kept = F.array_sort(F.filter(
        F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _block(text: Column) -> Column:
    """What stands before the first empty line, or everything."""
    return F.substring_index(text, BLANK, 1)


def _after(text: Column) -> Column:
    """What stands after the first empty line, or nothing."""
    cut = F.instr(text, BLANK)
    return F.when(cut > 0, F.substring(text, cut + len(BLANK), F.lit(2**31 - 1))).otherwise("")


def _headers(block: Column) -> Column:
    """Header lines as a map with lower-case names; lines without a colon are skipped, of a repeated name the last counts."""
    lines = F.filter(F.split(block, "\r\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(
        F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))

    def last(found: Column) -> Column:
        return F.filter(found, lambda p, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda q: q["k"] == p["k"]))

    return F.map_from_entries(let(pairs, last))


def render_record(kind: Column, identifier: Column, url: Column, at: Column, extra: Column, http: Column, body: Column) -> Column:
    """A WARC/1.1 record text; ``extra`` holds further WARC header lines, ``http`` the HTTP block, both with line ends."""
    payload = F.concat(http, F.lit("\r\n"), body)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:pairscope:"), identifier, F.lit(">\r\nWARC-Target-URI: "),
        url, F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\n"), extra,
        F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)


def records(raw: DataFrame, record_col: str = "record") -> DataFrame:
    """Columns record_id, kind, url, canonical, at (seconds), status, headers, body of WARC record texts.

    The WARC block, the HTTP block and the body are separated by empty lines. Records without an identifier, address or
    readable date are left out, null ones too; a response has status 200 to be full.
    """
    # each step's value is computed once, as bodies may be long
    whole = raw.select(F.col(record_col).alias("record")).where("record IS NOT NULL")
    split = computed_once(whole, "s", F.struct(_headers(_block(F.col("record"))).alias("warc"), _after(F.col("record")).alias("rest")))
    http = _block(F.col("s.rest"))
    parsed = split.select("s.warc", "s.rest", http.alias("http"))
    field = lambda name: F.col("warc")[name]
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    return parsed.select(
        F.regexp_extract(field("warc-record-id"), "([^:<>]*)>?$", 1).alias("record_id"), field("warc-type").alias("kind"),
        field("warc-target-uri").alias("url"), canonical_url(field("warc-target-uri")).alias("canonical"),
        F.unix_seconds(F.try_to_timestamp(field("warc-date"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))).alias("at"),
        F.when(status != "", status.cast("int")).alias("status"), _headers(F.col("http")).alias("headers"), _after(F.col("rest")).alias("body"),
    ).where("record_id IS NOT NULL AND canonical IS NOT NULL AND at IS NOT NULL")


def resolve(found: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical, at, response_id, outcome, headers, body.

    ``outcome`` is resolved, mismatch (a validator differs), unverified (no validator in common) or missing (no earlier
    full response). The headers and body are those of the response, updated, where it is resolved, else null. Of responses
    at the same second the one with the largest identifier is the latest, of those with equal identifiers the one with the
    largest digest of its content; a response at the revisit's own second is not earlier. Identifiers may repeat.
    """
    digest = F.xxhash64(F.array_sort(F.map_entries("headers")), "body")
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("at", "record_id", digest.alias("digest")))
    # all but the bodies, which are read again for the final join only
    thin = cut_lineage(found.where((F.col("kind") == "response") & (F.col("status") == 200) | (F.col("kind") == "revisit")).select(
        F.monotonically_increasing_id().alias("row"), "record_id", "kind", "canonical", "at", full.alias("full"), F.floor(F.col("at") / bucket_seconds).alias("bucket"),
        F.when(F.col("kind") == "revisit", F.col("headers")).alias("own")))
    inside = Window.partitionBy("canonical", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = thin.groupBy("canonical", "bucket").agg(F.max("full").alias("best")).withColumn("carried", F.max("best").over(earlier)).drop("best")
    matched = (
        thin.drop("own").withColumn("near", F.max("full").over(inside)).where("kind = 'revisit'").join(carried, ["canonical", "bucket"])
        .select("row", F.coalesce("near", "carried").alias("chosen"))
    )
    revisit = thin.where("kind = 'revisit'").select("row", "record_id", "canonical", "at", "own").join(matched, "row").select(
        "record_id", "canonical", "at", "own", F.col("chosen.record_id").alias("response_id"),
        F.col("chosen.at").alias("response_at"), F.col("chosen.digest").alias("digest"))
    # one row per response, as equal rows may repeat
    key = ["canonical", "response_id", "response_at", "digest"]
    response = found.where("kind = 'response' AND status = 200").select(
        "canonical", F.col("record_id").alias("response_id"), F.col("at").alias("response_at"), digest.alias("digest"),
        F.col("headers").alias("stored"), "body").dropDuplicates(key)
    both = revisit.join(response, key, "left")
    stored, own = F.col("stored"), F.col("own")
    weak = lambda m: F.regexp_replace(m["etag"], "^W/", "")
    agrees = F.coalesce(weak(stored) == weak(own), stored["last-modified"] == own["last-modified"])
    outcome = F.when(stored.isNull(), "missing").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    updates = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(updates, k)), updates)
    resolved = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical", "at", "response_id", "outcome", F.when(resolved, merged).alias("headers"), F.when(resolved, F.col("body")).alias("body"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC record texts derived from pages (page_id, url, html): column record.

    Page n is captured in full n * 7,919 seconds (modulo 400 days) after 2024-01-01. A revisit follows 3 days later, at the
    address with a tracking parameter, whose validators are stale for every fifth page and absent for every eleventh. Null
    addresses and bodies are empty.
    """
    n = F.coalesce(F.col("page_id"), F.lit(-1)).cast("bigint")
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    at = F.lit(1_704_067_200) + F.pmod(n * 7_919, F.lit(400 * 86_400))
    tag = F.substring(F.sha2(html, 256), 1, 16)
    http = F.concat(
        F.lit('HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nCache-Control: max-age=60\r\nETag: "'), tag,
        F.lit('"\r\nContent-Length: '), F.octet_length(html).cast("string"), F.lit("\r\n"))
    response = render_record(F.lit("response"), F.concat(F.lit("p"), n.cast("string")), url, at, F.lit(""), http, html)
    clean, mark = F.regexp_replace(url, "#.*$", ""), F.lit("utm_source=again")
    again = F.concat(clean, F.when(F.instr(clean, "?") > 0, "&").otherwise("?"), mark)
    said = F.when(F.pmod(n, F.lit(11)) == 0, "").otherwise(F.concat(
        F.lit('ETag: W/"'), F.when(F.pmod(n, F.lit(5)) == 0, F.lit("stale")).otherwise(tag), F.lit('"\r\n')))
    answer = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nCache-Control: max-age=3600\r\nContent-Length: 0\r\nVary: Accept\r\n"), said)
    revisit = render_record(F.lit("revisit"), F.concat(F.lit("r"), n.cast("string")), again, at + 3 * 86_400, F.lit(f"WARC-Profile: {PROFILE}\r\n"), answer, F.lit(""))
    return pages.select(F.explode(F.array(response, revisit)).alias("record"))


def revisit_report(pages: DataFrame) -> DataFrame:
    """One row per page's revisit: record_id, canonical_url, response_id, outcome, cache_control, content_length, body_sha256."""
    found = records(records_of_pages(pages))
    return resolve(found).select(
        "record_id", F.col("canonical").alias("canonical_url"), "response_id", "outcome", F.col("headers")["cache-control"].alias("cache_control"),
        F.col("headers")["content-length"].cast("bigint").alias("content_length"), F.sha2("body", 256).alias("body_sha256"))
