"""Not-modified revisits of WARC captures, resolved to the response they repeat.

A revisit record holds the headers of a 304 answer and no payload. It belongs
to the latest earlier full response of the same canonical URL; their validators
are compared, and the headers that a 304 answer may update are merged.

The as-of join works on different (URL, time) keys only, dealt by ranges of
both, so one URL with a third of all captures is cut in time like any other
range. Within a range a window finds the latest response; what a range passes
on to the next one is a row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, stored, table

# Headers that a 304 answer may update, and query parameters
# that name a session or a campaign and not a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
DROPPED = "^(utm_[^=]*|gclid|fbclid|phpsessid|jsessionid|sid)(=|$)"
URL = "^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host without user, ``www`` and default port, path without a last slash, sorted parameters.

    Null for what is no absolute URL.
    """
    host = F.lower(F.regexp_replace(F.regexp_extract(url, URL, 1), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[0-9]*\\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 2), "/+$", "")
    kept = F.filter(
        F.split(F.regexp_extract(url, URL, 3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(DROPPED)
    )
    query = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def http_status(block: Column) -> Column:
    return F.regexp_extract(block, "^HTTP/[0-9.]+ +([0-9]{3})", 1).try_cast("int")


def http_headers(block: Column) -> Column:
    """``(name, value)`` of each header of a block, by name; equal names are joined by commas."""
    head = F.element_at(F.split(block, "\r?\n\r?\n", 2), 1)
    lines = F.filter(F.split(head, "\r?\n"), lambda x: x.rlike("^[^:\\s]+:"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, "^([^:]+):", 1)).alias("name"),
            F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("value"),
        ),
    )
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))

    def joined(name: Column) -> Column:
        values = F.transform(F.filter(pairs, lambda p: p["name"] == name), lambda p: p["value"])
        return F.struct(name.alias("name"), F.array_join(values, ", ").alias("value"))

    return F.coalesce(F.transform(names, joined), F.array().cast("array<struct<name:string,value:string>>"))


def _value(headers: str, name: str) -> Column:
    """A header's value, null if it is absent."""
    return F.get(F.filter(headers, lambda h: h["name"] == name), F.lit(0))["value"]


def merged_headers(response: str, revisit: str) -> Column:
    """The response's headers with those that the revisit may update."""
    allowed = F.filter(revisit, lambda h: h["name"].isin(*PERMITTED))
    kept = F.filter(response, lambda h: ~F.exists(allowed, lambda a: a["name"] == h["name"]))
    return F.array_sort(F.concat(kept, allowed))


def latest_before(keys: DataFrame, known: DataFrame) -> DataFrame:
    """``(url, at, found_id)``: for each key the id of the latest of ``known(url, at, id)`` that is earlier.

    ``keys(url, at)`` are different; of equal (url, at) in ``known`` the
    greatest id counts.
    """
    known = known.groupBy("url", "at").agg(F.max("id").alias("id"))
    events = keys.select("url", "at", F.lit(None).cast("long").alias("id")).unionByName(known)
    parts = events.repartitionByRange("url", "at").withColumn("part", F.spark_partition_id())
    parts = materialize(parts, "asof")
    event = F.when(F.col("id").isNotNull(), F.struct("at", "id"))
    earlier = Window.partitionBy("part", "url").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    here = parts.withColumn("here", F.max(event).over(earlier)).where("id IS NULL")

    # Only a range's first URL can go on from the range before, only its last one into the next.
    ends = parts.groupBy("part").agg(F.min("url").alias("first_url"), F.max("url").alias("last_url"))
    ends = stored(ends, "asof-ends")
    tails = parts.where("id IS NOT NULL").join(
        F.broadcast(ends.select(F.col("part").alias("of"), "last_url")),
        (F.col("part") == F.col("of")) & (F.col("url") == F.col("last_url")),
    )
    tails = tails.groupBy("part", "url").agg(F.max(event).alias("last"))
    heads = ends.select("part", F.col("first_url").alias("url"), F.lit(None).cast(tails.schema["last"].dataType).alias("last"))
    before = Window.partitionBy("url").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)))
    carried = carried.withColumn("carry", F.max("last").over(before)).where("head")
    # One row per range: bounded by the number of partitions.
    carried = F.broadcast(carried.select(F.col("part").alias("of"), F.col("url").alias("of_url"), "carry"))
    both = here.join(carried, (F.col("part") == F.col("of")) & (F.col("url") == F.col("of_url")), "left")
    return both.select("url", "at", F.greatest("here", "carry")["id"].alias("found_id"))


def resolved_revisits(records: DataFrame) -> DataFrame:
    """Revisits of ``records(record_id, warc_type, target_uri, at, block)`` with their responses.

    ``at`` is a whole number of seconds; ``block`` the HTTP head. Returns a row
    per revisit: record_id, url (canonical), response_id, outcome and headers
    (``name: value`` lines, by name). Outcomes: ``resolved`` (all validators
    that both have agree), ``mismatch`` (one differs), ``unverified`` (none in
    common), ``no_response`` (no earlier full response), ``no_key`` (null time,
    or null or relative URL). Headers are merged if resolved, else the
    revisit's own. Full responses are those of status 200; of responses of one
    URL and time the greatest record_id counts; a record_id that is repeated
    among responses counts once, with the least of its header lists; repeated
    revisits are resolved each. A null block has no headers. An empty table
    gives an empty result; other columns are ignored.
    """
    rows = records.select(
        "record_id",
        "warc_type",
        canonical_url(F.col("target_uri")).alias("url"),
        F.col("at").cast("long").alias("at"),
        http_status(F.col("block")).alias("status"),
        http_headers(F.col("block")).alias("headers"),
    )
    rows = materialize(rows, "captures")
    keyed = F.col("url").isNotNull() & F.col("at").isNotNull()
    revisits = rows.where("warc_type = 'revisit'").drop("warc_type", "status")
    full = rows.where("warc_type = 'response' AND status = 200").where(keyed)
    found = latest_before(
        revisits.where(keyed).select("url", "at").distinct(),
        full.select("url", "at", F.col("record_id").alias("id")),
    )
    found = found.select(F.col("url").alias("key_url"), F.col("at").alias("key_at"), "found_id")
    same = (F.col("url") == F.col("key_url")) & (F.col("at") == F.col("key_at"))
    known = revisits.join(found, same, "left").drop("key_url", "key_at")
    held = full.select(F.col("record_id").alias("response_id"), F.col("headers").alias("held"))
    # Written by itself: with no aggregate in its stage, the join's hot keys (and null) are split.
    held = stored(held.groupBy("response_id").agg(F.min("held").alias("held")), "responses")
    pairs = known.join(held, F.col("found_id") == F.col("response_id"), "left")
    tag = lambda c: F.regexp_replace(_value(c, "etag"), "^W/", "")
    # Null where one of the two lacks the validator.
    agree = [tag("headers") == tag("held"), _value("headers", "last-modified") == _value("held", "last-modified")]
    outcome = (
        F.when(~keyed, "no_key")
        .when(F.col("response_id").isNull(), "no_response")
        .when(F.coalesce(~agree[0], F.lit(False)) | F.coalesce(~agree[1], F.lit(False)), "mismatch")
        .when(agree[0].isNull() & agree[1].isNull(), "unverified")
        .otherwise("resolved")
    )
    pairs = pairs.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome") == "resolved", merged_headers("held", "headers")).otherwise(F.col("headers"))
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return pairs.select("record_id", "url", "response_id", "outcome", lines.alias("headers"))


# The capture log that the query derives from ``pages``: a response per page
# and three revisits of it, with validators that agree, differ or are missing.
START = 1_700_000_000


def capture_log(pages: DataFrame) -> DataFrame:
    i = F.col("page_id")
    at = F.lit(START) + (i * 7919) % 1_000_000
    base = F.regexp_replace("url", "#.*$", "")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def record(j: int, kind: str, uri: Column, when: Column, block: Column) -> Column:
        return F.struct(
            (i * 10 + j).alias("record_id"),
            F.lit(kind).alias("warc_type"),
            uri.alias("target_uri"),
            when.alias("at"),
            block.alias("block"),
        )

    response = text(
        "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nETag: ", tag, "\r\nLast-Modified: T", at,
        "\r\nContent-Length: ", F.length(F.coalesce("html", F.lit(""))), "\r\nCache-Control: max-age=60\r\nDate: D", at,
        "\r\n\r\n",
    )
    early, hours, days = at - 3600, at + 3600 * (i % 50 + 1), at + 86_400 * (i % 7 + 1)
    tagged = F.when(i % 5 == 0, F.lit('"other"')).when(i % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when(i % 7 == 0, at + 1).otherwise(at)
    glue = F.when(F.instr(base, "?") > 0, "&").otherwise("?")
    records = F.array(
        record(0, "response", F.col("url"), at, response),
        record(1, "revisit", F.col("url"), early, text("HTTP/1.1 304 Not Modified\r\nETag: ", tag, "\r\nDate: D", early, "\r\n\r\n")),
        record(
            2, "revisit", F.concat(base, F.lit("#again")), hours,
            text("HTTP/1.1 304 Not Modified\r\nETag: ", tagged, "\r\nDate: D", hours, "\r\nContent-Length: 0\r\n\r\n"),
        ),
        record(
            3, "revisit", F.concat(base, glue, F.lit("utm_campaign=x")), days,
            text("HTTP/1.1 304 Not Modified\r\nLast-Modified: T", modified, "\r\nCache-Control: max-age=600\r\nDate: D", days,
                 "\r\nSet-Cookie: a=b\r\n\r\n"),
        ),
    )
    return pages.select(F.inline(records))


def op4_revisits(spark, sf_dir):
    return resolved_revisits(capture_log(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


_URL_SQL = URL.replace("\\\\", "\\")
_TAG = "'\"' || substr(md5(coalesce(html, '')), 1, 16) || '\"'"
_CANON = f"""regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(uri, '{_URL_SQL}', 1), '^[^@]*@', '')), ':(80|443)$', ''), '^www[0-9]*\\.', '')
  || regexp_replace(regexp_extract(uri, '{_URL_SQL}', 2), '/+$', '')
  || (CASE WHEN q = '' THEN '' ELSE '?' || q END)"""
ORACLE = f"""
WITH p AS (SELECT page_id AS i, url, regexp_replace(url, '#.*$', '') AS base, {_TAG} AS tag,
                  length(coalesce(html, '')) AS n, {START} + (page_id * 7919) % 1000000 AS t FROM pages),
log AS (
  SELECT i * 10 AS id, 'response' AS kind, url AS uri, t AS ts, tag AS etag, 'T' || t AS lm, n, t AS own FROM p
  UNION ALL SELECT i * 10 + 1, 'revisit', url, t - 3600, tag, NULL, NULL, t FROM p
  UNION ALL SELECT i * 10 + 2, 'revisit', base || '#again', t + 3600 * (i % 50 + 1),
    CASE WHEN i % 5 = 0 THEN '"other"' WHEN i % 3 = 0 THEN 'W/' || tag ELSE tag END, NULL, NULL, t FROM p
  UNION ALL SELECT i * 10 + 3, 'revisit', base || (CASE WHEN instr(base, '?') > 0 THEN '&' ELSE '?' END) || 'utm_campaign=x',
    t + 86400 * (i % 7 + 1), NULL, 'T' || (CASE WHEN i % 7 = 0 THEN t + 1 ELSE t END), NULL, t FROM p),
keyed AS (SELECT *, array_to_string(list_sort(list_filter(string_split(regexp_extract(uri, '{_URL_SQL}', 3), '&'),
                   lambda x: x <> '' AND NOT regexp_matches(lower(x), '{DROPPED}'))), '&') AS q FROM log),
urls AS (SELECT *, {_CANON} AS url FROM keyed),
full_ AS (SELECT url, ts, max(id) AS id FROM urls WHERE kind = 'response' GROUP BY url, ts),
found AS (SELECT r.*, f.id AS response_id FROM (SELECT * FROM urls WHERE kind = 'revisit') r
          ASOF LEFT JOIN full_ f ON r.url = f.url AND r.ts > f.ts),
pairs AS (SELECT f.*, h.etag AS h_etag, h.lm AS h_lm, h.n AS h_n, regexp_replace(f.etag, '^W/', '') = h.etag AS same_tag,
                 f.lm = h.lm AS same_lm FROM found f LEFT JOIN (SELECT * FROM urls WHERE kind = 'response') h ON f.response_id = h.id),
judged AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
    WHEN same_tag = false OR same_lm = false THEN 'mismatch' ELSE 'resolved' END AS outcome FROM pairs)
SELECT id AS record_id, url, response_id, outcome, CASE
  WHEN outcome = 'resolved' THEN 'cache-control: ' || (CASE id % 10 WHEN 3 THEN 'max-age=600' ELSE 'max-age=60' END)
    || chr(10) || 'content-length: ' || h_n || chr(10) || 'content-type: text/html' || chr(10) || 'date: D' || ts
    || chr(10) || 'etag: ' || coalesce(etag, h_etag) || chr(10) || 'last-modified: ' || h_lm
  WHEN id % 10 = 1 THEN 'date: D' || ts || chr(10) || 'etag: ' || etag
  WHEN id % 10 = 2 THEN 'content-length: 0' || chr(10) || 'date: D' || ts || chr(10) || 'etag: ' || etag
  ELSE 'cache-control: max-age=600' || chr(10) || 'date: D' || ts || chr(10) || 'last-modified: ' || lm || chr(10) || 'set-cookie: a=b'
  END AS headers
FROM judged
"""
