"""Resolution against a plain loop over the captures."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.llm import revisits as R

SCHEMA = "record_id long, warc_type string, target_uri string, at long, block string"


@pytest.mark.parametrize(
    "url,want",
    [
        ("http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f", "example.com/a?a=1&b=2"),
        ("https://user:pw@www2.example.com:443", "example.com"),
        ("https://m.example.com/x.html?", "m.example.com/x.html"),
        ("//example.com/a//", "example.com/a"),
        ("http://example.com:8080/A?sid=1&Z", "example.com:8080/A?Z"),
        ("/relative", None),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    frame = spark.createDataFrame([(url,)], "u string")
    assert frame.select(R.canonical_url(F.col("u"))).first()[0] == want


def test_headers(spark):
    block = "HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\nVary:x\r\nbroken line\r\nvary:  y \r\n\r\nEtag: body"
    frame = spark.createDataFrame([(block,), (None,), ("",)], "b string")
    got = frame.select(R.http_headers(F.col("b")), R.http_status(F.col("b"))).collect()
    assert [(h["name"], h["value"]) for h in got[0][0]] == [("etag", '"a"'), ("vary", "x, y")]
    assert got[0][1] == 304 and got[1][0] == [] and got[2][1] is None


def parse(block):
    lines = (block or "").split("\r\n\r\n")[0].split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def brute(rows):
    full = {}
    for i, kind, url, at, block in rows:
        if kind == "response" and block and " 200 " in block and url and at is not None:
            full.setdefault(url, []).append((at, i, parse(block)))
    out = []
    for i, kind, url, at, block in rows:
        if kind != "revisit":
            continue
        own = parse(block)
        held = max((f for f in full.get(url, []) if at is not None and f[0] < at), default=None, key=lambda f: f[:2])
        if not url or at is None:
            outcome = "no_key"
        elif not held:
            outcome = "no_response"
        else:
            pairs = [(own[k].removeprefix("W/"), held[2][k].removeprefix("W/")) for k in ("etag", "last-modified") if k in own and k in held[2]]
            outcome = "unverified" if not pairs else "mismatch" if any(a != b for a, b in pairs) else "resolved"
        merged = held[2] | {k: v for k, v in own.items() if k in R.PERMITTED} if outcome == "resolved" else own
        out.append((i, held and held[1], outcome, "\n".join(f"{k}: {merged[k]}" for k in sorted(merged))))
    return sorted(out)


def captures(seed, urls, n):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        url = draw.choice(["http://hot.example.com/", *urls]) if draw.random() < 0.6 else "http://hot.example.com/"
        kind = "response" if draw.random() < 0.15 else "revisit"
        code = "200 OK" if draw.random() < 0.9 else "404 Not Found"
        head = [f"HTTP/1.1 {code if kind == 'response' else '304 Not Modified'}"]
        head += [f"{name}: {value}" for name, value in (
            ("ETag", draw.choice(['"a"', 'W/"a"', '"b"'])), ("Last-Modified", draw.choice("xy")), ("Date", str(i)),
            ("Content-Length", str(i)), ("Cache-Control", "max-age=1"), ("Set-Cookie", "c"),
        ) if draw.random() < 0.6]
        rows.append((i, kind, url, draw.randrange(n // 2), "\r\n".join(head) + "\r\n\r\n"))
    return rows


def canonical(rows):
    return [(i, k, None if u is None else u.replace("http://", "").rstrip("/"), t, b) for i, k, u, t, b in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_a_plain_loop(spark, seed):
    rows = captures(seed, [f"http://e{i}.com/p" for i in range(20)], 600)
    rows += [(9001, "revisit", None, 5, None), (9002, "revisit", "http://hot.example.com/", None, ""), (9003, "request", "x", 1, "")]
    rows += [(9004, "response", "http://hot.example.com/", None, "HTTP/1.1 200 OK\r\n\r\n"), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("url", F.lit("clash")).withColumn("headers", F.lit(1))
    got = R.resolved_revisits(frame).collect()
    # A response that is there three times counts once, a revisit each time.
    assert sorted((r.record_id, r.response_id, r.outcome, r.headers) for r in got) == brute(canonical(rows))


def test_as_of_over_many_ranges(spark):
    """One URL over all ranges, and ranges without a response of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = spark.range(1000).select(F.lit("u").alias("url"), F.col("id").alias("at"))
        known = spark.createDataFrame([("u", 10, 1), ("u", 10, 2), ("u", 700, 3), ("t", 5, 4)], "url string, at long, id long")
        got = {r["at"]: r["found_id"] for r in R.latest_before(keys, known).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: None if i <= 10 else 2 if i <= 700 else 3 for i in range(1000)}


def test_a_repeated_record_id_has_the_least_of_its_headers(spark):
    rows = [(1, "response", f"http://e.com/{u}", 1, f"HTTP/1.1 200 OK\r\nETag: {t}\r\n\r\n") for u, t in ("ab", "ba", "cc")]
    rows += [(2, "revisit", "http://e.com/a", 2, "HTTP/1.1 304 Not Modified\r\nETag: a\r\n\r\n")]
    for part in (rows, rows[::-1]):
        got = R.resolved_revisits(spark.createDataFrame(part, SCHEMA).repartition(4)).collect()
        assert [(r.record_id, r.response_id, r.outcome) for r in got] == [(2, 1, "resolved")]


def test_empty(spark):
    assert R.resolved_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
