"""URL rules and WARC archives."""

import base64
import hashlib
import random

import pytest

from candor.llm import url_filter, warc
from candor.session import scratch_path


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest.split("?")[0].split("#")[0]


def verdict(url, rules):
    host, path = parts(url)
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (len(f[0]), f[1] == "block"), default=(None, "allow"))
    return host, path, *best


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("org", "/x", "allow"), ("org", "/x", "block")]
URLS = [None, "", "no scheme", "http://", "http:///p", "HTTP://WWW.Example.COM/en/a?x#y", "http://example.com/en", "http://example.com?/en/", "http://a.net/es/1", "http://net#f", "x://y://z.com/", "http://éX.com/é", "http://a..com/", "http://b.org/xy", "http://com./", "http://u:p@a.com:80/"]


@pytest.mark.parametrize("shard_keys", [10**6, 2])
def test_verdicts(spark, shard_keys):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS + URLS[5:7])], "page_id long, url string, Rule string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("q", None, "block"), ("q", "/", None)], "host string, path string, verdict string")
    got = url_filter.judge(df, rules, shard_keys=shard_keys).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict(r["url"], RULES), r
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {(r["rule"], r["verdict"]) for r in url_filter.judge(df, rules.limit(0)).collect()} == {(None, "allow")}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)  # many errors on every level
    one, two = url_filter._hashes(url_filter.F.col("key"))
    keys = spark.range(4000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS mine").withColumns({"one": one, "two": two})
    cascade = url_filter.build(keys.where("mine").drop("mine"), keys.drop("mine"))
    assert len(cascade.levels) > 2
    rows = keys.toPandas()
    assert (cascade.listed(rows["one"].to_numpy(), rows["two"].to_numpy()) == rows["mine"].to_numpy()).all()


def pages():
    rng = random.Random(2)
    tricky = "\r\n\r\nWARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:x>\r\n\r\n"
    texts = ["<html>é" * 50, "", None, tricky, "日本" * 200, "日本" * 200, "\r\n\r\n", "x" * 64, "x" * 63 + "é", "\n" * 130, "y" * 2_000_000]
    texts += ["".join(rng.choice("a\r\né日 ") for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    rows = [(i, None if i % 9 == 0 else f"http://a/{i}\r\nX: y", t) for i, t in enumerate(texts)]
    return rows + [(None, "n", "日本" * 200), (None, "n", "only here"), (8, rows[8][1], rows[8][2]), (4, rows[4][1], rows[4][2])]


def expected(rows, least=0):
    for k, _, html in rows:
        raw = (html or "").encode()
        same = [x[0] for x in rows if (x[2] or "").encode() == raw and x[0] is not None]
        top = max(same, default=None)
        again = len(raw) >= least and top is not None and (k is None or k < top)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        yield k, len(raw), digest, "revisit" if again else "response", top if again else None


@pytest.mark.parametrize("chunk_bytes", [64, 256 << 10])
def test_round_trip(spark, chunk_bytes):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string").repartition(3)
    got = warc.round_trip(df, chunk_bytes=chunk_bytes).collect()
    keys = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, [tuple(r[k] for k in keys) for r in got])) == sorted(map(repr, expected(rows)))


def test_archive_files_hold_records_by_the_format(spark):
    rows = [(1, "http://a/", "first"), (2, "http://b/", "é" * 100), (3, "http://c/", "first")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_path(spark, "warc-test")
    archive = warc.write_archive(df, path, chunk_bytes=50, compression="none", min_bytes=6)
    assert warc.open_archive(spark, path) == archive
    raw = b"".join(bytes(r["content"]) for r in spark.read.format("binaryFile").load(f"{path}/records").collect())
    found = []
    while raw:  # as any reader does: headers, then as many bytes as they say
        head, _, raw = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        found.append((fields["WARC-Type"], fields["X-Record-Key"], raw[:size]))
        assert raw[size : size + 4] == b"\r\n\r\n"
        raw = raw[size + 4 :]
    assert sorted(t for t, _, _ in found) == ["continuation"] * 3 + ["response"] * 3
    body = b"".join(b.partition(b"\r\n\r\n")[2] if t == "response" else b for t, k, b in found if k == "2")
    assert body == ("é" * 100).encode()
    chunks = warc.read_chunks(spark, archive)
    assert {r["key"]: r["payload_bytes"] for r in warc.payloads(chunks).collect()} == {1: 5, 2: 200, 3: 5}


def test_damage_is_noticed(spark):
    df = spark.createDataFrame([(1, "u", "z" * 300)], "page_id long, url string, html string")
    archive = warc.write_archive(df, scratch_path(spark, "warc-test"), chunk_bytes=100)
    chunks = warc.read_chunks(spark, archive)
    with pytest.raises(Exception, match="chunk 2 where 1 is due"):
        warc.payloads(chunks.where("chunk <> 1")).collect()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
