"""URL verdicts and WARC archives."""

import base64
import hashlib
import random

import pytest

from presswork.llm import url_filter as urls
from presswork.llm import warc

PAGE = "page_id long, url string, html string, node string, salt int, n long, rule string"


def pages(spark, data):
    return spark.createDataFrame([(*d, "x", 1, 2, "y") for d in data], PAGE).repartition(3)


def canonical(url):
    return f'<html><head><LINK rel="canonical" href="{url}"></head></html>'


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://x.com/de", "x.com", "/de", None, "allow"),
        ("http://notorg/", "notorg", "/", None, "allow"),
        ("http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
        ("http://org?x=/", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("x://é.net/É?", "é.net", "/É", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = urls.url_verdicts(pages(spark, [(1, url, None)])).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_aliases(spark):
    data = [
        (1, "http://a.net/1", canonical("http://x.com/de/9")),  # points to a blocked url
        (2, "http://a.net/2", canonical("/1")),  # points to 1, and so is blocked too
        (3, "http://a.net/3", '<meta http-equiv="refresh" content="0; url=http://b.org/ok">'),  # to an allowed one
        (4, "http://a.net/4", canonical("http://a.net/3")),
        (5, "http://a.net/5", canonical("http://x.com/de/8")),
        (6, "http://a.net/6", canonical("http://a.net/5")),
        (7, "http://x.org/7", canonical("http://a.net/6")),  # an allowed alias takes precedence
        (8, "http://a.net/8", "<p>no link</p>"),
        (9, "http://x.com/de/8", None),  # its own rule stands
        (10, "http://a.net/1?again", None),  # another page than 1
        (None, "http://a.net/2#x", None),
        (10, "http://a.net/dir/10", canonical("11")),
        (11, "http://a.net/dir/11", canonical("//x.com/de/7")),
    ]
    got = sorted((str(r["page_id"]), r["path"], r["verdict"]) for r in urls.url_verdicts(pages(spark, data)).collect())
    expected = [("1", "/1", "block"), ("2", "/2", "block"), ("3", "/3", "allow"), ("4", "/4", "allow"), ("5", "/5", "allow"), ("6", "/6", "allow"), ("7", "/7", "allow"), ("8", "/8", "allow"), ("9", "/de/8", "block"), ("10", "/1", "allow"), ("None", "/2", "block"), ("10", "/dir/10", "block"), ("11", "/dir/11", "block")]
    assert got == sorted(expected)


def test_links_to_no_page_and_other_pages(spark):
    """Verdicts go to the very page that a link names, and never through urls that name none."""
    bad = "http://x.com/de/9"
    data = [
        (1, "no scheme", canonical(bad)),  # names no page
        (2, "also none", None),
        (3, None, canonical(bad)),
        (4, None, None),
        (5, "http://forum.net/view?id=1", canonical(bad)),
        (6, "http://forum.net/view?id=2", None),  # another query, another page
        (7, "HTTP://Forum.net/view?id=1#top", None),  # the page of 5
        (8, "http://c.net/a/b", canonical("?x=1")),  # c.net/a/b?x=1
        (9, "http://c.net/a/", None),
        (10, "http://c.net/a/b?x=1", canonical(bad)),
        (11, "http://c.net/x/y/z", canonical("../../de/../q/./r")),  # c.net/q/r
        (12, "http://c.net/q/r", canonical(bad)),
        (13, "http://d.net/1", f'<link title="a" rel="nofollow Canonical" href=\'{bad}\'>'),
        (14, "http://d.net/2", f'<!-- <link rel="canonical" href="{bad}"> -->'),
        (15, "http://d.net/3", '<link rel="canonical" href="http://d.net/s?a=1&amp;b=2">'),
        (16, "http://d.net/s?a=1&b=2", canonical(bad)),
        (17, "http://d.net/5", canonical("mailto:x@x.com/de/")),
        (18, "http://d.net/6", '<link rel="canonical-not" href="http://x.com/de/1"><link rel=alternate href=/7>'),
        (19, "http://d.net", canonical(bad)),
        (20, "http://d.net/", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages(spark, data)).collect()}
    assert {k for k, v in got.items() if v == "block"} == {5, 7, 8, 10, 11, 12, 13, 15, 16, 19, 20}


@pytest.mark.parametrize("base", ["http://a.b/c/d/e?q#f", "https://A.b", "http://a.b/", "http://a.b/x/../y"])
def test_resolving(spark, base):
    from urllib.parse import urldefrag, urljoin

    from pyspark.sql import functions as F

    refs = ["g", "./g", "g/", "/g", "//h/i", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../../g", "../../../../g", "./../g", "./g/.", "g/./h", "g/../h", "/./g", "/../g", "http://z/a/b?c", "g;x=1/../y", "../..", "."]
    rows = spark.createDataFrame([(base, r) for r in refs], "base string, ref string").select("ref", urls.page_node(urls.resolved(F.col("base"), F.col("ref"))).alias("got"))
    node = lambda u: u if "/" in u.split("://")[1] else u.replace("?", "/?") if "?" in u else u + "/"
    for r in rows.collect():
        want = urldefrag(urljoin(base, r["ref"]))[0]
        scheme, rest = want.split("://")
        host = rest.split("/")[0].split("?")[0]
        if r["ref"] in ("?y", "#s") and "/../" in base:
            continue  # a base with dots of its own: urljoin leaves them, as the page's own url is taken
        assert r["got"] == node(f"{scheme}://{host.lower()}{rest[len(host):]}"), r["ref"]


def test_given_edges_and_empty(spark):
    edges = spark.createDataFrame([("http://a.net/1", "http://x.com/de/1")], "src string, dst string")
    assert urls.url_verdicts(pages(spark, [(1, "http://a.net/1", None)]), edges=edges).first()["verdict"] == "block"
    assert urls.url_verdicts(spark.createDataFrame([], PAGE)).count() == 0


def brute(data):
    out = []
    for i, _, html in data:
        raw = (html or "").encode()
        ids = [j for j, _, h in data if (h or "") == (html or "") and j is not None]
        first = min(ids, default=None)
        revisit = first is not None and (i is None or i > first)
        out.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def page_rows():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["<p>", "the", "and", "of", "é", "\r\n\r\n"]) for _ in range(rng.randrange(1, 400))) for _ in range(30)]
    return [(i, f"http://x/{i}\n", rng.choice(texts)) for i in range(120)] + [(200, None, None), (201, "", ""), (None, "u", ""), (None, "u", "only null"), (202, "big", "long text " * 300_000), (203, "dup", "twice"), (203, "dup", "twice")]


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_round_trip(spark, size):
    data = page_rows()
    got = warc.archive_round_trip(pages(spark, data), archive_bytes=size).collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(data)
    assert all(r["payload"].decode() in {h or "" for i, _, h in data if i == r["page_id"]} for r in got if r["record_type"] == "response")
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_hot_payload_and_hot_alias(spark):
    """One payload, and one page of an alias, hold most rows."""
    data = [(i, "http://a.net/1" if i % 3 else f"http://b.net/{i}", canonical("http://x.com/de/1") if i % 3 else f"only {i}") for i in range(300)]
    got = warc.archive_round_trip(pages(spark, data)).collect()
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(data)
    found = urls.url_verdicts(pages(spark, data)).collect()
    assert len(found) == 300 and all((r["verdict"] == "block") == (r["page_id"] % 3 > 0) for r in found)


def test_small_payloads_are_all_responses(spark):
    data = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y" * 50), (4, "d", "y" * 50)]
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(pages(spark, data), least_bytes=10).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archive_has_its_dictionary_in_front():
    records = [warc.record(i, f"http://x/{i}", (f"<html><body>number {i} " + "of the usual pages " * 20).encode(), None, "response") for i in range(400)]
    data = warc.pack_archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_archive(data)) == records
    assert len(data) < sum(map(len, records)) / 2
    for few in (records[:1], [b""], [b"x"], [warc.TRAINED_MAGIC + b"abc"], [b"ab" * 9] * 3):
        small = warc.pack_archive(few)
        assert small[:4] == data[:4] and list(warc.read_archive(small)) == few
    with pytest.raises(Exception):
        list(warc.read_archive(data[:-5]))
