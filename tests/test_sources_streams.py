"""Files, logs, snapshots and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork.operators.ingest import first_sighting
from presswork.plans import dims
from presswork.sources import commits, events, feeds, logs
from presswork.streaming import streams


def land(tmp_path, run, feed, content, name="a.xml"):
    folder = tmp_path / f"run={run}" / f"feed={feed}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_rss_and_atom(spark, tmp_path):
    rss = "<rss><channel><item><title> A &amp; B </title><link>https://x/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Fri, 31 Jul 2026 12:00 GMT</pubDate></item><item><title>C</title></item></channel></rss>"
    atom = '<feed><entry><title>D</title><link href="https://x/2"/><summary>s</summary><published>2026-07-31T12:00:00Z</published></entry></feed>'
    land(tmp_path, "r", 1, rss)
    land(tmp_path, "r", 2, atom)
    got = feeds.with_feed(feeds.read_feeds(spark, str(tmp_path), 7), dims.dim_feed(spark)).orderBy("title").collect()
    assert [(r["title"], r["url"], r["snippet"], r["published_s"], r["source"], r["nth"]) for r in got] == [("A & B", "https://x/1", "Hi", 1785499200, "BBC", 0), ("C", "", "", 7, "BBC", 1), ("D", "https://x/2", "s", 1785499200, "TechCrunch", 0)]


@pytest.mark.parametrize(
    "links, url",
    [
        ('<link rel="alternate" href="a"/><link rel="edit" href="e"/>', "a"),
        ('<link rel="edit" href="e"/><link rel="ALTERNATE" href="a"/>', "a"),
        ('<link rel="self" href="s"/><link href="plain"/>', "plain"),
        ('<link rel="self" href="s"/><link rel="edit" href="e"/>', "s"),
        ('<link rel="alternate"/><link rel="self" href="s"/>', "s"),
        ("", ""),
    ],
)
def test_atom_links(spark, tmp_path, links, url):
    land(tmp_path, "r", 1, f'<feed><entry><title type="html">T</title>{links}<updated>2026-07-31T12:00:00Z</updated></entry></feed>')
    assert [(r["title"], r["url"], r["published_s"]) for r in feeds.read_feeds(spark, str(tmp_path), 7).collect()] == [("T", url, 1785499200)]


@pytest.mark.parametrize(
    "text, items",
    [
        ("<item>a</item><items>x</items><item x='1'>b</item>", [("item", "<item>a</item>", True), ("item", "<item x='1'>b</item>", True)]),
        ("<item><![CDATA[ <item>no</item> ]]></item>", [("item", "<item><![CDATA[ <item>no</item> ]]></item>", True)]),
        ("<!-- <item> --><entry>a<!-- </entry> --></entry>", [("entry", "<entry>a<!-- </entry> --></entry>", True)]),
        ("<item/><entry />", [("item", "<item/>", True), ("entry", "<entry />", True)]),
        ("<item>a<item>b</item>", [("item", "<item>a", False), ("item", "<item>b</item>", True)]),
        ("<item>a</entry></item></item>", [("item", "<item>a</entry></item>", True)]),
        ("<item><![CDATA[ a</item><item><![CDATA[b]]></item>", [("item", "<item><![CDATA[ a</item>", True), ("item", "<item><![CDATA[b]]></item>", True)]),
        ("<item>a<!-- b</item><item>c</item>", [("item", "<item>a<!-- b</item>", True), ("item", "<item>c</item>", True)]),
        ("x<item>cut", [("item", "<item>cut", False)]),
        ("", []),
    ],
)
def test_splitting(text, items):
    assert list(feeds.split_items(text)) == items


def test_encodings():
    assert feeds.decoded('<?xml version="1.0" encoding="ISO-8859-1"?>é'.encode("latin-1")).endswith("é")
    assert feeds.decoded(b"\xef\xbb\xbfa") == "a" and feeds.decoded("é".encode("utf-16")) == "é"
    assert feeds.decoded(b"<?xml encoding='nope'?>\xc3\xa9").endswith("é") and feeds.decoded(b"\xff") == "\ufffd"


def test_feeds_that_fail(spark, tmp_path):
    good = "<item><title>{0}</title><link>https://{0}/1</link><description>d</description></item>"
    land(tmp_path, "r", 1, "<rss><channel>" + good.format("a") + "<item><title>b</title><link>https://b/1</link><description>never ends</item>\n" + good.format("c") + "</channel></rss>")
    land(tmp_path, "r", 1, "<rss><channel><item><title>e <![CDATA[ <item> ]]></title></item>", "b.xml")
    land(tmp_path, "r", 2, "<rss><channel><item><title>x</title><link>https://x/1</link>")
    land(tmp_path, "r", 3, "<rss><channel></channel></rss>")
    land(tmp_path, "r", 4, b"")
    land(tmp_path, "r", 5, " \n")
    land(tmp_path, "s", 1, good.format("z"))
    land(tmp_path, "s", 9, good.format("nobody asked"))
    elements = feeds.feed_elements(spark, str(tmp_path))
    records = feeds.feed_records(elements, 7)
    assert sorted((r["good"], r["title"]) for r in records.collect()) == [(False, ""), (False, ""), (True, "a"), (True, "c"), (True, "e  <item>"), (True, "nobody asked"), (True, "z")]
    planned = spark.createDataFrame([(r, f) for r in "rs" for f in range(1, 7)] * 2, "run_id string, feed_ord int")
    failures = feeds.feed_failures(planned, feeds.landing_manifest(spark, str(tmp_path)), elements, records)
    got = {(r["run_id"], r["feed_ord"]): (r["files"], r["items"], r["failed"], r["reason"]) for r in failures.collect()}
    missing = (0, 0, 0, "missing")
    assert got == {("r", 1): (2, 4, 1, None), ("r", 2): (1, 1, 1, "unreadable"), ("r", 3): (1, 0, 0, "no items"), ("r", 4): missing, ("r", 5): (1, 0, 0, "empty"), ("r", 6): missing, ("s", 1): (1, 1, 0, None)} | {("s", f): missing for f in range(2, 7)}
    report = {r["run_id"]: tuple(r)[1:] for r in feeds.dead_feed_report(failures).collect()}
    assert report == {"r": (6, 5, 2, 1, 1, 1), "s": (6, 5, 5, 0, 0, 0)}


def test_logs(spark):
    lines = spark.createDataFrame(
        [
            ("[usage] triage small in=834 out=71 cache_r=0 cache_w=0 $0.001189",),
            ("[usage] ranking large no usage reported",),
            ('[triage] Tech/AI — PASS (severity 4) — "A — B" — because',),
            ('[triage] Morocco — reject — "C"',),
            ("[digest] Geopolitics: kept 8 of 11 notable — dropped 3 at severity 2, 2, 1",),
            (" POST /api/digest 200 in 49s",),
            (" GET /topic/x 200 in 319ms",),
            ("noise",),
        ],
        "value string",
    )
    assert [tuple(r) for r in logs.parse_usage_log(lines).select("stage", "model", "input", "usd", "measured").collect()] == [("triage", "small", 834, 0.001189, True), ("ranking", "large", None, None, False)]
    assert [tuple(r) for r in logs.parse_verdict_log(lines).collect()] == [("Tech/AI", True, 4, "A — B", "because"), ("Morocco", False, None, "C", "")]
    assert [tuple(r) for r in logs.parse_cut_log(lines).collect()] == [("Geopolitics", 8, 11, 3, [2, 2, 1])]
    assert [r["ms"] for r in logs.parse_http_log(lines).collect()] == [49000, 319]


def test_progress_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_id":1,"seq":1,"stage":"ingest"}\n\n{"run_id":1,"seq":2,"stage":"done"}\n{"run_id":1,"se')
    e = events.read_progress_events(spark, str(tmp_path))
    assert [(r["run_id"], r["stage"]) for r in streams.run_progress(e).collect()] == [(1, "done")]
    events.write_progress_events(e, str(tmp_path / "out"))
    assert events.read_progress_events(spark, str(tmp_path / "out")).count() == 2


def test_snapshots_and_partitions(spark, tmp_path):
    base = str(tmp_path / "snap")
    assert commits.write_snapshot(spark, base, {"t": spark.range(3)}) == 0
    old = commits.read_snapshot(spark, base, "t")
    assert commits.write_snapshot(spark, base, {"t": spark.range(5), "u": spark.range(1)}) == 1
    assert (old.count(), commits.read_snapshot(spark, base, "t").count()) == (3, 5)
    path = str(tmp_path / "parts")
    events.write_table(spark.range(4).withColumn("day", F.col("id") % 2), path, ["day"])
    events.write_table(spark.range(9).withColumn("day", F.lit(1)), path, ["day"])
    assert {r["day"]: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()} == {0: 2, 1: 9}


def test_stream_matches_batch(spark, tmp_path):
    start = dt.datetime(2026, 7, 31)
    rows = [("u", f"https://x/{i % 5}", i, start + dt.timedelta(minutes=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id string, url string, pos long, published_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.stream_new_articles(stream).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["url"] for r in spark.table("fresh").collect()}
    assert got == {r["url"] for r in first_sighting(df, ["pos"]).collect()} and spark.table("fresh").count() == 5


def test_late_rows_are_saved(spark):
    saved = []
    late = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(2026, 7, 1),)], "published_at timestamp")
    streams.late_articles_sink(lambda df, k: saved.append((df.count(), k)), 1780000000)(late, 3)
    assert saved == [(1, 3)]


def test_card_state(spark, tmp_path):
    rows = [(1, "insert", 2), (1, "update", None), (2, "insert", None), (2, "update", 3), (3, "update", 1)]
    df = spark.createDataFrame(rows, "id long, kind string, rank long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.card_state(stream).writeStream.format("memory").queryName("cards_now").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["id"], r["front_page_rank"], r["updates"]) for r in spark.table("cards_now").collect()) == [(1, None, 1), (2, 3, 1)]
