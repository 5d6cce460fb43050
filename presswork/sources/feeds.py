"""Landed feed files: RSS items and Atom entries as articles, and the feeds that failed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import published_or_now, strip_html, trim_ws
from ..operators.skew import package_on_workers

RSS = "title string, link string, description string, pubDate string, isoDate string, content string, _corrupt_record string"
ATOM = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string, _corrupt_record string"
#: Where a file lies says which run landed it, and from which feed.
PLACE = r"run=([^/]+)/feed=(\d+)/"
#: Comments, CDATA sections that end before the next one opens, and the tags that open and close items.
_TOKENS = re.compile(r"<!--.*?-->|<!\[CDATA\[(?:(?!<!\[CDATA\[).)*?\]\]>|<(/?)(item|entry)(?=[\s/>])[^>]*?(/?)>", re.S)
_ENCODING = re.compile(rb"""^\s*<\?xml[^>]*\bencoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
ELEMENTS = "file string, bytes long, blank boolean, nth int, tag string, item string, closed boolean"


def decoded(content: bytes) -> str:
    """The text of a feed file, by its byte order mark or its XML declaration, else as UTF-8; bad bytes are replaced."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(encoding, "replace")
    told = _ENCODING.match(content[:200])
    try:
        return content.decode(told.group(1).decode() if told else "utf-8", "replace")
    except LookupError:  # an encoding that does not exist
        return content.decode("utf-8", "replace")


def split_items(text: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, text, closed) of each item and entry, in order.

    Tags inside comments and CDATA are text. An element ends where it closes; one that another opens in, or that the
    file ends in, is not closed. A CDATA section or comment that never ends is text too, so it holds up no other item.
    """
    opened = None
    for m in _TOKENS.finditer(text):
        close, tag, alone = m.groups()
        if tag is None:
            continue
        if opened and not close:
            yield opened[0], text[opened[1] : m.start()], False
            opened = None
        if alone and not close:
            yield tag, m.group(), True
        elif not close:
            opened = tag, m.start()
        elif opened and opened[0] == tag:
            yield tag, text[opened[1] : m.end()], True
            opened = None
    if opened:
        yield opened[0], text[opened[1] :], False


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ELEMENTS.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.bool_())
    for b in batches:
        for file, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
            text = decoded(content or b"")
            head = (file, len(content or b""), not text.strip())
            found = [(*head, k, *x) for k, x in enumerate(split_items(text))] or [(*head, None, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)


def feed_elements(spark: SparkSession, path: str) -> DataFrame:
    """Every item and entry of all files beneath path: file, bytes, blank, nth, tag, item, closed; one row with a null nth for
    a file without any. Spark reads the files, from whatever store, a file a row, and a feed's file is small; tasks
    split them, so no line or block border cuts an item."""
    package_on_workers(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_split, ELEMENTS)


def _article(title: Column, url: Column, snippet: Column, published: Column, now_s: int) -> list[Column]:
    empty = F.lit("")
    return [
        trim_ws(F.coalesce(title, empty)).alias("title"),
        trim_ws(F.coalesce(url, empty)).alias("url"),
        strip_html(F.coalesce(snippet, empty)).alias("snippet"),
        published_or_now(published, F.lit(now_s)).cast("bigint").alias("published_s"),
    ]


def link_to(links: Column) -> Column:
    """The address that an Atom entry's links give: the first alternate one (which one without a rel is), else the first."""
    other = F.filter(links, lambda x: x["_href"].isNotNull() & (F.lower(F.coalesce(x["_rel"], F.lit("alternate"))) == "alternate"))
    return F.coalesce(F.get(other, F.lit(0))["_href"], F.get(F.filter(links, lambda x: x["_href"].isNotNull()), F.lit(0))["_href"])


def _parsed(elements: DataFrame, tag: str, schema: str) -> DataFrame:
    r = F.from_xml("item", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    x = elements.where(F.col("tag") == tag).withColumn("r", F.when(F.col("closed"), r))
    good = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    return x.select("file", "nth", good.alias("good"), F.when(~good, F.col("item")).alias("record"), F.when(good, F.col("r")).alias("r"))


def rss_articles(elements: DataFrame, now_s: int) -> DataFrame:
    """file, nth, good, record and the article of every item; see feed_records."""
    of = _article(F.col("r.title"), F.col("r.link"), F.coalesce("r.description", "r.content"), F.coalesce("r.isoDate", "r.pubDate"), now_s)
    return _parsed(elements, "item", RSS).select("file", "nth", "good", "record", *of)


def atom_articles(elements: DataFrame, now_s: int) -> DataFrame:
    """As rss_articles, for Atom entries."""
    of = _article(F.col("r.title"), link_to(F.col("r.link")), F.coalesce("r.summary", "r.content"), F.coalesce("r.published", "r.updated"), now_s)
    return _parsed(elements, "entry", ATOM).select("file", "nth", "good", "record", *of)


def feed_records(elements: DataFrame, now_s: int) -> DataFrame:
    """Every item and entry of feed_elements as an article with file and nth; good is false for one that cannot be parsed,
    whose text is in record. One bad item does not hold up the others."""
    return rss_articles(elements, now_s).unionByName(atom_articles(elements, now_s))


def read_feeds(spark: SparkSession, path: str, now_s: int) -> DataFrame:
    """The items and entries of all files beneath path that could be read, with the place of each: file, nth."""
    return feed_records(feed_elements(spark, path), now_s).where("good").drop("good", "record")


def _escaped(c: Column) -> Column:
    for what, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(what), F.lit(by))
    return c


def rss_item(title: Column, link: Column, description: Column) -> Column:
    """One RSS item as a line of text, without line breaks."""
    return F.concat(F.lit("<item><title>"), _escaped(title), F.lit("</title><link>"), _escaped(link), F.lit("</link><description>"), _escaped(description), F.lit("</description></item>"))


def atom_entry(title: Column, link: Column, summary: Column) -> Column:
    """One Atom entry as a line of text, with a link to edit it beside the one to read it."""
    edit = F.concat(F.lit('"/><link rel="edit" href="'), _escaped(link), F.lit('/edit"/><summary>'))
    return F.concat(F.lit("<entry><title>"), _escaped(title), F.lit('</title><link href="'), _escaped(link), edit, _escaped(summary), F.lit("</summary></entry>"))


def placed(rows: DataFrame) -> DataFrame:
    """rows with run_id and feed_ord of their file; rows of files elsewhere have null."""
    of = lambda k: F.nullif(F.regexp_extract("file", PLACE, k), F.lit(""))
    return rows.withColumn("run_id", of(1)).withColumn("feed_ord", of(2).cast("int"))


def with_feed(items: DataFrame, dim_feed: DataFrame) -> DataFrame:
    """Items with topic and source of their feed."""
    return placed(items).join(F.broadcast(dim_feed.select("topic", "source", "feed_ord")), "feed_ord")


def landing_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, feed_ord, file, bytes) of every file beneath path that has bytes, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return placed(files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))).select("run_id", "feed_ord", "file", "bytes")


def feed_failures(planned: DataFrame, manifest: DataFrame, elements: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, feed_ord, files, items, failed, reason) of each planned (run_id, feed_ord), which is a feed that some
    reader asked for.

    items and failed count what its files hold; failed items do not hold up the others. reason says why the feed gave
    nothing, null if it gave some: missing (no file landed, or only files of no bytes, which Spark's readers pass over),
    empty (no file with text), no items, or unreadable (none of its items could be parsed).
    """
    files = manifest.groupBy("run_id", "feed_ord").agg(F.count("*").alias("files"))
    text = placed(elements).groupBy("run_id", "feed_ord").agg(F.bool_or(~F.col("blank")).alias("has_text"))
    items = placed(records).groupBy("run_id", "feed_ord").agg(F.count("*").alias("items"), F.count_if(~F.col("good")).alias("failed"))
    x = planned.select("run_id", "feed_ord").distinct()
    for part in (files, text, items):
        x = x.join(part.hint("merge"), ["run_id", "feed_ord"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    reason = F.when(count("files") == 0, "missing").when(~F.coalesce("has_text", F.lit(False)), "empty").when(count("items") == 0, "no items").when(F.col("items") == F.col("failed"), "unreadable")
    return x.select("run_id", "feed_ord", *(count(c).alias(c) for c in ("files", "items", "failed")), reason.alias("reason"))


def dead_feed_report(failures: DataFrame) -> DataFrame:
    """For each run the feeds that it planned, those that gave nothing, and how many of these for each reason."""
    told = {"missing": "missing", "empty": "empty", "no items": "without_items", "unreadable": "unreadable"}
    reasons = [F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(name) for r, name in told.items()]
    return failures.groupBy("run_id").agg(F.count("*").alias("planned"), F.count("reason").alias("dead"), *reasons)
