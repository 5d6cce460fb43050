"""Queries of the operators over the model views, with SQL oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import article_text, cluster_context, strip_html, trim_ws, valid_date, valid_uuid
from ..operators import edition, ingest, quality, reads, stories, story_state, tables, triage, usage
from ..operators.vectors import banded_pairs
from ..sources import commits, events, feeds, layout, logs
from ..streaming import streams
from . import dims, jobs
from .bridge import NOW_S, Model, oracle
from .expr_queries import ATTEMPTS, _trim

Q: dict = {}
SQL: dict[str, str] = {}
TODAY_S = 893980800  # a month start inside the orders' range


def query(sql: str | None):
    def register(f):
        Q[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


def _judged(m):
    return triage.align_verdicts(m["clusters"], m["verdicts"])


JUDGED = "judged AS (SELECT c.*, coalesce(v.notable, FALSE) AS notable, coalesce(v.severity, 1) AS severity FROM clusters c LEFT JOIN verdicts v USING (cluster_pos))"
BATCHES = "nums AS (SELECT run_id, topic, cluster_pos, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id, topic) AS n FROM clusters WINDOW w AS (PARTITION BY run_id, topic ORDER BY cluster_pos)), bat AS (SELECT *, (n + 19) // 20 AS b FROM nums), batches AS (SELECT run_id, topic, cluster_pos, CASE WHEN i < (n % b) * (n // b + 1) THEN i // (n // b + 1) ELSE n % b + (i - (n % b) * (n // b + 1)) // (n // b) END AS batch FROM bat)"


# ---- 2.1 sources and sinks
N_FEEDS = len(dims.FEEDS)
LANDED = f"land AS (SELECT *, concat('r', CAST(page_id % 3 AS VARCHAR)) AS run_id, CAST(page_id // 3 % {N_FEEDS} AS INTEGER) AS feed_ord, html LIKE '%</html>' AS whole FROM feed_items), lit AS (SELECT * FROM land WHERE feed_ord % 10 NOT IN (3, 4, 5))"
PLANNED = "plan AS (SELECT DISTINCT feed_ord FROM user_topics u JOIN dim_feed f USING (topic) WHERE EXISTS (SELECT 1 FROM user_sources s WHERE s.user_id = u.user_id AND s.source = f.source))"


def _landed(m):
    """The pages as the feed files of three runs, an item a page, of every second feed an Atom entry.

    A page that was cut off gives an item whose text never ends. Whole ones hold an item in a CDATA section, or stand
    behind one in a comment. Of ten feeds one lands nothing, one a blank file, and one a file without items.
    """
    title, body = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1)
    link, feed = F.coalesce("url", F.lit("")), (F.floor(F.col("page_id") / 3) % N_FEEDS).cast("int")
    item = F.when(feed % 2 == 0, feeds.rss_item(title, link, body)).otherwise(feeds.atom_entry(title, link, body))
    ends = F.regexp_replace(item, "</(description></item|summary></entry)>$", "")
    cut = F.concat(ends, F.when(feed % 2 == 0, "</item>").otherwise("</entry>"))
    quoted = F.concat(ends, F.lit("<![CDATA[ <item><title>no item</title></item> <entry/> ]]>"), F.when(feed % 2 == 0, "</description></item>").otherwise("</summary></entry>"))
    behind = F.concat(F.lit("<!-- <item><title>no item</title></item> <entry> -->"), item)
    line = F.when(~F.col("html").endswith("</html>"), cut).when(F.col("page_id") % 2 == 0, quoted).otherwise(behind)
    line = F.when(feed % 10 == 4, " ").when(feed % 10 == 5, "<rss><channel><title>nothing new</title></channel></rss>").otherwise(line)
    path = f"{stories.shared_folder(m.spark)}/feeds-{uuid.uuid4().hex}"
    rows = m["feed_items"].select(line.alias("value"), F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("run"), feed.alias("feed"))
    rows.where("feed % 10 <> 3").repartition("run", "feed").write.partitionBy("run", "feed").text(path)
    return path


@query("WITH " + LANDED + " SELECT run_id, feed_ord, url, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM lit WHERE whole")
def read_feed_items(m):
    return feeds.placed(feeds.read_feeds(m.spark, _landed(m), NOW_S)).select("run_id", "feed_ord", "url", "title")


def _failures(m):
    path = _landed(m)
    elements = stories.written(feeds.feed_elements(m.spark, path))
    plan = ingest.feed_plan(m["user_topics"], m["user_sources"], m["dim_feed"], m["dim_topic"]).select("feed_ord").distinct()
    planned = plan.withColumn("run_id", F.explode(F.array(*(F.lit(f"r{k}") for k in range(3)))))
    return feeds.feed_failures(planned, feeds.landing_manifest(m.spark, path), elements, feeds.feed_records(elements, NOW_S))


FAILURES = f"{LANDED}, {PLANNED}, runs AS (SELECT unnest(['r0', 'r1', 'r2']) AS run_id), told AS (SELECT run_id, feed_ord, count(*) AS items, count(*) FILTER (WHERE NOT whole) AS failed FROM lit GROUP BY 1, 2), sent AS (SELECT DISTINCT run_id, feed_ord FROM land WHERE feed_ord % 10 <> 3), fails AS (SELECT runs.run_id, plan.feed_ord, CASE WHEN sent.feed_ord IS NULL THEN 0 ELSE 1 END AS files, coalesce(items, 0) AS items, coalesce(failed, 0) AS failed, CASE WHEN sent.feed_ord IS NULL THEN 'missing' WHEN plan.feed_ord % 10 = 4 THEN 'empty' WHEN plan.feed_ord % 10 = 5 THEN 'no items' WHEN items = failed THEN 'unreadable' END AS reason FROM plan CROSS JOIN runs LEFT JOIN told ON told.feed_ord = plan.feed_ord AND told.run_id = runs.run_id LEFT JOIN sent ON sent.feed_ord = plan.feed_ord AND sent.run_id = runs.run_id)"


@query("WITH " + FAILURES + " SELECT run_id, feed_ord, CAST(files AS BIGINT) AS files, items, failed, reason FROM fails")
def feed_failures(m):
    return _failures(m)


@query("WITH " + FAILURES + " SELECT run_id, count(*) AS planned, count(reason) AS dead, count(*) FILTER (WHERE reason = 'missing') AS missing, count(*) FILTER (WHERE reason = 'empty') AS empty, count(*) FILTER (WHERE reason = 'no items') AS without_items, count(*) FILTER (WHERE reason = 'unreadable') AS unreadable FROM fails GROUP BY run_id")
def dead_feed_report(m):
    return feeds.dead_feed_report(_failures(m))


@query("SELECT user_id, topic, source, url, feed_ord, ord AS topic_ord FROM (SELECT DISTINCT user_id, topic FROM user_topics) u JOIN dim_feed f USING (topic) JOIN dim_topic t USING (topic) WHERE EXISTS (SELECT 1 FROM user_sources s WHERE s.user_id = u.user_id AND s.source = f.source)")
def feed_plan(m):
    out = ingest.feed_plan(m["user_topics"], m["user_sources"], m["dim_feed"], m["dim_topic"])
    return out.select("user_id", "topic", "source", "url", "feed_ord", "topic_ord")


@query("SELECT id, digest_id, severity FROM cards WHERE severity <> 5 OR id % 2 = 0")
def table_sink(m):
    """All cards by severity, then one partition replaced."""
    path = f"{stories.shared_folder(m.spark)}/cards-{uuid.uuid4().hex}"
    c = m["cards"].select("id", "digest_id", "severity")
    events.write_table(c, path, ["severity"])
    events.write_table(c.where("severity = 5 AND id % 2 = 0"), path, ["severity"])
    return m.spark.read.parquet(path).select("id", "digest_id", F.col("severity").cast("int").alias("severity"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def scan_table(m):
    return m.table("orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("SELECT digest_id, id, topic, coalesce(title, '') AS title, severity, published_s, CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END AS n_labels FROM cards")
def explode_cards_json(m):
    c = m["cards"]
    labels = F.when(F.col("id") % 3 != 0, F.array("topic", F.lit("x")))
    one = F.struct("id", "topic", F.coalesce("title", F.lit("")).alias("title"), "severity", "published_s", labels.alias("labels"))
    runs = c.groupBy("digest_id").agg(F.to_json(F.collect_list(one)).alias("cards_json"))
    out = tables.explode_cards_json(runs)
    return out.select("digest_id", "id", "topic", "title", "severity", "published_s", F.size("labels").alias("n_labels"))


@query("SELECT run_id, seq, stage, at_s FROM progress WHERE seq % 10 <> 3")
def read_progress_events(m):
    lines = events.progress_lines(m["progress"])
    seq = F.get_json_object("value", "$.seq").cast("bigint")
    cut = F.when(seq % 10 == 3, F.substring("value", 1, 9)).otherwise(F.col("value"))
    return events.parse_progress_lines(lines.select(cut.alias("value"))).select("run_id", "seq", "stage", "at_s")


@query("""SELECT seq, '{"run_id":' || run_id || ',"seq":' || seq || ',"stage":"' || stage || '","at_s":' || at_s || '}' AS line FROM progress""")
def write_progress_events(m):
    x = m["progress"]
    return x.select("seq", F.to_json(F.struct("run_id", "seq", "stage", "at_s")).alias("line"))


@query("SELECT at_s, run_id, stage, model, CASE WHEN measured THEN input END AS input, CASE WHEN measured THEN output END AS output, measured FROM usage_calls")
def parse_capture_log(m):
    c = F.col
    full = F.format_string("[usage] %s %s in=%d out=%d cache_r=%d cache_w=%d $0.001", c("stage"), c("model"), c("input"), c("output"), c("cache_read"), c("cache_write"))
    none = F.format_string("[usage] %s %s no usage reported", c("stage"), c("model"))
    lines = m["usage_calls"].select("at_s", "run_id", F.when(c("measured"), full).otherwise(none).alias("value"))
    return logs.parse_usage_log(lines).select("at_s", "run_id", "stage", "model", "input", "output", "measured")


@query("SELECT c.cluster_pos, c.topic, v.notable, CASE WHEN v.notable THEN v.severity END AS severity, concat('t — ', CAST(c.cluster_pos AS VARCHAR)) AS title FROM clusters c JOIN verdicts v USING (cluster_pos)")
def parse_verdict_log(m):
    x = m["clusters"].join(m["verdicts"], "cluster_pos")
    verdict = F.when(F.col("notable"), F.format_string("PASS (severity %d)", F.col("severity"))).otherwise("reject")
    line = F.concat(F.lit("[triage] "), "topic", F.lit(" — "), verdict, F.lit(' — "t — '), F.col("cluster_pos").cast("string"), F.lit('" — because'))
    return logs.parse_verdict_log(x.select("cluster_pos", line.alias("value"))).select("cluster_pos", "topic", "notable", "severity", "title")


@query("WITH " + JUDGED + ", n AS (SELECT run_id, topic, severity, row_number() OVER (PARTITION BY run_id, topic ORDER BY severity DESC, cluster_pos) AS rn FROM judged WHERE notable) SELECT run_id, topic, CAST(8 AS INTEGER) AS kept, CAST(count(*) AS INTEGER) AS total, CAST(count(*) - 8 AS INTEGER) AS dropped, string_agg(CAST(severity AS VARCHAR), ',' ORDER BY severity DESC) FILTER (WHERE rn > 8) AS severities FROM n GROUP BY run_id, topic HAVING count(*) > 8")
def parse_cut_log(m):
    c = edition.topic_cuts(_judged(m))
    told = F.format_string("[digest] %s: kept 8 of %d notable — dropped %d at severity %s", F.col("topic"), F.col("total"), F.col("dropped"), F.array_join(F.transform("severities", lambda s: s.cast("string")), ", "))
    out = logs.parse_cut_log(c.select("run_id", told.alias("value")))
    return out.select("run_id", "topic", "kept", "total", "dropped", F.array_join(F.transform("severities", lambda s: s.cast("string")), ",").alias("severities"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, concat('/api/', event_type) AS path, CAST(200 AS INTEGER) AS status, CASE WHEN event_id % 3 = 0 THEN (event_id % 60) * 1000 ELSE event_id % 900 END AS ms FROM events")
def parse_http_log(m):
    e = F.col("event_id")
    took = F.when(e % 3 == 0, F.format_string("%ds", e % 60)).otherwise(F.format_string("%dms", e % 900))
    line = F.concat(F.lit(" "), F.when(e % 2 == 0, "GET").otherwise("POST"), F.lit(" /api/"), "event_type", F.lit(" 200 in "), took)
    return logs.parse_http_log(m.table("events").select("event_id", line.alias("value")))


# ---- 2.3 filters
@query(f"WITH s AS (SELECT a.*, CASE WHEN c.cursor_s <= {NOW_S} + 300 AND c.cursor_s > {NOW_S} - 172800 THEN c.cursor_s ELSE {NOW_S} - 172800 END AS cut FROM articles a LEFT JOIN cursors c USING (user_id)) SELECT user_id, pos, published_s FROM s WHERE published_s >= cut")
def recency_cutoff(m):
    return ingest.recency_cutoff(m["articles"], m["cursors"], NOW_S).select("user_id", "pos", "published_s")


@query("SELECT a.pos, a.source FROM articles a WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id, source FROM articles WHERE pos % 3 = 0 AND source <> 'src0') s WHERE s.user_id = a.user_id AND s.source = a.source)")
def preferred_sources_only(m):
    a = m["articles"]
    chosen = a.where("pos % 3 = 0 AND source <> 'src0'").select("user_id", "source")
    return ingest.preferred_sources_only(a, chosen).select("pos", "source")


@query("SELECT id, user_id, last_generated_s FROM digests WHERE last_generated_s IS NOT NULL AND last_generated_s <= 1700000300")
def cursor_candidates(m):
    return reads.cursor_candidates(m["digests"], 1700000000).select("id", "user_id", "last_generated_s")


@query("SELECT id, date_s FROM digests WHERE date_s < 893980800 AND date_s BETWEEN 870000000 AND 890000000")
def past_dates(m):
    return m["digests"].where(F.col("date_s") < TODAY_S).where(F.col("date_s").between(870000000, 890000000)).select("id", "date_s")


@query("WITH " + JUDGED + " SELECT run_id, cluster_pos, severity FROM judged WHERE notable")
def notable_only(m):
    return _judged(m).where("notable").select("run_id", "cluster_pos", "severity")


@query("SELECT digest_id, id, front_page_rank FROM cards WHERE front_page_rank IS NOT NULL")
def front_page_only(m):
    return m["cards"].where("front_page_rank is not null").select("digest_id", "id", "front_page_rank")


@query("SELECT id, generating FROM digests WHERE NOT generating OR started_s < 893980800 - 120")
def stale_runs(m):
    return reads.stale_runs(m["digests"], TODAY_S).select("id", "generating")


@query("SELECT c.id, c.digest_id FROM cards c JOIN digests d ON d.id = c.digest_id WHERE d.user_id = 7")
def owned_rows(m):
    return reads.owned_cards(m["cards"], m["digests"], 7).select("id", "digest_id")


# ---- 2.4 joins
DAY = "day AS (SELECT c.*, d.last_generated_s, b.card_id IS NOT NULL AS bookmarked, row_number() OVER (PARTITION BY c.digest_id ORDER BY c.published_s DESC, c.id) AS place FROM cards c JOIN digests d ON d.id = c.digest_id LEFT JOIN (SELECT DISTINCT user_id, card_id FROM bookmarks) b ON b.user_id = c.user_id AND b.card_id = c.id)"


@query("WITH " + DAY + " SELECT digest_id, id, coalesce(title, '') AS title, last_generated_s, bookmarked, CAST(place AS INTEGER) AS place FROM day")
def digest_for_date(m):
    return reads.digest_for_date(m["digests"], m["cards"], m["bookmarks"]).select("digest_id", "id", "title", "last_generated_s", "bookmarked", "place")


@query("WITH " + DAY + " SELECT digest_id, id, coalesce(title, '') AS title, last_generated_s, bookmarked, CAST(place AS INTEGER) AS place FROM day WHERE date_s BETWEEN 870000000 AND 890000000")
def stored_digests(m):
    """A range of days from the stored tables, of which other days are not read."""
    prefix = f"editions_{uuid.uuid4().hex}"
    layout.store_editions(m["cards"], m["digests"], prefix, stories.shared_folder(m.spark), 4)
    cards, digests = layout.stored_editions(m.spark, prefix, 870000000, 890000000)
    return reads.digest_for_date(digests, cards, m["bookmarks"]).select("digest_id", "id", "title", "last_generated_s", "bookmarked", "place")


@query("SELECT c.id, c.user_id, EXISTS (SELECT 1 FROM bookmarks b WHERE b.user_id = c.user_id AND b.card_id = c.id) AS bookmarked FROM cards c")
def bookmark_flag(m):
    return reads.bookmark_flag(m["cards"], m["bookmarks"]).select("id", "user_id", "bookmarked")


@query("SELECT digest_id, id, severity, CAST(row_number() OVER (PARTITION BY digest_id ORDER BY severity DESC, published_s DESC, id) AS INTEGER) AS topic_place FROM cards WHERE topic = 'F'")
def topic_page(m):
    day = reads.digest_for_date(m["digests"], m["cards"], m["bookmarks"])
    return reads.topic_page(day, "F").select("digest_id", "id", "severity", "topic_place")


@query("SELECT b.user_id, b.card_id, coalesce(CAST(d.date_s AS VARCHAR), '') AS date, CAST(row_number() OVER (PARTITION BY b.user_id ORDER BY b.created_s DESC, b.card_id) AS INTEGER) AS place FROM bookmarks b JOIN cards c ON c.id = b.card_id LEFT JOIN digests d ON d.id = c.digest_id")
def saved_cards(m):
    return reads.saved_cards(m["bookmarks"], m["cards"], m["digests"]).select("user_id", "card_id", "date", "place")


@query("SELECT id, user_id FROM digests d WHERE id IN (SELECT digest_id FROM cards)")
def digest_exists(m):
    return reads.digests_with_cards(m["digests"], m["cards"]).select("id", "user_id")


_SIM = "list_sum(list_transform(list_zip(a.embedding, b.embedding), x -> CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
BEST = f"sims AS (SELECT a.id AS cluster_pos, a.topic, b.id AS card_id, {_SIM} AS sim FROM vectors a JOIN vectors b ON a.topic = b.topic AND a.id % 2 = 0 AND b.id % 2 = 1), best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY cluster_pos ORDER BY sim DESC, card_id) = 1)"


def _sides(m):
    """Every vector in one of two roles: the even ones as clusters, the odd ones as cards."""
    v = m["vectors"]
    return v.where("id % 2 = 0").select(F.col("id").alias("cluster_pos"), "topic", "embedding"), v.where("id % 2 = 1").select("id", "topic", "embedding")


@query("WITH " + BEST + " SELECT cluster_pos, topic, card_id, round(sim, 4) AS sim FROM best")
def best_existing_card(m):
    return stories.best_existing_card(*_sides(m)).withColumn("sim", F.round("sim", 4))


@query("WITH " + BEST + ", gone AS (SELECT cluster_pos FROM best WHERE sim >= 0.2 AND (cluster_pos + card_id) % 3 = 0) SELECT id AS cluster_pos, topic FROM vectors WHERE id % 2 = 0 AND id NOT IN (SELECT cluster_pos FROM gone)")
def drop_covered(m):
    clusters, cards = _sides(m)
    candidates = stories.duplicate_candidates(clusters, cards, 0.2)
    judged = candidates.select("cluster_pos", "card_id", ((F.col("cluster_pos") + F.col("card_id")) % 3 == 0).alias("same"))
    return stories.drop_covered(clusters, candidates, judged).select("cluster_pos", "topic")


@query("WITH " + BATCHES + """, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic, batch ORDER BY cluster_pos) - 1 AS k FROM batches) SELECT n.run_id, n.topic, batch, count(*) AS clusters, md5(string_agg(k || '. - ' || title || chr(10) || '  ' || substr(snippet, 1, 200), chr(10) || chr(10) ORDER BY k)) AS text FROM n JOIN clusters USING (cluster_pos) GROUP BY 1, 2, 3""")
def batch_contexts(m):
    context = cluster_context(F.array(F.struct("title", "snippet")))
    x = triage.batch_contexts(triage.triage_batches(m["clusters"].withColumn("context", context)))
    return x.withColumn("text", F.md5(F.col("text").cast("binary")))


@query("WITH " + JUDGED + " SELECT cluster_pos, notable, severity FROM judged")
def align_verdicts(m):
    return _judged(m).select("cluster_pos", "notable", "severity")


@query("SELECT id, CASE WHEN id % 10 = 1 THEN NULL WHEN id % 10 = 2 THEN 6 ELSE front_page_rank END AS front_page_rank FROM cards")
def apply_rank_updates(m):
    c = m["cards"]
    k = F.col("id") % 10
    updates = c.where(k.isin(1, 2)).select("id", F.when(k == 2, 6).cast("bigint").alias("new_rank"))
    updates = updates.unionByName(c.where("id % 500 = 0").select((-F.col("id") - 5).alias("id"), F.lit(1).cast("bigint").alias("new_rank")))
    return edition.apply_rank_updates(c, updates).select("id", "front_page_rank")


USAGE = "u AS (SELECT run_id, stage, model, count(*) FILTER (WHERE measured) AS calls, count(*) FILTER (WHERE NOT measured) AS unmeasured, CAST(coalesce(sum(input) FILTER (WHERE measured), 0) AS BIGINT) AS input, CAST(coalesce(sum(output) FILTER (WHERE measured), 0) AS BIGINT) AS output, CAST(coalesce(sum(cache_read) FILTER (WHERE measured), 0) AS BIGINT) AS cache_read, CAST(coalesce(sum(cache_write) FILTER (WHERE measured), 0) AS BIGINT) AS cache_write FROM usage_calls GROUP BY 1, 2, 3), ats AS (SELECT run_id, max(at_s) AS at_s FROM usage_calls GROUP BY 1)"
PRICED = USAGE + ", pr AS (SELECT u.*, ats.at_s, CASE model WHEN 'large' THEN 3.0 ELSE 1.0 END AS li, CASE model WHEN 'large' THEN 15.0 ELSE 5.0 END AS lo, model = 'large' AND ats.at_s >= 1767225600 AND ats.at_s < 1788220800 AS promo FROM u JOIN ats USING (run_id)), priced AS (SELECT *, (input * li + cache_write * li * 1.25 + cache_read * li * 0.1 + output * lo) / 1000000.0 AS list_usd, CASE WHEN promo THEN (input * 2.0 + cache_write * 2.0 * 1.25 + cache_read * 2.0 * 0.1 + output * 10.0) / 1000000.0 ELSE (input * li + cache_write * li * 1.25 + cache_read * li * 0.1 + output * lo) / 1000000.0 END AS billed_usd FROM pr)"


def _priced(m):
    return jobs.priced_usage(m["usage_calls"], dims.dim_price(m.spark), dims.dim_promo(m.spark))


@query("WITH " + PRICED + " SELECT run_id, stage, model, round(list_usd, 8) AS list_usd, round(billed_usd, 8) AS billed_usd, promo AND billed_usd < list_usd AS promo_applied FROM priced")
def promo_price(m):
    return _priced(m).select("run_id", "stage", "model", F.round("list_usd", 8).alias("list_usd"), F.round("billed_usd", 8).alias("billed_usd"), "promo_applied")


@query("SELECT DISTINCT u.user_id, d.source, d.ord FROM user_sources u JOIN dim_source d USING (source)")
def curated_order(m):
    d = m["dim_source"]
    return m["user_sources"].distinct().join(F.broadcast(d), "source").select("user_id", "source", "ord")


@query("SELECT t.topic, t.slug, f.source, f.url FROM dim_topic t JOIN dim_feed f USING (topic) JOIN (SELECT DISTINCT topic FROM user_topics) u USING (topic)")
def feed_dimension_join(m):
    topics = m["user_topics"].select("topic").distinct()
    return topics.join(F.broadcast(m["dim_topic"]), "topic").join(F.broadcast(m["dim_feed"].drop("feed_ord")), "topic").select("topic", "slug", "source", "url")


@query("WITH " + USAGE + ", a AS (SELECT run_id, stage, CAST(sum(calls + unmeasured) AS BIGINT) AS n FROM u GROUP BY 1, 2) SELECT e.run_id, e.stage, coalesce(a.n, 0) AS actual, CAST(e.expected AS BIGINT) AS expected, CASE WHEN coalesce(a.n, 0) > e.expected THEN 'extra' WHEN coalesce(a.n, 0) < e.expected THEN 'floor' ELSE 'equal' END AS finding FROM expected_calls e LEFT JOIN a ON a.run_id = e.run_id AND a.stage = e.stage")
def expected_vs_actual(m):
    out = usage.expected_vs_actual(m["expected_calls"], usage.usage_by_stage_model(m["usage_calls"]))
    return out.select("run_id", "stage", "actual", F.col("expected").cast("bigint").alias("expected"), "finding")


POOL = "pool AS (SELECT digest_id, id, id % 2 AS origin, row_number() OVER (PARTITION BY digest_id ORDER BY id % 2, published_s, id) - 1 AS pool_pos FROM cards)"


def _pool(m):
    c = m["cards"].select("digest_id", "id", F.col("published_s").alias("pos"))
    return edition.rank_pool(c.where("id % 2 = 0"), c.where("id % 2 = 1"))


@query("WITH " + POOL + " SELECT digest_id, id, CAST(origin AS INTEGER) AS origin, CAST(pool_pos AS INTEGER) AS pool_pos FROM pool")
def rank_pool(m):
    return _pool(m).drop("pos")


@query("WITH " + POOL + ", s AS (SELECT digest_id, count(*) AS n FROM pool GROUP BY 1) SELECT p.digest_id, p.id, CAST(CASE WHEN p.pool_pos = 0 THEN 1 WHEN p.pool_pos = 1 AND s.n > 1 THEN 3 END AS INTEGER) AS front_page_rank FROM pool p JOIN s USING (digest_id) WHERE length(p.digest_id) % 2 = 0")
def rank_alignment(m):
    pool = _pool(m)
    # 0 is taken; rank 1 is taken, so 1 -> 1 is skipped and 1 -> 3 stands; 0 again and 999 are skipped.
    given = "array(struct(0 as index, 1 as rank), struct(1 as index, 1 as rank), struct(0 as index, 2 as rank), struct(1 as index, 3 as rank), struct(999999 as index, 4 as rank))"
    runs = pool.groupBy("digest_id").agg(F.count("*").cast("int").alias("pool_size"))
    runs = runs.select(F.col("digest_id").alias("run_id"), "pool_size", F.when(F.length("digest_id") % 2 == 0, F.expr(given)).alias("picks"))
    ranks = edition.front_page_picks(runs).withColumnRenamed("run_id", "digest_id")
    return edition.rank_alignment(pool, ranks).select("digest_id", "id", "front_page_rank")


# ---- 2.5 aggregations
@query("SELECT cluster_pos, pos, published_s FROM cluster_articles QUALIFY row_number() OVER (PARTITION BY cluster_pos ORDER BY published_s DESC, pos) = 1")
def cluster_published_at(m):
    return edition.cluster_published_at(m["cluster_articles"])


@query("SELECT card_id, string_agg(source || ':' || CAST(part AS VARCHAR), ',' ORDER BY pos, part, source) AS sources FROM card_sources GROUP BY card_id")
def card_sources(m):
    out = edition.ordered_sources(m["card_sources"], "card_id", ["part", "source"])
    one = F.transform("sources", lambda s: F.concat(s["source"], F.lit(":"), s["part"].cast("string")))
    return out.select("card_id", F.array_join(one, ",").alias("sources"))


@query("WITH " + USAGE + " SELECT run_id, stage, model, calls, unmeasured, input, output, cache_read, cache_write FROM u")
def usage_by_stage_model(m):
    return usage.usage_by_stage_model(m["usage_calls"]).drop("at_s")


@query("WITH " + PRICED + " SELECT stage, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(unmeasured) AS BIGINT) AS unmeasured, CAST(sum(input) AS BIGINT) AS input, round(sum(billed_usd), 8) AS billed_usd, round(sum(list_usd), 8) AS list_usd FROM priced GROUP BY GROUPING SETS ((stage, model), ())")
def usage_totals(m):
    out = usage.usage_totals(_priced(m))
    return out.select("stage", "model", "calls", "unmeasured", "input", F.round("billed_usd", 8).alias("billed_usd"), F.round("list_usd", 8).alias("list_usd"))


@query("WITH " + PRICED + " SELECT run_id, model, bool_or(promo AND billed_usd < list_usd) AS applied FROM priced WHERE model = 'large' GROUP BY 1, 2")
def promo_notices(m):
    return usage.promo_notices(_priced(m), dims.dim_promo(m.spark)).select("run_id", "model", "applied")


@query("SELECT d.user_id, d.date_s, count(*) AS n_cards, CAST(row_number() OVER (PARTITION BY d.user_id ORDER BY d.date_s DESC) AS INTEGER) AS place FROM digests d JOIN cards c ON c.digest_id = d.id WHERE d.date_s < 893980800 GROUP BY d.user_id, d.date_s, d.id")
def history_dates(m):
    return reads.history_dates(m["digests"], m["cards"], TODAY_S).select("user_id", "date_s", "n_cards", "place")


@query("SELECT user_id, max(last_generated_s) FILTER (WHERE last_generated_s <= 1700000300) AS cursor_s FROM digests GROUP BY user_id")
def latest_cursor(m):
    return reads.latest_cursor(m["digests"], 1700000000)


@query("WITH " + JUDGED + ", n AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic ORDER BY severity DESC, cluster_pos) AS rn FROM judged WHERE notable) SELECT run_id, topic, count(*) FILTER (WHERE rn > 8) AS dropped, count(*) AS total, string_agg(CAST(severity AS VARCHAR), ',' ORDER BY severity DESC) FILTER (WHERE rn > 8) AS severities FROM n GROUP BY 1, 2 HAVING count(*) > 8")
def topic_cuts(m):
    return edition.topic_cuts(_judged(m)).withColumn("severities", F.array_join(F.transform("severities", lambda s: s.cast("string")), ","))


@query("WITH " + BATCHES + " SELECT run_id, count(DISTINCT topic || '/' || CAST(batch AS VARCHAR)) AS n_batches FROM batches GROUP BY run_id")
def triage_batch_count(m):
    return triage.triage_batches(m["clusters"]).groupBy("run_id").agg(F.countDistinct("topic", "batch").alias("n_batches"))


@query("WITH r AS (SELECT stage, input, row_number() OVER (PARTITION BY stage ORDER BY input) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM usage_calls WHERE measured) SELECT stage, min(input) AS least, max(input) FILTER (WHERE i = CAST(floor(n * 0.25) AS BIGINT)) AS p25, max(input) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)) AS median, max(input) FILTER (WHERE i = CAST(floor(n * 0.75) AS BIGINT)) AS p75, max(input) FILTER (WHERE i = CAST(floor(n * 0.9) AS BIGINT)) AS p90, max(input) AS most, round(avg(input), 4) AS mean FROM r GROUP BY stage")
def token_distribution(m):
    return usage.token_distribution(m["usage_calls"]).withColumn("mean", F.round("mean", 4))


STATS = "SELECT run_id, topic, count(*) AS clusters, count(*) FILTER (WHERE notable) AS passes, round(avg(CASE WHEN notable THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) FILTER (WHERE notable AND severity = 2) AS severity_2, count(*) FILTER (WHERE notable AND severity = 5) AS severity_5, count(*) FILTER (WHERE notable AND severity >= 3) AS severe, round(avg(severity) FILTER (WHERE notable), 6) AS mean_severity FROM judged GROUP BY 1, 2"


@query("WITH " + JUDGED + " " + STATS)
def verdict_stats(m):
    out = usage.verdict_stats(_judged(m))
    return out.select("run_id", "topic", "clusters", "passes", F.round("pass_rate", 6).alias("pass_rate"), "severity_2", "severity_5", "severe", F.round("mean_severity", 6).alias("mean_severity"))


@query("WITH " + JUDGED + ", s AS (SELECT run_id, avg(CASE WHEN notable THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(severity) FILTER (WHERE notable) AS mean_severity FROM judged GROUP BY 1) SELECT run_id, 'pass_rate' AS metric, coalesce(pass_rate BETWEEN 0.2 AND 0.31, FALSE) AS passed FROM s UNION ALL SELECT run_id, 'mean_severity', coalesce(mean_severity BETWEEN 2.0 AND 3.0, FALSE) FROM s")
def run_acceptance(m):
    s = _judged(m).groupBy("run_id").agg(F.avg(F.col("notable").cast("double")).alias("pass_rate"), F.avg(F.when(F.col("notable"), F.col("severity"))).alias("mean_severity"))
    stats = s.selectExpr("run_id", "stack(2, 'pass_rate', pass_rate, 'mean_severity', mean_severity) as (metric, value)")
    bands = m.spark.createDataFrame([("pass_rate", 0.2, 0.31), ("mean_severity", 2.0, 3.0)], "metric string, low double, high double")
    return usage.run_acceptance(stats, bands).select("run_id", "metric", "passed")


@query("WITH " + PRICED + ", r AS (SELECT count(DISTINCT run_id) AS runs, sum(list_usd) AS whole FROM priced) SELECT stage, round(sum(list_usd) / max(runs), 6) AS per_run_usd, round(sum(list_usd) / max(whole), 6) AS share, round(sum(list_usd) / max(runs) * 3000, 3) AS monthly_usd FROM priced, r GROUP BY stage")
def cost_projection(m):
    out = usage.cost_projection(_priced(m), 100, 30)
    return out.select("stage", F.round("per_run_usd", 6).alias("per_run_usd"), F.round("share", 6).alias("share"), F.round("monthly_usd", 3).alias("monthly_usd"))


CARDS_MADE = "made AS (SELECT run_id, count(*) FILTER (WHERE stage = 'signup') AS cards FROM usage_calls GROUP BY 1), spent AS (SELECT run_id, stage, sum(list_usd) AS usd FROM priced GROUP BY 1, 2), lines AS (SELECT stage, count(*) AS runs, regr_slope(usd, cards) AS slope, regr_intercept(usd, cards) AS base, regr_r2(usd, cards) AS r2 FROM spent JOIN made USING (run_id) GROUP BY 1)"


def _per_card(m):
    return usage.cost_per_card(_priced(m), m["usage_calls"].groupBy("run_id").agg(F.count_if(F.col("stage") == "signup").alias("cards")))


@query("WITH " + PRICED + ", " + CARDS_MADE + " SELECT stage, runs, round(slope, 7) AS slope_usd, round(base, 6) AS intercept_usd, round(r2, 6) AS r2 FROM lines")
def cost_per_card(m):
    """A call of the stage signup stands for a card that was written."""
    return _per_card(m).select("stage", "runs", F.round("slope_usd", 7).alias("slope_usd"), F.round("intercept_usd", 6).alias("intercept_usd"), F.round("r2", 6).alias("r2"))


@query("WITH " + PRICED + ", " + CARDS_MADE + ", sizes AS (SELECT unnest([15, 20, 30, 130]) AS cards) SELECT CAST(cards AS BIGINT) AS cards, round(sum(base) + sum(slope) * max(cards), 5) AS usd FROM lines, sizes GROUP BY cards")
def cost_of_cards(m):
    return usage.cost_of_cards(_per_card(m), [15, 20, 30, 130]).withColumn("usd", F.round("usd", 5))


@query("SELECT topic, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM (SELECT source AS topic, cluster_pos, count(*) AS n FROM cluster_articles GROUP BY 1, 2) GROUP BY topic")
def single_source_share(m):
    out = usage.single_source_share(m["cluster_articles"].select(F.col("source").alias("topic"), "cluster_pos"))
    return out.select("topic", F.round("share", 6).alias("share"))


@query("""WITH l AS (SELECT lower(trim(unnest(string_split(labels_text, '|')))) AS label FROM cards), c AS (SELECT label, count(*) AS n FROM l WHERE label <> '' GROUP BY 1)
SELECT label, n, CAST(list_reduce(list_transform(string_split(label, ''), x -> CAST(unicode(x) AS BIGINT)), (h, u) -> (xor(h, u) * 16777619) % 4294967296, 2166136261::BIGINT) % 6 + 1 AS INTEGER) AS bucket FROM c""")
def label_counts(m):
    from ..functions.exprs import clean_labels, label_bucket

    x = m["cards"].select(F.explode(clean_labels(F.split("labels_text", "\\|"))).alias("label"))
    return x.groupBy(F.lower("label").alias("label")).agg(F.count("*").alias("n")).withColumn("bucket", label_bucket(F.col("label")))


@query("WITH e AS (SELECT id % 50 AS story, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM vectors) SELECT story, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM e GROUP BY 1, 2")
def story_centroid(m):
    v = m["vectors"]
    c = stories.story_centroid(v, v.select("id", (F.col("id") % 50).alias("story")))
    return c.select("story", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


# ---- 2.6 windows
@query("SELECT user_id, url, pos FROM articles QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY pos) = 1")
def first_sighting(m):
    return ingest.first_sighting(m["articles"], ["pos"]).select("user_id", "url", "pos")


@query("WITH " + BATCHES + " SELECT run_id, topic, cluster_pos, CAST(batch AS BIGINT) AS batch FROM batches")
def triage_batches(m):
    return triage.triage_batches(m["clusters"]).select("run_id", "topic", "cluster_pos", "batch")


@query("WITH " + JUDGED + " SELECT run_id, topic, cluster_pos, severity, CAST(row_number() OVER (PARTITION BY run_id, topic ORDER BY severity DESC, cluster_pos) AS INTEGER) AS slot FROM judged WHERE notable QUALIFY slot <= 8")
def cap_per_topic(m):
    return edition.cap_per_topic(_judged(m)).select("run_id", "topic", "cluster_pos", "severity", "slot")


@query("WITH " + BATCHES + """, nb AS (SELECT *, count(*) OVER (PARTITION BY run_id, topic, batch) AS sz, row_number() OVER (PARTITION BY run_id, topic, batch ORDER BY cluster_pos) - 1 AS bp FROM batches), g AS (SELECT *, run_id || '/' || topic || '/' || CAST(batch AS VARCHAR) AS batch_id, CASE WHEN cluster_pos % 7 = 0 THEN -1 WHEN cluster_pos % 7 = 1 THEN 0 WHEN cluster_pos % 7 = 2 THEN sz ELSE bp END AS idx FROM nb)
SELECT batch_id, CAST(idx AS INTEGER) AS "index", CAST(1 + cluster_pos % 5 AS INTEGER) AS severity FROM g WHERE idx >= 0 AND idx < sz QUALIFY row_number() OVER (PARTITION BY batch_id, idx ORDER BY bp) = 1""")
def first_verdict_wins(m):
    b = triage.triage_batches(m["clusters"]).withColumn("batch_id", F.concat_ws("/", "run_id", "topic", F.col("batch").cast("string")))
    k = F.col("cluster_pos") % 7
    w = F.count("*").over(Window.partitionBy("batch_id"))
    index = F.when(k == 0, -1).when(k == 1, 0).when(k == 2, w).otherwise(F.col("batch_pos")).cast("int")
    b = b.select("batch_id", "batch_pos", index.alias("index"), (F.col("cluster_pos") % 5 + 1).cast("int").alias("severity"), w.alias("batch_size"))
    one = F.struct("batch_pos", F.struct("index", F.lit(True).alias("notable"), "severity").alias("v"))
    r = b.groupBy("batch_id", "batch_size").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["v"]).alias("verdicts"))
    return triage.first_verdict_wins(r).select("batch_id", "index", "severity")


@query("SELECT id, digest_id, created_s = max(created_s) OVER w AND max(created_s) OVER w <> min(created_s) OVER w AS is_new FROM cards WINDOW w AS (PARTITION BY digest_id)")
def new_run_badge(m):
    return reads.new_run_badge(m["cards"], "digest_id").select("id", "digest_id", "is_new")


@query("WITH " + BATCHES + """, un AS (SELECT b.*, row_number() OVER (PARTITION BY b.run_id, b.topic, batch ORDER BY cluster_pos) AS r1, count(*) OVER (PARTITION BY b.run_id, b.topic, batch) AS n1 FROM batches b WHERE cluster_pos NOT IN (SELECT cluster_pos FROM verdicts)), h AS (SELECT *, CASE WHEN r1 > ceil(n1 / 2.0) THEN 1 ELSE 0 END AS half1 FROM un),
h2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, topic, batch, half1 ORDER BY cluster_pos) AS r2, count(*) OVER (PARTITION BY run_id, topic, batch, half1) AS n2 FROM h) SELECT run_id, topic, CAST(batch AS BIGINT) AS batch, cluster_pos, half1, CASE WHEN r2 > ceil(n2 / 2.0) THEN 1 ELSE 0 END AS half2 FROM h2""")
def retry_split(m):
    out = triage.retry_split(triage.triage_batches(m["clusters"]), m["verdicts"])
    return out.select("run_id", "topic", "batch", "cluster_pos", "half1", "half2")


@query("""WITH t AS (SELECT digest_id, id, CASE WHEN severity = 5 THEN 0 WHEN severity >= 3 THEN 1 ELSE 2 END AS tier, published_s FROM cards),
n AS (SELECT *, row_number() OVER (PARTITION BY digest_id, tier ORDER BY published_s, id) - 1 AS k, count(*) OVER (PARTITION BY digest_id, tier) AS c, [1, 2, 3][tier + 1] AS per, [6, 3, 2][tier + 1] AS wd, [2, 2, 1][tier + 1] AS ht FROM t),
b AS (SELECT digest_id, tier, max(k // per + 1) * max(ht) AS rows FROM n GROUP BY 1, 2)
SELECT n.digest_id AS page_id, n.id, CAST(k % per * wd + 1 AS INTEGER) AS col_start, CAST(CASE WHEN k % per = per - 1 OR k = c - 1 THEN 6 - k % per * wd ELSE wd END AS INTEGER) AS col_span,
CAST(coalesce((SELECT sum(rows) FROM b WHERE b.digest_id = n.digest_id AND b.tier < n.tier), 0) + k // per * ht + 1 AS INTEGER) AS row_start, CAST(ht AS INTEGER) AS row_span FROM n""")
def edition_layout(m):
    from ..functions.exprs import tier_for_severity

    items = m["cards"].select(F.col("digest_id").alias("page_id"), F.col("published_s").alias("pos"), "id", tier_for_severity(F.col("severity")).alias("tier"))
    return reads.edition_layout(items).drop("tier")


@query("SELECT id, digest_id, CAST(dense_rank() OVER (PARTITION BY digest_id ORDER BY created_s) AS INTEGER) AS run_number FROM cards")
def dense_run_number(m):
    return reads.dense_run_number(m["cards"]).select("id", "digest_id", "run_number")


# ---- 2.7 order, as rank columns
@query("SELECT digest_id, id, CAST(row_number() OVER (PARTITION BY digest_id ORDER BY published_s DESC, id) AS INTEGER) AS place FROM cards")
def digest_order(m):
    return reads.digest_for_date(m["digests"], m["cards"], m["bookmarks"]).select("digest_id", "id", "place")


@query("SELECT digest_id, id, CAST(row_number() OVER (PARTITION BY digest_id, topic ORDER BY severity DESC, published_s DESC, id) AS INTEGER) AS topic_place FROM cards")
def topic_order(m):
    return reads.topic_order(m["cards"])


@query("SELECT digest_id, id, front_page_rank, CAST(row_number() OVER (PARTITION BY digest_id ORDER BY front_page_rank, id) AS INTEGER) AS place FROM cards WHERE front_page_rank IS NOT NULL QUALIFY place <= 6")
def front_page(m):
    return reads.front_page(m["cards"]).select("digest_id", "id", "front_page_rank", "place")


@query("SELECT user_id, card_id, created_s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_s DESC, card_id) AS INTEGER) AS place FROM bookmarks WHERE card_id >= 0")
def saved_order(m):
    return reads.saved_cards(m["bookmarks"], m["cards"], m["digests"]).select("user_id", "card_id", "created_s", "place")


@query("SELECT user_id, date_s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date_s DESC) AS INTEGER) AS place FROM (SELECT DISTINCT user_id, date_s FROM cards)")
def history_order(m):
    return reads.history_dates(m["digests"], m["cards"], 4102444800).select("user_id", "date_s", "place")


@query("SELECT user_id, last_generated_s AS cursor_s, id FROM digests WHERE last_generated_s <= 1700000300 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last_generated_s DESC, id) = 1")
def newest_cursor(m):
    x = reads.cursor_candidates(m["digests"], 1700000000)
    top = x.groupBy("user_id").agg(F.min_by(F.struct("last_generated_s", "id"), F.struct(-F.col("last_generated_s"), "id")).alias("t"))
    return top.select("user_id", F.col("t.last_generated_s").alias("cursor_s"), F.col("t.id").alias("id"))


@query("SELECT run_id, cluster_pos, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cluster_pos) AS INTEGER) AS place FROM clusters")
def cluster_input_order(m):
    return m["clusters"].select("run_id", "cluster_pos", F.row_number().over(Window.partitionBy("run_id").orderBy("cluster_pos")).alias("place"))


# ---- 2.8 sets
@query("SELECT id, CASE WHEN id % 10 = 1 THEN NULL ELSE front_page_rank END AS front_page_rank, id % 2 = 1 AS is_new FROM cards WHERE id % 2 = 0 UNION ALL SELECT id, front_page_rank, TRUE FROM cards WHERE id % 2 = 1")
def merge_snapshot(m):
    c = m["cards"].select("id", "front_page_rank", (F.col("id") % 2 == 1).alias("is_new"))
    updates = c.where("id % 10 = 1").select("id", F.lit(None).cast("bigint").alias("new_rank"))
    return edition.merge_snapshot(c.where("not is_new"), updates, c.where("is_new"))


@query("SELECT DISTINCT user_id, topic FROM user_topics")
def distinct_preferences(m):
    return m["user_topics"].dropDuplicates(["user_id", "topic"])


@query("SELECT topic FROM dim_topic INTERSECT SELECT topic FROM user_topics")
def known_values(m):
    return m["dim_topic"].select("topic").intersect(m["user_topics"].select("topic"))


# ---- 2.9 stories
@query("""WITH w AS (SELECT pos, unnest(list_filter(regexp_split_to_array(lower(concat(title, '. ', snippet)), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')) AS word FROM articles), t AS (SELECT pos, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS tf FROM w GROUP BY 1, 2),
d AS (SELECT dim, ln((SELECT count(*) + 1 FROM articles) / (count(*) + 1)) AS idf FROM t GROUP BY dim), x AS (SELECT pos, dim, tf * idf AS x FROM t JOIN d USING (dim)), m AS (SELECT pos, sqrt(sum(x * x)) AS norm FROM x GROUP BY pos)
SELECT pos, CAST(dim AS INTEGER) AS dim, round(CAST(CAST(x / norm AS FLOAT) AS DOUBLE), 4) AS x FROM x JOIN m USING (pos) WHERE norm > 0 AND x <> 0""")
def embed_articles(m):
    out = stories.embed_articles(m["articles"]).select("pos", F.posexplode("embedding").alias("dim", "x"))
    return out.where("x <> 0").select("pos", "dim", F.round(F.col("x").cast("double"), 4).alias("x"))


@query(None)
def greedy_stories(m):
    """Runs of a thousand vectors, so their number grows with the table."""
    v = m["vectors"].select(F.floor(F.col("id") / 1000).alias("run_id"), F.col("id").alias("pos"), "topic", "embedding")
    return stories.greedy_stories(v, 0.35)


PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, {_SIM} AS sim FROM vectors a JOIN vectors b ON a.topic = b.topic AND a.id < b.id), hits AS (SELECT a, b, sim FROM pairs WHERE sim >= 0.35)"


@query("WITH " + PAIRS + " SELECT a, b, round(sim, 4) AS sim FROM hits")
def story_pairs(m):
    return stories.story_pairs(m["vectors"], 0.35).withColumn("sim", F.round("sim", 4))


@query("WITH " + PAIRS + " SELECT a, b, round(sim, 4) AS sim FROM hits")
def story_pairs_banded(m):
    """A pair at the threshold may be missed once in a thousand million times. Bands for that send a row thousands of times, so
    banded_pairs compares all rows of a topic, a tile at a time, and misses none; tests measure what bands alone find."""
    return banded_pairs(m["vectors"], 0.35, "topic", recall=1 - 1e-9, bucket=8).withColumn("sim", F.round("sim", 4))


@query("WITH RECURSIVE " + PAIRS + ", bi AS (SELECT a, b FROM hits UNION ALL SELECT b, a FROM hits), reach AS (SELECT id, id AS other FROM vectors UNION SELECT r.id, s.b FROM reach r JOIN bi s ON s.a = r.other) SELECT id, min(other) AS story FROM reach GROUP BY id")
def story_components(m):
    v = m["vectors"]
    return stories.story_components(v.select("id"), stories.story_pairs(v, 0.35))


STORIES = PAIRS + ", bi AS (SELECT a, b FROM hits UNION ALL SELECT b, a FROM hits), reach AS (SELECT id, id AS other FROM vectors UNION SELECT r.id, s.b FROM reach r JOIN bi s ON s.a = r.other), st AS (SELECT id, min(other) AS story FROM reach GROUP BY id)"
CENTROIDS = "parts AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM vectors), means AS (SELECT story, dim, avg(CAST(x AS DOUBLE)) AS x FROM parts JOIN st USING (id) GROUP BY 1, 2), cent AS (SELECT story, list(x ORDER BY dim) AS centroid FROM means GROUP BY 1)"


@query("WITH RECURSIVE " + STORIES + ", " + CENTROIDS + """, sims AS (SELECT v.id, c.story, list_sum(list_transform(list_zip(v.embedding, c.centroid), x -> CAST(x[1] AS DOUBLE) * x[2])) AS sim FROM vectors v JOIN (SELECT cent.*, topic FROM cent JOIN vectors h ON h.id = cent.story) c USING (topic)),
best AS (SELECT id, story, sim FROM sims WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, story) = 1) SELECT v.id, b.story, round(b.sim, 4) AS sim FROM vectors v LEFT JOIN best b ON b.id = v.id""")
def assign_to_stories(m):
    """All vectors against the centroids of the connected stories."""
    v = m["vectors"]
    found = stories.written(stories.story_components(v.select("id"), stories.story_pairs(v, 0.35)))
    heads = v.select(F.col("id").alias("story"), "topic")
    centroids = stories.story_centroid(v, found).join(heads.hint("merge"), "story")
    return stories.assign_to_stories(v, centroids, 0.2).select("id", "story", F.round("sim", 4).alias("sim"))


@query(f"""WITH RECURSIVE bi0 AS (SELECT a.id AS a, b.id AS b FROM vectors a JOIN vectors b ON a.topic = b.topic AND a.id <> b.id WHERE a.id % 2 = 0 AND b.id % 2 = 0 AND {_SIM} >= 0.25), r0 AS (SELECT id, id AS other FROM vectors WHERE id % 2 = 0 UNION SELECT r.id, x.b FROM r0 r JOIN bi0 x ON x.a = r.other), s0 AS (SELECT id, min(other) AS story FROM r0 GROUP BY id),
p0 AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM vectors), m0 AS (SELECT story, dim, avg(CAST(x AS DOUBLE)) AS x FROM p0 JOIN s0 USING (id) GROUP BY 1, 2), c0 AS (SELECT story, list(x ORDER BY dim) AS centroid FROM m0 GROUP BY 1),
sims AS (SELECT v.id, c.story, list_sum(list_transform(list_zip(v.embedding, c.centroid), x -> CAST(x[1] AS DOUBLE) * x[2])) AS sim FROM vectors v JOIN (SELECT c0.*, topic FROM c0 JOIN vectors h ON h.id = c0.story) c USING (topic) WHERE v.id % 2 = 1), best AS (SELECT id, story, sim FROM sims WHERE sim >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, story) = 1),
un AS (SELECT * FROM vectors WHERE id % 2 = 1 AND id NOT IN (SELECT id FROM best)), bi1 AS (SELECT a.id AS a, b.id AS b FROM un a JOIN un b ON a.topic = b.topic AND a.id <> b.id WHERE {_SIM} >= 0.25), r1 AS (SELECT id, id AS other FROM un UNION SELECT r.id, x.b FROM r1 r JOIN bi1 x ON x.a = r.other), s1 AS (SELECT id, min(other) AS story FROM r1 GROUP BY id),
al AS (SELECT id, story, CAST(NULL AS DOUBLE) AS sim, TRUE AS is_new FROM s0 UNION ALL SELECT id, story, sim, FALSE FROM best UNION ALL SELECT id, story, NULL, TRUE FROM s1), st AS (SELECT story, count(*) AS n, avg(CAST(embedding[1] AS DOUBLE)) AS x FROM al JOIN vectors USING (id) GROUP BY story)
SELECT al.id, al.story, round(al.sim, 4) AS sim, al.is_new, st.n, round(st.x, 4) AS x FROM al JOIN st USING (story)""")
def stories_across_runs(m):
    """The even vectors come in a first batch and the odd ones in a second; with the size and the first coordinate of the
    centroid that each story has in the end."""
    v = m["vectors"]
    first, state = story_state.advance(story_state.no_stories(m.spark), v.where("id % 2 = 0"), 0.25)
    second, state = story_state.advance(state, v.where("id % 2 = 1"), 0.25)
    end = state.select("story", "n", F.round(F.get("total", F.lit(0)) / F.col("n"), 4).alias("x"))
    return first.unionByName(second).join(end.hint("merge"), "story").select("id", "story", F.round("sim", 4).alias("sim"), "is_new", "n", "x")


@query("WITH " + BEST + " SELECT cluster_pos, card_id, round(sim, 4) AS sim FROM best WHERE sim >= 0.25")
def duplicate_candidates(m):
    return stories.duplicate_candidates(*_sides(m), 0.25).select("cluster_pos", "card_id", F.round("sim", 4).alias("sim"))


@query("WITH " + BEST + " SELECT id AS cluster_pos FROM vectors WHERE id % 2 = 0 AND id NOT IN (SELECT cluster_pos FROM best WHERE sim >= 0.25 AND cluster_pos % 3 = 0)")
def filter_already_covered(m):
    """A judgement is absent for some candidates, whose clusters stay."""
    clusters, cards = _sides(m)
    judged = stories.duplicate_candidates(clusters, cards, 0.25).where("cluster_pos % 3 <> 2").select("cluster_pos", "card_id", (F.col("cluster_pos") % 3 == 0).alias("same"))
    return stories.filter_already_covered(clusters, cards, judged, 0.25).select("cluster_pos")


@query("WITH s AS (SELECT digest_id, count(*) AS n FROM cards GROUP BY 1), p AS (SELECT digest_id, n, unnest(generate_series(0, n - 1)) AS pool_pos FROM s WHERE length(digest_id) % 3 <> 0) SELECT digest_id AS run_id, CAST(pool_pos AS INTEGER) AS pool_pos, CAST(CASE WHEN pool_pos = 2 THEN 1 WHEN pool_pos = 0 THEN 2 END AS INTEGER) AS rank FROM p".replace("pool_pos = 0 THEN 2", "pool_pos = 0 THEN CASE WHEN n > 2 THEN 2 ELSE 1 END"))
def front_page_picks(m):
    # 2 -> 1 stands if there are three; 0 -> 1 stands only if it does not; then 0 -> 2 stands if 0 is still free.
    given = "array(struct(-1 as index, 3 as rank), struct(2 as index, 1 as rank), struct(0 as index, 1 as rank), struct(2 as index, 2 as rank), struct(0 as index, 2 as rank))"
    runs = m["cards"].groupBy(F.col("digest_id").alias("run_id")).agg(F.count("*").cast("int").alias("pool_size"))
    return edition.front_page_picks(runs.withColumn("picks", F.when(F.length("run_id") % 3 != 0, F.expr(given))))


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY digest_id, topic ORDER BY severity DESC, published_s DESC, id) AS trn FROM cards) SELECT digest_id, id, CAST(row_number() OVER (PARTITION BY digest_id ORDER BY trn, severity DESC, published_s DESC, id) AS INTEGER) AS rank FROM t QUALIFY rank <= 6")
def default_front_page(m):
    return edition.default_front_page(m["cards"]).select("digest_id", "id", "rank")


# ---- 2.10 writes
@query("SELECT id, digest_id, CASE WHEN digest_id = '7-880934400' AND id % 4 = 0 THEN NULL ELSE front_page_rank END AS front_page_rank, created_s FROM cards UNION ALL SELECT -id - 1, '7-880934400', NULL, 899999999 FROM cards WHERE id % 300 = 0")
def persist_run(m):
    c = m["cards"].select("id", "digest_id", "front_page_rank", "created_s")
    new = c.where("id % 300 = 0").select((-F.col("id") - 1).alias("id"), F.lit(None).cast("bigint").alias("front_page_rank"))
    updates = c.where("id % 4 = 0").select("id", F.lit(None).cast("bigint").alias("new_rank"))
    return tables.persist_run(c, m["digests"], new, updates, "7-880934400", 899999999)[0]


@query("SELECT user_id, date_s, FALSE AS opened FROM digests UNION ALL SELECT DISTINCT user_id, 1893456000, TRUE FROM digests")
def open_digest(m):
    d = m["digests"]
    wanted = d.select("user_id", F.lit(1893456000).cast("bigint").alias("date_s")).unionByName(d.select("user_id", "date_s"))
    return tables.open_digest(d, wanted).select("user_id", "date_s", (F.length("id") == 64).alias("opened"))


@query(f"WITH {ATTEMPTS} SELECT card_key, CAST({NOW_S} AS BIGINT) AS created_s FROM attempts WHERE disposition IN ('first', 'retry')")
def stamp_run(m):
    return edition.stamp_run(edition.resolve_generations(m["generations"]), NOW_S).select("card_key", "created_s")


@query("SELECT user_id, card_id, created_s FROM bookmarks UNION ALL SELECT user_id, id, 5 FROM cards c WHERE id % 5 = 0 AND id % 7 <> 0")
def add_bookmarks(m):
    c = m["cards"]
    wanted = c.where("id % 5 = 0").select("user_id", F.col("id").alias("card_id"), F.lit(5).cast("bigint").alias("created_s"))
    stolen = wanted.withColumn("user_id", F.col("user_id") + 1)
    return tables.add_bookmarks(m["bookmarks"], wanted.unionByName(stolen), c)


@query("SELECT user_id, card_id FROM bookmarks WHERE card_id % 3 <> 0 OR card_id < 0")
def remove_bookmarks(m):
    gone = m["cards"].where("id % 3 = 0").select("user_id", F.col("id").alias("card_id"))
    return tables.remove_bookmarks(m["bookmarks"], gone).select("user_id", "card_id")


@query("SELECT user_id, topic FROM user_topics WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, topic FROM (SELECT DISTINCT user_id, 'Tennis' AS topic FROM user_topics WHERE user_id % 3 = 0)")
def replace_preferences(m):
    u = m["user_topics"]
    return tables.replace_preferences(u, u.where("user_id % 3 = 0").select("user_id", F.lit("Tennis").alias("topic")))


@query("SELECT id, coalesce(expanded_report, CASE WHEN id % 3 = 0 THEN concat('new ', CAST(id AS VARCHAR)) END) AS expanded_report FROM cards")
def fill_reports(m):
    c = m["cards"]
    reports = c.where("id % 3 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("report"))
    return tables.fill_reports(c, reports).select("id", "expanded_report")


@query("SELECT b.user_id, b.card_id FROM bookmarks b JOIN cards c ON c.id = b.card_id WHERE b.user_id % 4 <> 0 AND c.user_id % 4 <> 0")
def cascade_delete(m):
    gone = m["digests"].where("user_id % 4 = 0").select("user_id").distinct()
    return tables.cascade_delete(gone, m["digests"], m["cards"], m["bookmarks"])[2].select("user_id", "card_id")


# ---- 2.11 quality
_UUID = "concat(substr(md5(id), 1, 8), '-', substr(md5(id), 9, 4), '-4', substr(md5(id), 14, 3), '-8', substr(md5(id), 18, 3), '-', substr(md5(id), 21, 12))"


@query("""SELECT 'digests.user_date' AS "check", CAST(user_id AS VARCHAR) || '|' || CAST(date_s AS VARCHAR) AS value, count(*) AS n FROM digests GROUP BY user_id, date_s HAVING count(*) > 1 UNION ALL SELECT 'cards.id', CAST(id AS VARCHAR), count(*) FROM cards GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'bookmarks.card_id', '-1', count(*) FROM bookmarks WHERE card_id NOT IN (SELECT id FROM cards)
UNION ALL SELECT 'user_topics.pair', CAST(user_id AS VARCHAR) || '|' || topic, count(*) FROM user_topics GROUP BY user_id, topic HAVING count(*) > 1 UNION ALL SELECT 'user_sources.pair', CAST(user_id AS VARCHAR) || '|' || source, count(*) FROM user_sources GROUP BY user_id, source HAVING count(*) > 1
UNION ALL SELECT 'digests.uuid', 'not-a-uuid', count(*) FROM digests WHERE user_id % 3 = 1 UNION ALL SELECT 'digests.date', '1/2/2024', count(*) FROM digests WHERE user_id % 4 = 2""")
def key_violations(m):
    """Every third reader's digests have an id, and every fourth's a date, of the wrong format."""
    d = m["digests"]
    told = d.select(F.when(F.col("user_id") % 3 == 1, "not-a-uuid").otherwise(F.expr(_UUID)).alias("uuid"), F.when(F.col("user_id") % 4 == 2, "1/2/2024").otherwise(F.date_format(F.timestamp_seconds("date_s"), "yyyy-MM-dd")).alias("date"))
    formats = [("digests.uuid", told, "uuid", valid_uuid(F.col("uuid"))), ("digests.date", told, "date", valid_date(F.col("date")))]
    return quality.key_violations(d, m["cards"], m["bookmarks"], m["user_topics"], m["user_sources"], formats)


@query("SELECT user_id, 'unknown_topic' AS error, topic AS value FROM user_topics WHERE topic NOT IN (SELECT topic FROM dim_topic) UNION ALL SELECT c_custkey, 'no_sources', '' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM user_sources) UNION ALL SELECT c_custkey, 'no_topics', '' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM user_topics)")
def preference_errors(m):
    users = m.table("customer").select(F.col("c_custkey").alias("user_id"))
    return quality.preference_errors(m["user_topics"], m["user_sources"], m["dim_topic"], m["dim_source"], users)


@query("SELECT digest_id, front_page_rank, count(*) AS n FROM cards WHERE front_page_rank IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def rank_collisions(m):
    return quality.rank_collisions(m["cards"])


@query("WITH " + JUDGED + " SELECT run_id, count(*) AS clusters, count(*) FILTER (WHERE notable) AS passes, count(*) FILTER (WHERE NOT notable) AS rejects, TRUE AS balanced FROM judged GROUP BY 1")
def verdict_accounting(m):
    return quality.verdict_accounting(_judged(m))


@query("WITH r AS (SELECT o_custkey AS user_id, o_orderkey AS run, EPOCH(o_orderdate) AS since_s, EPOCH(o_orderdate) + o_orderkey % 100 * 86400 AS at_s FROM orders) SELECT DISTINCT r.user_id, r.run, r.at_s FROM r JOIN r q ON q.user_id = r.user_id AND q.run <> r.run AND (q.since_s, q.at_s, q.run) < (r.since_s, r.at_s, r.run) AND q.at_s > r.since_s")
def overlapping_runs(m):
    at = F.unix_timestamp("o_orderdate")
    runs = m.table("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("run"), at.alias("since_s"), (at + F.col("o_orderkey") % 100 * 86400).alias("at_s"))
    return quality.overlapping_runs(runs).select("user_id", "run", "at_s")


# ---- 2.12 streaming twins in batch form, and hooks
def _drained(stream, mode="append", base=None):
    """All that a stream gives for the files there are, by way of the shared folder, with the batch_id of each row."""
    base = base or f"{stories.shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", batch_id bigint"
    return stream.sparkSession.read.schema(schema).parquet(f"{base}/out")


def _latest(rows, keys):
    """The row of the last batch for each key of a stream in update mode."""
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r")).select(*keys, "r.*")


@query("SELECT DISTINCT user_id, url FROM articles")
def stream_new_articles(m):
    a = m.stream("articles").withColumn("published_at", F.timestamp_seconds("published_s"))
    return _drained(streams.stream_new_articles(a)).select("user_id", "url")


@query(f"SELECT user_id, pos FROM articles WHERE published_s < {NOW_S} - 172800")
def late_articles(m):
    a = m.stream("articles").withColumn("published_at", F.timestamp_seconds("published_s")).select("user_id", "pos", "published_at")
    base = f"{stories.shared_folder(m.spark)}/late-{uuid.uuid4().hex}"
    save = streams.late_articles_sink(lambda batch, k: batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={k}"), NOW_S - ingest.LOOKBACK_S)
    a.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.schema(a.schema).parquet(f"{base}/out").select("user_id", "pos")


@query(f"WITH s AS (SELECT a.*, CASE WHEN c.cursor_s <= {NOW_S} + 300 AND c.cursor_s > {NOW_S} - 172800 THEN c.cursor_s ELSE {NOW_S} - 172800 END AS cut FROM articles a LEFT JOIN cursors c USING (user_id)) SELECT user_id, pos FROM s WHERE published_s < cut")
def missed_articles(m):
    return ingest.late_articles(m["articles"], m["cursors"], NOW_S).select("user_id", "pos")


@query("""SELECT 'card' AS part, digest_id, id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 4 THEN 5 END ELSE front_page_rank END AS rank, created_s FROM cards
UNION ALL SELECT 'card', digest_id, -id, 1, 899999999 FROM cards WHERE id % 3 = 0 UNION ALL SELECT 'digest', id, NULL, NULL, CASE WHEN id IN (SELECT digest_id FROM cards WHERE id % 3 = 0 OR id % 4 = 0) THEN 899999999 ELSE last_generated_s END FROM digests""")
def stream_persist(m):
    """New cards and rank changes stream in on a store of all cards; then the log is compacted, and the stream's batches come
    again, which changes nothing."""
    base = f"{stories.shared_folder(m.spark)}/store-{uuid.uuid4().hex}"
    log = commits.CommitLog(m.spark, base)
    c = m["cards"]
    commits.open_store(log, c, m["digests"])
    stamp = F.lit(899999999).cast("bigint").alias("run_at_s")
    new = c.where("id % 3 = 0").select("digest_id", (-F.col("id")).alias("id"), F.lit("insert").alias("kind"), F.lit(1).cast("bigint").alias("rank"), stamp, F.col("id").alias("seq"))
    ranks = c.where("id % 4 = 0").select("digest_id", "id", F.lit("rank").alias("kind"), F.when(F.col("id") % 8 == 4, 5).cast("bigint").alias("rank"), stamp, F.col("id").alias("seq"))
    changes = new.unionByName(ranks)
    changes.write.parquet(f"{base}/in")
    for at in range(2):
        stream = m.spark.readStream.schema(changes.schema).parquet(f"{base}/in")
        streams.stream_persist(stream, log, "query", f"{base}/checkpoint{at}").awaitTermination()
        if not at:
            commits.compact(log)
    cards, digests = commits.current(log)
    cards = cards.select(F.lit("card").alias("part"), "digest_id", "id", F.col("front_page_rank").alias("rank"), "created_s")
    return cards.unionByName(digests.select(F.lit("digest").alias("part"), F.col("id").alias("digest_id"), F.col("last_generated_s").alias("created_s")), allowMissingColumns=True)


RUNS_SQL = "p AS (SELECT run_id || '/' || CAST(at_s // 86400 AS VARCHAR) AS run_id, seq, stage, at_s FROM progress), w AS (SELECT max(at_s) - 3600 AS wm FROM p), r AS (SELECT run_id, max_by(stage, seq) AS stage, max(seq) AS seq, max(at_s) AS at_s, min_by(stage, seq) FILTER (WHERE stage IN ('signup', 'error')) AS ended FROM p GROUP BY 1)"


@query("WITH " + RUNS_SQL + " SELECT run_id, stage, seq, CASE ended WHEN 'signup' THEN 'done' WHEN 'error' THEN 'error' ELSE CASE WHEN at_s + 21600 < wm THEN 'lost' ELSE 'running' END END AS status FROM r, w")
def run_progress(m):
    """As a stream: a run is a user's day, a signup ends it well and an error badly, and six hours without either lose it."""
    run = F.concat_ws("/", F.col("run_id").cast("string"), F.floor(F.col("at_s") / 86400).cast("string"))
    e = m.stream("progress").select(run.alias("run_id"), "seq", "stage", F.timestamp_seconds("at_s").alias("at")).withWatermark("at", "1 hour")
    return _latest(_drained(streams.run_states(e, {"signup": "done", "error": "error"}, 21600), "update"), ["run_id"])


@query("SELECT run_id, stage, seq FROM progress QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1")
def run_stages(m):
    return streams.run_progress(m["progress"])


@query("SELECT run_id, stage, model, count(*) FILTER (WHERE measured) AS calls, count(*) FILTER (WHERE NOT measured) AS unmeasured, CAST(coalesce(sum(input) FILTER (WHERE measured), 0) AS BIGINT) AS input, CAST(coalesce(sum(output) FILTER (WHERE measured), 0) AS BIGINT) AS output FROM usage_calls GROUP BY 1, 2, 3")
def usage_stream(m):
    """As a stream in update mode: the totals of the last batch that changed them."""
    return _latest(_drained(streams.usage_stream(m.stream("usage_calls")), "update"), ["run_id", "stage", "model"])


def _in_two_turns(m, of):
    """What a stream of the events gives when every fiftieth comes only after all others, in a second run."""
    e = m.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    base = f"{stories.shared_folder(m.spark)}/turns-{uuid.uuid4().hex}"
    for turn in ("event_id % 50 <> 0", "event_id % 50 = 0"):
        e.where(turn).write.mode("append").parquet(f"{base}/in")
        stream = m.spark.readStream.schema(e.schema).parquet(f"{base}/in").withWatermark("ts", "2 hours")
        out = _drained(of(stream), "append", base)
    return out


CLOSED = "e AS (SELECT *, EPOCH(date_trunc('day', ts)) AS day_s FROM events), w AS (SELECT max(ts) FILTER (WHERE event_id % 50 <> 0) - INTERVAL 2 HOUR AS early, max(ts) - INTERVAL 2 HOUR AS wm FROM events), f AS (SELECT e.*, event_id % 50 = 0 AND day_s + 86400 <= EPOCH(early) AS late, day_s + 86400 <= EPOCH(wm) AS closed FROM e, w)"


@query("WITH " + CLOSED + " SELECT day_s, event_type, count(*) AS n FROM f WHERE closed AND NOT late GROUP BY 1, 2")
def daily_edition_counts(m):
    """As a stream in append mode: days that the watermark closed, without what came too late for them."""
    return _in_two_turns(m, streams.daily_edition_counts).select("day_s", "event_type", "n")


@query("WITH " + CLOSED + " SELECT day_s, event_id, event_type FROM f WHERE late")
def late_events(m):
    return _in_two_turns(m, streams.late_events).select("day_s", "event_id", "event_type")


@query("SELECT EPOCH(date_trunc('day', ts)) AS day_s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(m):
    return streams.daily_edition_counts(m.table("events"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 6 + 1 END AS front_page_rank FROM events WHERE event_id % 4 <> 0")
def card_state(m):
    k = F.col("seq")
    rank = F.when(k % 3 != 0, k % 6 + 1)
    changes = m.stream("progress").select(k.alias("id"), F.when(k % 4 == 0, "update").otherwise("insert").alias("kind"), rank.alias("rank"))
    return _drained(streams.card_state(changes), "update").select("id", "front_page_rank")


@query("WITH " + BATCHES + " SELECT run_id || '/' || topic || '/' || CAST(batch AS VARCHAR) AS batch_id, count(*) AS n, min(cluster_pos) AS first_pos FROM batches GROUP BY 1 HAVING min(cluster_pos) % 5 <> 0")
def judge_hook(m):
    import pandas as pd

    def judge(pdf):
        first = int(pdf["cluster_pos"].min())
        if first % 5 == 0:
            raise ValueError("a batch that the judge does not answer")
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "n": [len(pdf)], "first_pos": [first]})

    b = triage.triage_batches(m["clusters"]).select(F.concat_ws("/", "run_id", "topic", F.col("batch").cast("string")).alias("batch_id"), "cluster_pos")
    return stories.map_batches(b, judge, "batch_id string, n long, first_pos long")


@query("SELECT pos AS id, round(CAST(CAST(1000.0 / sqrt(1000000.0 + n * n) AS FLOAT) AS DOUBLE), 6) AS x FROM (SELECT pos, length(concat(title, '. ', snippet)) AS n FROM articles)")
def embedder_hook(m):
    def embed(texts):
        assert len(texts) <= stories.EMBED_BATCH
        return [(1000 / (1e6 + len(t) ** 2) ** 0.5, len(t) / (1e6 + len(t) ** 2) ** 0.5) for t in texts]

    out = stories.embed_with(m["articles"].select(F.col("pos").alias("id"), article_text(F.col("title"), F.col("snippet")).alias("text")), embed)
    return out.select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("x"))


@query("WITH " + BEST + " SELECT cluster_pos, card_id, cluster_pos % 10 <> 4 AND cluster_pos % 3 <> 1 AND (cluster_pos + card_id) % 3 = 0 AS same FROM best WHERE sim >= 0.2")
def same_story_hook(m):
    """Batch 4 of each topic fails, and some pairs have no answer: both count as another story."""

    def same(pdf):
        if pdf["batch_id"].iloc[0].endswith("/4"):
            raise ValueError("a batch that is not answered")
        pdf = pdf[pdf["cluster_pos"] % 3 != 1]
        return pdf[["cluster_pos", "card_id"]].assign(same=(pdf["cluster_pos"] + pdf["card_id"]) % 3 == 0)

    c = stories.duplicate_candidates(*_sides(m), 0.2)
    batch = F.concat_ws("/", "topic", (F.col("cluster_pos") % 10).cast("string")).alias("batch_id")
    return stories.same_story_with(c.select(batch, "cluster_pos", "card_id"), same)


@query("SELECT conv_id AS card_key, length(text) AS n FROM conversations WHERE turn = 0 AND CAST(floor(conv_id / 20.0) AS BIGINT) % 3 <> 1 AND conv_id % 6 <> 0")
def writer_hook(m):
    """Every third batch fails, and some cards come back without a summary: both are dropped."""

    def write(pdf):
        if int(pdf["batch_id"].iloc[0]) % 3 == 1:
            raise ValueError("a batch that is not written")
        found = pdf[["card_key"]].assign(title="t", summary=[" " if k % 6 == 0 else f"{len(t)}" for k, t in zip(pdf["card_key"], pdf["source_text"], strict=True)], stop_reason="end_turn")
        return found.assign(labels=[["a"]] * len(found))[["card_key", "title", "summary", "labels", "stop_reason"]]

    c = m.table("conversations").where("turn = 0")
    c = c.select(F.floor(F.col("conv_id") / 20).cast("string").alias("batch_id"), F.col("conv_id").alias("card_key"), F.coalesce("text", F.lit("")).alias("source_text"))
    return stories.written_with(c, write).select("card_key", F.col("summary").cast("bigint").alias("n"))


# ---- 2.13 jobs
NEW_BATCHES = "nums AS (SELECT digest_id, topic, cluster_pos, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY digest_id, topic) AS n FROM kept WINDOW w AS (PARTITION BY digest_id, topic ORDER BY cluster_pos)), bat AS (SELECT *, (n + 19) // 20 AS b FROM nums), batches AS (SELECT cluster_pos, CASE WHEN i < (n % b) * (n // b + 1) THEN i // (n // b + 1) ELSE n % b + (i - (n % b) * (n // b + 1)) // (n // b) END AS batch FROM bat)"
STANDS = ATTEMPTS.replace("FROM generations", "FROM reader_generations") + ", stands AS (SELECT card_key FROM attempts WHERE disposition IN ('first', 'retry'))"


ATTACH_AT, ASK_AT = 0.8, 0.6
NEWS = f"""news AS (SELECT digest_id, user_id, pos, topic, carded, url, published_s, {_trim("title")} AS title, {_trim("regexp_replace(snippet, '<[^>]*>', '', 'g')")} AS snippet FROM reader_articles),
told AS (SELECT *, CASE WHEN carded THEN -pos - 1 ELSE pos END AS id FROM news), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(concat(title, '. ', snippet)), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')) AS word FROM told), tf AS (SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT dim, ln((SELECT count(*) + 1 FROM told) / (count(*) + 1)) AS idf FROM tf GROUP BY dim), xs AS (SELECT id, dim, tf * idf AS x FROM tf JOIN df USING (dim)), norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM xs GROUP BY id), vec AS (SELECT id, dim, CAST(CAST(x / norm AS FLOAT) AS DOUBLE) AS x FROM xs JOIN norms USING (id) WHERE norm > 0)"""
STEPS = f"""{NEWS}, f AS (SELECT * FROM news WHERE NOT carded QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY pos) = 1),
s AS (SELECT f.*, CASE WHEN c.cursor_s <= {NOW_S} + 300 AND c.cursor_s > {NOW_S} - 172800 THEN c.cursor_s ELSE {NOW_S} - 172800 END AS cut FROM f LEFT JOIN reader_cursors c USING (user_id)), fresh AS (SELECT * FROM s WHERE published_s >= cut), fv AS (SELECT digest_id, vec.* FROM fresh JOIN vec ON id = pos),
bi AS (SELECT a.id AS a, b.id AS b FROM fv a JOIN fv b ON a.digest_id = b.digest_id AND a.dim = b.dim AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.x * b.x) >= {ATTACH_AT}),
reach AS (SELECT pos AS id, pos AS other FROM fresh UNION SELECT r.id, x.b FROM reach r JOIN bi x ON x.a = r.other), st AS (SELECT id, min(other) AS story FROM reach GROUP BY id),
members AS (SELECT fresh.*, story AS cluster_pos FROM fresh JOIN st ON id = pos), per AS (SELECT cluster_pos, max(published_s) AS published_s, count(*) AS n_sources FROM members GROUP BY 1), cl AS (SELECT digest_id, cluster_pos, topic, per.published_s, n_sources FROM members JOIN per USING (cluster_pos) WHERE pos = cluster_pos),
ex AS (SELECT digest_id, -pos - 1 AS id, topic, CAST(1 + pos % 5 AS INTEGER) AS severity, published_s, pos % 6 + 1 AS front_page_rank, published_s + 60 AS created_s FROM news WHERE carded),
cent AS (SELECT cluster_pos, dim, sum(x) / max(n_sources) AS x FROM fv JOIN members ON pos = id JOIN per USING (cluster_pos) GROUP BY 1, 2),
sims AS (SELECT cl.cluster_pos, ex.id AS card_id, sum(cent.x * vec.x) AS sim FROM cl JOIN ex ON ex.digest_id = cl.digest_id AND ex.topic = cl.topic JOIN cent ON cent.cluster_pos = cl.cluster_pos JOIN vec ON vec.id = ex.id AND vec.dim = cent.dim GROUP BY 1, 2),
best AS (SELECT * FROM sims WHERE sim >= {ASK_AT} QUALIFY row_number() OVER (PARTITION BY cluster_pos ORDER BY round(sim, 10) DESC, card_id) = 1), gone AS (SELECT cluster_pos FROM best WHERE (cluster_pos - card_id) % 3 = 0)"""


@query(f"""WITH RECURSIVE {STEPS}, kept AS (SELECT * FROM cl WHERE cluster_pos NOT IN (SELECT cluster_pos FROM gone)), {NEW_BATCHES}, judged AS (SELECT kept.*, batch, severity FROM kept JOIN batches USING (cluster_pos) JOIN reader_verdicts USING (cluster_pos) WHERE notable),
slots AS (SELECT *, row_number() OVER (PARTITION BY digest_id, topic ORDER BY severity DESC, cluster_pos) AS slot FROM judged), {STANDS}, new AS (SELECT digest_id, cluster_pos AS id, topic, severity, published_s, batch, slot, n_sources, CASE WHEN n_sources = 1 THEN 'small' ELSE 'large' END AS writer FROM slots JOIN stands ON card_key = cluster_pos WHERE slot <= 8),
shown AS (SELECT digest_id, id, topic, severity, published_s FROM ex UNION ALL SELECT digest_id, id, topic, severity, published_s FROM new), t AS (SELECT *, row_number() OVER (PARTITION BY digest_id, topic ORDER BY severity DESC, published_s DESC, id) AS trn FROM shown), r AS (SELECT digest_id, id, row_number() OVER (PARTITION BY digest_id ORDER BY trn, severity DESC, published_s DESC, id) AS rk FROM t),
runs AS (SELECT DISTINCT digest_id FROM fresh)
SELECT 'card' AS part, ex.digest_id, ex.id, ex.topic, ex.severity, ex.created_s, CASE WHEN runs.digest_id IS NULL THEN ex.front_page_rank WHEN rk <= 6 THEN rk END AS front_page_rank, CAST(NULL AS BIGINT) AS batch, CAST(NULL AS INTEGER) AS slot, CAST(NULL AS INTEGER) AS n_sources, CAST(NULL AS VARCHAR) AS writer FROM ex JOIN r USING (digest_id, id) LEFT JOIN runs ON runs.digest_id = ex.digest_id
UNION ALL SELECT 'card', new.digest_id, new.id, topic, severity, {NOW_S}, CASE WHEN rk <= 6 THEN rk END, batch, CAST(slot AS INTEGER), CAST(n_sources AS INTEGER), writer FROM new JOIN r USING (digest_id, id)
UNION ALL SELECT 'digest', d.digest_id, NULL, NULL, NULL, CASE WHEN runs.digest_id IS NULL THEN NULL ELSE {NOW_S} END, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT digest_id FROM reader_articles) d LEFT JOIN runs USING (digest_id)""")
def build_edition(m):
    """From landed feeds to persisted cards, and the digests with their cursors, which stand in created_s."""
    return _edition(m)[0]


def _edition(m):
    """(cards and digests as rows, the judged candidates, failures) of the job."""
    lands = m["landings"].where("not carded")
    path = f"{stories.shared_folder(m.spark)}/feeds-{uuid.uuid4().hex}"
    when = F.date_format(F.timestamp_seconds("published_s"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    dated = F.concat(F.lit("</description><pubDate>"), when, F.lit("</pubDate></item>"))
    item = F.regexp_replace(feeds.rss_item(F.col("title"), F.col("url"), F.col("snippet")), "</description></item>$", "")
    rows = lands.select(F.concat(item, dated).alias("value"), F.concat(F.lit("r"), F.col("run_no").cast("string")).alias("run"), F.col("feed_ord").alias("feed"), "nth")
    rows.repartition("run", "feed").sortWithinPartitions("run", "feed", "nth").drop("nth").write.partitionBy("run", "feed").text(path)

    readers = m["readers"].select("user_id", F.concat(F.lit("r"), F.col("run_no").cast("string")).alias("run_id"))
    plan = ingest.feed_plan(m["user_topics"], m["user_sources"], m["dim_feed"], m["dim_topic"])
    planned = plan.select("user_id", "topic", "source", "feed_ord").join(readers.hint("merge"), "user_id")
    run_no = F.substring("run_id", 2, 19).cast("bigint")
    place = ((F.col("user_id") * 1000000 + run_no) * 128 + F.col("feed_ord")) * 100000 + F.col("nth")

    pos = F.col("pos")
    known = stories.written(m["reader_articles"].select("digest_id", "pos", "topic", "title", "snippet", "published_s", "carded", "doc_id"))
    cards = known.where("carded").select("digest_id", (-pos - 1).alias("id"), "topic", (1 + pos % 5).cast("int").alias("severity"), "published_s", (pos % 6 + 1).alias("front_page_rank"), (F.col("published_s") + 60).alias("created_s"), trim_ws(F.col("title")).alias("title"), strip_html(F.col("snippet")).alias("snippet"))
    digests = known.select(F.col("digest_id").alias("id"), F.lit(None).cast("bigint").alias("last_generated_s")).distinct()
    came = known.where("not carded").select("pos", "doc_id")
    given = m["verdicts"].select(F.col("cluster_pos").alias("doc_id"), "notable", "severity")
    verdicts = came.join(given.hint("merge"), "doc_id").select(F.col("pos").alias("cluster_pos"), "notable", "severity")
    attempts = stories.written(m["generations"].withColumnRenamed("card_key", "of"))
    each = m.table("conversations").select("conv_id").distinct().count()
    told = came.withColumn("of", F.col("doc_id") % each).join(attempts.hint("merge"), "of").select(F.col("pos").alias("card_key"), "attempt", "text", "stop_reason")
    judged = []

    def judge(candidates):
        judged.append(candidates.select("cluster_pos", "card_id", ((F.col("cluster_pos") - F.col("card_id")) % 3 == 0).alias("same")))
        return judged[0]

    out, advanced, failures = jobs.edition_from_feeds(m.spark, path, planned, place, m["reader_cursors"], cards, digests, judge, verdicts, told, NOW_S, ATTACH_AT, ASK_AT)
    n = F.size("sources")
    out = out.select(F.lit("card").alias("part"), "digest_id", "id", "topic", "severity", "created_s", "front_page_rank", "batch", "slot", F.when(n > 0, n).alias("n_sources"), "writer")
    ends = advanced.select(F.lit("digest").alias("part"), F.col("id").alias("digest_id"), F.col("last_generated_s").alias("created_s"))
    return out.unionByName(ends, allowMissingColumns=True), judged[0], failures


LAYOUT = DAY + ", seen AS (SELECT day.*, created_s = max(created_s) OVER w AND max(created_s) OVER w <> min(created_s) OVER w AS is_new, row_number() OVER (PARTITION BY digest_id, topic ORDER BY severity DESC, published_s DESC, id) AS topic_place FROM day WHERE date_s BETWEEN 870000000 AND 890000000 WINDOW w AS (PARTITION BY digest_id)), front AS (SELECT digest_id, id, row_number() OVER (PARTITION BY digest_id ORDER BY front_page_rank, id) AS front_place FROM cards WHERE front_page_rank IS NOT NULL QUALIFY front_place <= 6)"


@query("WITH " + LAYOUT + """ SELECT 'day' AS part, digest_id AS owner, seen.id, CAST(place AS INTEGER) AS place, bookmarked, is_new, CASE WHEN severity = 5 THEN 'hero' WHEN severity >= 3 THEN 'medium' ELSE 'small' END AS tier, CAST(topic_place AS INTEGER) AS topic_place, CAST(front_place AS INTEGER) AS front_place FROM seen LEFT JOIN front USING (digest_id, id)
UNION ALL SELECT 'saved', CAST(b.user_id AS VARCHAR), b.card_id, CAST(row_number() OVER (PARTITION BY b.user_id ORDER BY b.created_s DESC, b.card_id) AS INTEGER), NULL, NULL, NULL, NULL, NULL FROM bookmarks b JOIN cards c ON c.id = b.card_id
UNION ALL SELECT 'history', CAST(user_id AS VARCHAR), date_s, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date_s DESC) AS INTEGER), NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT d.user_id, d.date_s, d.id FROM digests d JOIN cards c ON c.digest_id = d.id WHERE d.date_s < 893980800 AND d.date_s BETWEEN 870000000 AND 890000000)""")
def read_edition(m):
    out = jobs.read_edition(m["digests"], m["cards"], m["bookmarks"], TODAY_S, 870000000, 890000000)
    day = out["day"].select(F.lit("day").alias("part"), F.col("digest_id").alias("owner"), "id", "place", "bookmarked", "is_new", "tier", "topic_place", "front_place")
    saved = out["saved"].select(F.lit("saved").alias("part"), F.col("user_id").cast("string").alias("owner"), F.col("card_id").alias("id"), "place")
    history = out["history"].select(F.lit("history").alias("part"), F.col("user_id").cast("string").alias("owner"), F.col("date_s").alias("id"), "place")
    return day.unionByName(saved, allowMissingColumns=True).unionByName(history, allowMissingColumns=True)


@query("WITH " + PRICED + ", " + JUDGED + """, a AS (SELECT run_id, stage, CAST(sum(calls + unmeasured) AS BIGINT) AS n FROM u GROUP BY 1, 2), q AS (SELECT stage, input, row_number() OVER (PARTITION BY stage ORDER BY input) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM usage_calls WHERE measured), runs AS (SELECT run_id, avg(CASE WHEN notable THEN 1.0 ELSE 0.0 END) AS pass_rate, avg(severity) FILTER (WHERE notable) AS mean_severity FROM judged GROUP BY 1), whole AS (SELECT count(DISTINCT run_id) AS runs, sum(list_usd) AS usd FROM priced)
SELECT 'priced' AS section, CAST(run_id AS VARCHAR) AS key, stage || '/' || model AS metric, round(billed_usd, 6) AS value FROM priced
UNION ALL SELECT 'totals', coalesce(stage, 'all'), coalesce(model, 'all'), round(sum(list_usd), 6) FROM priced GROUP BY GROUPING SETS ((stage, model), ())
UNION ALL SELECT 'notices', CAST(run_id AS VARCHAR), model, CASE WHEN bool_or(promo AND billed_usd < list_usd) THEN 1.0 ELSE 0.0 END FROM priced WHERE model = 'large' GROUP BY run_id, model
UNION ALL SELECT 'findings', CAST(e.run_id AS VARCHAR), e.stage, CAST(coalesce(a.n, 0) - e.expected AS DOUBLE) FROM expected_calls e LEFT JOIN a ON a.run_id = e.run_id AND a.stage = e.stage
UNION ALL SELECT 'tokens', stage, 'median', CAST(max(input) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)) AS DOUBLE) FROM q GROUP BY stage
UNION ALL SELECT 'verdicts', run_id, topic, CAST(count(*) FILTER (WHERE notable AND severity >= 3) AS DOUBLE) FROM judged GROUP BY run_id, topic
UNION ALL SELECT 'acceptance', run_id, 'pass_rate', CASE WHEN coalesce(pass_rate BETWEEN 0.2 AND 0.31, FALSE) THEN 1.0 ELSE 0.0 END FROM runs
UNION ALL SELECT 'acceptance', run_id, 'mean_severity', CASE WHEN coalesce(mean_severity BETWEEN 2.0 AND 3.0, FALSE) THEN 1.0 ELSE 0.0 END FROM runs
UNION ALL SELECT 'projection', stage, 'monthly_usd', round(sum(list_usd) / max(whole.runs) * 3000, 3) FROM priced, whole GROUP BY stage
UNION ALL SELECT 'single_source', topic, 'share', round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT topic, cluster_pos, count(*) AS n FROM cluster_articles GROUP BY 1, 2) GROUP BY topic""")
def cost_report(m):
    """The calls as they come from the capture log, and every section of the report as (section, key, metric, value)."""
    c = F.col
    told = F.format_string("[usage] %s %s in=%d out=%d cache_r=%d cache_w=%d $0.001", c("stage"), c("model"), c("input"), c("output"), c("cache_read"), c("cache_write"))
    none = F.format_string("[usage] %s %s no usage reported", c("stage"), c("model"))
    calls = logs.parse_usage_log(m["usage_calls"].select("at_s", "run_id", F.when(c("measured"), told).otherwise(none).alias("value")))
    bands = m.spark.createDataFrame([("pass_rate", 0.2, 0.31), ("mean_severity", 2.0, 3.0)], "metric string, low double, high double")
    out = jobs.cost_report(calls, m["expected_calls"], _judged(m), m["cluster_articles"], bands, dims.dim_price(m.spark), dims.dim_promo(m.spark), 100, 30)
    keyed = {
        "priced": ("run_id", F.concat_ws("/", "stage", "model"), F.round("billed_usd", 6)),
        "totals": (F.coalesce("stage", F.lit("all")), F.coalesce("model", F.lit("all")), F.round("list_usd", 6)),
        "notices": ("run_id", "model", c("applied").cast("int")),
        "findings": ("run_id", "stage", "gap"),
        "tokens": ("stage", F.lit("median"), "median"),
        "verdicts": ("run_id", "topic", "severe"),
        "acceptance": ("run_id", "metric", c("passed").cast("int")),
        "projection": ("stage", F.lit("monthly_usd"), F.round("monthly_usd", 3)),
        "single_source": ("topic", F.lit("share"), F.round("share", 6)),
    }
    column = lambda x: F.col(x) if isinstance(x, str) else x
    parts = [out[name].select(F.lit(name).alias("section"), column(k).cast("string").alias("key"), column(metric).alias("metric"), column(v).cast("double").alias("value")) for name, (k, metric, v) in keyed.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
