"""Queries that apply the column expressions to whole tables, with SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from .bridge import NOW_S, Model, oracle

Q: dict = {}
SQL: dict[str, str] = {}
_TRIM = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_TRIM}+|{_TRIM}+$', '', 'g')"


def query(sql: str | None):
    def register(f):
        Q[f.__name__] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            SQL[f.__name__] = oracle(sql)
        return f

    return register


def _groups(m: Model):
    a = F.struct("pos", "title", "snippet", "source", "url", "published_s")
    return m["cluster_articles"].groupBy("cluster_pos").agg(F.array_sort(F.collect_list(a)).alias("items"))


@query("SELECT page_id, md5(" + _trim("regexp_replace(html, '<[^>]*>', '', 'g')") + ") AS stripped FROM feed_items")
def strip_html(m):
    return m["feed_items"].select("page_id", F.md5(X.strip_html(F.col("html")).cast("binary")).alias("stripped"))


@query("SELECT doc_id, md5(" + _trim("concat(chr(160), ' ', text, chr(10), chr(8195))") + ") AS trimmed FROM documents")
def trim_ws(m):
    padded = F.concat(F.lit("  "), "text", F.lit("\n "))
    return m.table("documents").select("doc_id", F.md5(X.trim_ws(padded).cast("binary")).alias("trimmed"))


@query(f"SELECT doc_id, CASE doc_id % 8 WHEN 2 THEN {NOW_S} WHEN 3 THEN {NOW_S} ELSE 1704067200 + (doc_id % 28) * 86400 + CASE doc_id % 8 WHEN 4 THEN 11040 WHEN 5 THEN 29045 WHEN 6 THEN 5640 ELSE 0 END END AS published_s FROM documents")
def published_or_now(m):
    day = (F.col("doc_id") % 28 + 1).cast("string")
    two = F.lpad(day, 2, "0")
    forms = {
        0: ("2024-01-", two, "T00:00:00Z"),
        1: ("Mon, ", day, " Jan 2024 00:00:00 +0000"),
        2: ("soon",),
        4: ("Tue, ", two, " Jan 24 3:04 GMT"),
        5: (day, " Jan 2024 03:04:05 EST"),
        6: ("2024-01-", two, "T03:04+0130"),
        7: ("January ", day, ", 2024"),
    }
    parts = [F.when(F.col("doc_id") % 8 == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in form))) for k, form in forms.items()]
    return m.table("documents").select("doc_id", X.published_or_now(F.coalesce(*parts), F.lit(NOW_S)).cast("bigint").alias("published_s"))


@query("SELECT pos, title || '. ' || snippet AS text FROM articles")
def article_text(m):
    return m["articles"].select("pos", X.article_text(F.col("title"), F.col("snippet")).alias("text"))


@query("SELECT cluster_pos, string_agg(title || '. ' || substr(snippet, 1, 200), ' ' ORDER BY pos) AS text FROM cluster_articles GROUP BY cluster_pos")
def cluster_text(m):
    return _groups(m).select("cluster_pos", X.cluster_text(F.col("items")).alias("text"))


@query("SELECT cluster_pos, string_agg('- ' || title || chr(10) || '  ' || substr(snippet, 1, 200), chr(10) ORDER BY pos) AS context FROM cluster_articles GROUP BY cluster_pos")
def cluster_context(m):
    return _groups(m).select("cluster_pos", X.cluster_context(F.col("items")).alias("context"))


@query("SELECT cluster_pos, string_agg('Source: ' || source || chr(10) || 'Title: ' || title || chr(10) || substr(snippet, 1, 1200), chr(10) || chr(10) ORDER BY pos) AS text FROM cluster_articles GROUP BY cluster_pos")
def source_text(m):
    return _groups(m).select("cluster_pos", X.source_text(F.col("items")).alias("text"))


@query("SELECT pos, CAST(pos AS VARCHAR) || '. [' || topic || ', severity ' || CAST(1 + pos % 5 AS VARCHAR) || '] ' || substr(snippet, 1, 300) AS line FROM articles")
def candidate_line(m):
    return m["articles"].select("pos", X.candidate_line(F.col("pos"), F.col("topic"), F.col("pos") % 5 + 1, F.col("snippet")).alias("line"))


@query("WITH f AS (SELECT doc_id, " + _trim(f"replace(regexp_replace(text, '{_TRIM}+', ' ', 'g'), '\"', '''')") + " AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS flat FROM f")
def flatten_text(m):
    return m.table("documents").select("doc_id", X.flatten_text(F.col("text"), 120).alias("flat"))


@query("SELECT a.id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), x -> CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 5) AS sim FROM vectors a JOIN vectors b ON b.id = a.id - a.id % 2")
def cosine(m):
    v = m["vectors"]
    other = v.select((F.col("id")).alias("even"), F.col("embedding").alias("with"))
    both = v.join(other, (F.col("id") - F.col("id") % 2) == F.col("even"))
    return both.select("id", F.round(X.cosine(F.col("embedding"), F.col("with")), 5).alias("sim"))


@query("SELECT conv_id, turn, regexp_matches(" + _trim("text") + ", '[.!?][\"'')\\]]?$') AS complete FROM conversations")
def looks_complete(m):
    return m.table("conversations").select("conv_id", "turn", X.looks_complete(F.col("text")).alias("complete"))


_COMPLETE = """[.!?]["'')\\]]?$"""
#: attempts(card_key, t1, t2, disposition), with the texts of both attempts trimmed as everywhere; for the jobs too.
ATTEMPTS = f"""ga AS (SELECT card_key, {_trim("coalesce(text, '')")} AS t1, stop_reason AS s1 FROM generations WHERE attempt = 1), gb AS (SELECT card_key, {_trim("text")} AS t2 FROM generations WHERE attempt = 2),
attempts AS (SELECT card_key, t1, t2, CASE WHEN t1 = '' THEN 'failed_empty' WHEN regexp_matches(t1, '{_COMPLETE}') THEN 'first' WHEN s1 IS DISTINCT FROM 'end_turn' THEN 'failed_truncated' WHEN t2 IS NULL THEN 'to_retry' WHEN regexp_matches(t2, '{_COMPLETE}') THEN 'retry' ELSE 'failed_retry' END AS disposition FROM ga LEFT JOIN gb USING (card_key))"""


@query(f"WITH {ATTEMPTS} SELECT card_key, disposition, CASE disposition WHEN 'first' THEN t1 WHEN 'retry' THEN t2 END AS winner FROM attempts")
def generation_disposition(m):
    from ..operators.edition import resolve_generations

    out = resolve_generations(m["generations"])
    return out.select("card_key", "disposition", X.trim_ws(F.col("text")).alias("winner"))


@query("SELECT cluster_pos, CASE count(*) WHEN 1 THEN 'small' ELSE 'large' END AS route FROM cluster_articles GROUP BY cluster_pos")
def writer_route(m):
    return _groups(m).select("cluster_pos", X.writer_route(F.size("items")).alias("route"))


@query("SELECT id, array_to_string(list_filter(list_transform(string_split(labels_text, '|'), x -> trim(x)), x -> x <> ''), ',') AS labels FROM cards")
def clean_labels(m):
    return m["cards"].select("id", F.array_join(X.clean_labels(F.split("labels_text", "\\|")), ",").alias("labels"))


@query("""SELECT event_id, CASE WHEN g THEN i END AS input, CASE WHEN g THEN o END AS output, CASE WHEN g THEN coalesce(r, 0) END AS cache_read FROM (
SELECT event_id, i, o, r, i >= 0 AND o >= 0 AND o IS NOT NULL AND coalesce(r >= 0, TRUE) AS g FROM (
SELECT event_id, CAST(floor(value * 10) AS BIGINT) - 50 AS i, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 END AS o, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 17 - 1 END AS r FROM events))""")
def normalize_usage(m):
    e = F.col("event_id")
    i, o, r = F.floor(F.col("value") * 10) - 50, F.when(e % 11 != 0, e % 100), F.when(e % 3 != 0, e % 17 - 1)
    t = X.normalize_usage(i, o, r, F.lit(None).cast("bigint"))
    out = m.table("events").select("event_id", t.alias("t"))
    return out.select("event_id", "t.input", "t.output", "t.cache_read")


@query("SELECT run_id, stage, at_s, input, round((input * 3.0 + cache_write * 3.0 * 1.25 + cache_read * 3.0 * 0.1 + output * 15.0) / 1000000.0, 8) AS usd FROM usage_calls")
def token_cost(m):
    c = F.col
    usd = X.token_cost(c("input"), c("output"), c("cache_read"), c("cache_write"), F.lit(3.0), F.lit(15.0), F.lit(0.1), F.lit(1.25))
    return m["usage_calls"].select("run_id", "stage", "at_s", "input", F.round(usd, 8).alias("usd"))


@query("SELECT id, strftime(to_timestamp(published_s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM cards")
def utc_date(m):
    return m["cards"].select("id", X.utc_date(F.col("published_s")).cast("string").alias("day"))


@query(f"SELECT user_id, coalesce(cursor_s <= {NOW_S} + 300, FALSE) AS plausible FROM cursors")
def plausible_cursor(m):
    ok = X.plausible_cursor(F.col("cursor_s"), F.lit(NOW_S))
    return m["cursors"].select("user_id", F.coalesce(ok, F.lit(False)).alias("plausible"))


@query("""SELECT part, label, CAST(h % 6 + 1 AS INTEGER) AS bucket FROM (SELECT p_partkey AS part, p_name AS label,
list_reduce(list_transform(string_split(lower(trim(p_name)), ''), x -> CAST(unicode(x) AS BIGINT)), (h, u) -> (xor(h, u) * 16777619) % 4294967296, 2166136261::BIGINT) AS h FROM part)""")
def label_bucket(m):
    return m.table("part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("label"), X.label_bucket(F.col("p_name")).alias("bucket"))


@query("SELECT o_orderkey AS id, CASE WHEN floor(s + 0.5) >= 5 THEN 'hero' WHEN floor(s + 0.5) >= 3 THEN 'medium' ELSE 'small' END AS tier FROM (SELECT o_orderkey, o_orderkey % 17 * 0.5 AS s FROM orders)")
def tier_for_severity(m):
    return m.table("orders").select(F.col("o_orderkey").alias("id"), X.tier_for_severity((F.col("o_orderkey") % 17) * 0.5).alias("tier"))


@query("SELECT o_orderkey AS id, CASE WHEN floor(s + 0.5) <= 1 THEN 'hero' WHEN floor(s + 0.5) <= 5 THEN 'medium' ELSE 'small' END AS tier FROM (SELECT o_orderkey, o_orderkey % 17 * 0.5 AS s FROM orders)")
def tier_for_rank(m):
    return m.table("orders").select(F.col("o_orderkey").alias("id"), X.tier_for_rank((F.col("o_orderkey") % 17) * 0.5).alias("tier"))


@query("SELECT u.user_id, u.topic, t.slug FROM user_topics u LEFT JOIN dim_topic t ON t.topic = u.topic")
def topic_slug(m):
    return m["user_topics"].join(F.broadcast(m["dim_topic"].select("topic", "slug")), "topic", "left").select("user_id", "topic", "slug")


@query("SELECT id, coalesce(title, '') AS title, coalesce(labels_text, '') AS labels, coalesce(severity, 1) AS severity, created_s AS generated_s FROM cards")
def card_view(m):
    from ..operators.reads import card_view as view

    return view(m["cards"]).select("id", "title", F.col("labels_text").alias("labels"), "severity", "generated_s")


@query(f"""WITH a AS (SELECT pos, CAST(floor(({NOW_S} - published_s) / 60.0 + 0.5) AS BIGINT) AS mi FROM articles), b AS (SELECT pos, mi, CAST(floor(mi / 60.0 + 0.5) AS BIGINT) AS ho FROM a)
SELECT recency, count(*) AS n FROM (SELECT CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN mi || 'm ago' WHEN ho < 24 THEN ho || 'h ago' ELSE CAST(floor(ho / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS recency FROM b) GROUP BY recency""")
def recency_bucket(m):
    return m["articles"].groupBy(X.recency_bucket(F.col("published_s"), F.lit(NOW_S)).alias("recency")).agg(F.count("*").alias("n"))


@query("""SELECT id, regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS date_ok, u = 'a3bb189e-8bf9-3888-9912-ace4e6543002' AS uuid_ok FROM (
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '1998-1-02' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'a3bb189e-8bf9-3888-9912-ace4e6543002' ELSE 'a3bb189e8bf938889912ace4e6543002' END AS u FROM orders)""")
def valid_formats(m):
    k = F.col("o_orderkey")
    d = F.when(k % 3 == 0, "1998-1-02").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    u = F.when(k % 2 == 0, "a3bb189e-8bf9-3888-9912-ace4e6543002").otherwise("a3bb189e8bf938889912ace4e6543002")
    return m.table("orders").select(k.alias("id"), X.valid_date(d).alias("date_ok"), X.valid_uuid(u).alias("uuid_ok"))
