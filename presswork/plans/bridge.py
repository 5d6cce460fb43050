"""Model views over the driver's tables. The same SQL text defines a view for Spark and for the SQL oracles.

EPOCH(x) stands for whole seconds since 1970 of a timestamp, EACH[a, b] for a row of each value. Times are epoch seconds
throughout, so both engines agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dims

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Views of preferences, the rows that they make of a customer, and the rows that a task should work: a file of keys alone is
#: small for what comes of it, so its customers are dealt over tasks first.
PREFERENCES, EXPLODED, ROWS_A_TASK = ("user_topics", "user_sources"), 12, 1 << 19
#: The instant that the article views take as now.
NOW_S = 1706572800

VIEWS = {
    "dim_topic": dims.values_sql([(t, i, dims.slug(t)) for i, t in enumerate(dims.TOPICS)], "topic, ord, slug"),
    "dim_source": dims.values_sql([(s, i) for i, s in enumerate(dims.SOURCES)], "source, ord"),
    "dim_feed": dims.values_sql(dims.feed_rows(), "topic, source, url, feed_ord"),
    # Customers as users. Each follows five topics and twelve sources, in no particular order; some store an unknown or a
    # repeated topic, or no source.
    "user_topics": f"SELECT /*+ BROADCAST(dim_topic) */ user_id, topic FROM (SELECT user_id, (user_id * 7 + k) % {len(dims.TOPICS)} AS ord FROM (SELECT c_custkey AS user_id, EACH[0, 3, 6, 9, 12] AS k FROM customer) c) x JOIN dim_topic USING (ord)"
    " UNION ALL SELECT c_custkey AS user_id, 'Gardening' AS topic FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT c_custkey AS user_id, 'Tennis' AS topic FROM customer WHERE c_custkey % 4 = 0",
    "user_sources": f"SELECT /*+ BROADCAST(dim_source) */ user_id, source FROM (SELECT user_id, (user_id * 5 + k) % {len(dims.SOURCES)} AS ord FROM (SELECT c_custkey AS user_id, EACH[{', '.join(str(11 * k) for k in range(12))}] AS k FROM customer WHERE c_custkey % 50 <> 3) c) x JOIN dim_source USING (ord)",
    # A thousand articles a user and a run, so both grow with the table. Copies of a text share its url.
    "articles": f"SELECT concat('u', CAST(CAST(floor(doc_id / 5000.0) AS BIGINT) * 5 + doc_id % 5 AS STRING)) AS user_id, concat('r', CAST(CAST(floor(doc_id / 4000.0) AS BIGINT) * 4 + doc_id % 4 AS STRING)) AS run_id, doc_id AS pos, substr(coalesce(text, ''), 1, 60) AS title, substr(coalesce(text, ''), 61) AS snippet, CASE WHEN doc_id % 97 = 0 THEN '' ELSE concat('https://news.example/', md5(coalesce(text, ''))) END AS url, source, lang AS topic, {NOW_S} - (doc_id * 7919 % 259200) AS published_s FROM documents",
    # The same texts as items of feeds, a quarter of four thousand a run. Five readers follow the runs of four thousand texts,
    # so readers, runs and what each of them gets grow with the table as they would. Every eleventh text was carded before.
    "landings": f"SELECT *, row_number() OVER (PARTITION BY run_no, feed_ord, carded ORDER BY doc_id) - 1 AS nth FROM (SELECT doc_id, CAST(floor(doc_id / 4000.0) AS BIGINT) * 4 + doc_id % 4 AS run_no, CAST(CAST(floor(doc_id / 4.0) AS BIGINT) % {len(dims.FEEDS)} AS INT) AS feed_ord, doc_id % 11 = 5 AS carded, substr(coalesce(text, ''), 1, 60) AS title, substr(coalesce(text, ''), 61) AS snippet, CASE WHEN doc_id % 97 = 0 THEN '' ELSE concat('https://news.example/', md5(coalesce(text, ''))) END AS url, {NOW_S} - (doc_id * 7919 % 259200) AS published_s FROM documents) d",
    "readers": "SELECT DISTINCT run_no, CAST(floor(run_no / 4.0) AS BIGINT) * 5 + k + 1 AS user_id FROM (SELECT run_no, EACH[0, 1, 2, 3, 4] AS k FROM (SELECT DISTINCT run_no FROM landings) r) x",
    "reader_articles": "SELECT concat(CAST(p.user_id AS STRING), '/r', CAST(l.run_no AS STRING)) AS digest_id, p.user_id, ((p.user_id * 1000000 + l.run_no) * 128 + l.feed_ord) * 100000 + CASE WHEN l.carded THEN 50000 ELSE 0 END + l.nth AS pos, f.topic, l.title, l.snippet, l.url, l.published_s, l.carded, l.doc_id FROM readers p JOIN (SELECT DISTINCT user_id, topic FROM user_topics) t ON t.user_id = p.user_id JOIN dim_feed f ON f.topic = t.topic JOIN (SELECT DISTINCT user_id, source FROM user_sources) s ON s.user_id = p.user_id AND s.source = f.source JOIN landings l ON l.run_no = p.run_no AND l.feed_ord = f.feed_ord",
    "reader_cursors": f"SELECT DISTINCT user_id, CASE user_id % 5 WHEN 1 THEN {NOW_S} - 86400 WHEN 2 THEN {NOW_S} + 301 WHEN 4 THEN {NOW_S} - 864000 ELSE CAST(NULL AS BIGINT) END AS cursor_s FROM readers",
    "reader_verdicts": "SELECT pos AS cluster_pos, quality = 1 AS notable, CAST(1 + a.doc_id % 5 AS INT) AS severity FROM reader_articles a JOIN labels l ON l.doc_id = a.doc_id WHERE NOT carded",
    # Both attempts of a conversation for every article, so each may become a card.
    "reader_generations": "SELECT pos AS card_key, attempt, text, stop_reason FROM reader_articles a JOIN generations g ON g.card_key = a.doc_id % (SELECT count(DISTINCT conv_id) FROM conversations) WHERE NOT carded",
    "cursors": f"SELECT DISTINCT user_id, CASE user_id WHEN 'u0' THEN {NOW_S} - 86400 WHEN 'u1' THEN {NOW_S} + 300 WHEN 'u2' THEN {NOW_S} + 301 WHEN 'u3' THEN {NOW_S} - 864000 ELSE CAST(NULL AS BIGINT) END AS cursor_s FROM articles",
    "feed_items": "SELECT page_id, url, html FROM pages",
    "clusters": "SELECT run_id, topic, pos AS cluster_pos, title, snippet, url, source, published_s FROM articles",
    "cluster_articles": "SELECT CAST(floor(doc_id / 3.0) AS BIGINT) AS cluster_pos, doc_id AS pos, lang AS topic, source, substr(coalesce(text, ''), 1, 60) AS title, substr(coalesce(text, ''), 61) AS snippet, concat('https://news.example/', CAST(doc_id AS STRING)) AS url, 1706572800 - (doc_id * 7919 % 86400) - CASE WHEN doc_id % 2 = 0 THEN (doc_id * 7919 % 3) ELSE 0 END AS published_s FROM documents",
    "verdicts": "SELECT doc_id AS cluster_pos, quality = 1 AS notable, CAST(1 + doc_id % 5 AS INT) AS severity FROM labels",
    "vectors": "SELECT vec_id AS id, concat('t', CAST(label AS STRING)) AS topic, embedding FROM embeddings",
    # Sixty customers' orders make a reader's cards, and a month of them a digest, so both grow with the table.
    "cards": "SELECT o.o_orderkey AS id, CAST(floor(o.o_custkey / 60.0) AS BIGINT) AS user_id, EPOCH(date_trunc('month', o.o_orderdate)) AS date_s, concat(CAST(CAST(floor(o.o_custkey / 60.0) AS BIGINT) AS STRING), '-', CAST(EPOCH(date_trunc('month', o.o_orderdate)) AS STRING)) AS digest_id, o.o_orderstatus AS topic, 6 - CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS severity, EPOCH(o.o_orderdate) AS published_s, EPOCH(date_trunc('month', o.o_orderdate)) + 2678400 + o.o_orderkey % 3 * 3600 AS created_s, CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(floor(o.o_orderkey / 3.0) AS BIGINT) % 6 + 1 ELSE CAST(NULL AS BIGINT) END AS front_page_rank, CASE WHEN o.o_orderkey % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat('Order ', CAST(o.o_orderkey AS STRING)) END AS title, CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('report ', CAST(o.o_orderkey AS STRING)) END AS expanded_report, concat(' ', o.o_orderpriority, ' |', o.o_orderstatus, '| ') AS labels_text FROM orders o",
    "digests": "SELECT digest_id AS id, user_id, date_s, CASE WHEN max(id) % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE max(published_s) END AS last_generated_s, max(id) % 3 = 0 AS generating, max(published_s) - max(id) % 240 AS started_s FROM cards GROUP BY digest_id, user_id, date_s UNION ALL SELECT concat(CAST(n_nationkey AS STRING), '-empty') AS id, n_nationkey AS user_id, 1704067200 AS date_s, CASE WHEN n_nationkey % 2 = 0 THEN 4102444800 ELSE CAST(NULL AS BIGINT) END AS last_generated_s, FALSE AS generating, CAST(NULL AS BIGINT) AS started_s FROM nation",
    "bookmarks": "SELECT user_id, id AS card_id, published_s + id % 86400 AS created_s FROM cards WHERE id % 7 = 0 UNION ALL SELECT n_nationkey AS user_id, -1 AS card_id, 0 AS created_s FROM nation",
    "card_sources": "SELECT l_orderkey AS card_id, l_linenumber AS pos, l_partkey AS part, l_returnflag AS source FROM lineitem",
    "usage_calls": "SELECT user_id AS run_id, EPOCH(ts) + 63072000 AS at_s, event_type AS stage, CASE WHEN user_id % 2 = 0 THEN 'large' ELSE 'small' END AS model, CAST(floor(value * 100) AS BIGINT) AS input, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS output, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 7 AS cache_read, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS cache_write, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 <> 0 AS measured FROM events",
    "expected_calls": "SELECT user_id AS run_id, event_type AS stage, max(event_id) % 90 AS expected FROM events GROUP BY user_id, event_type UNION ALL SELECT DISTINCT user_id AS run_id, 'ranking' AS stage, 1 AS expected FROM events",
    "progress": "SELECT user_id AS run_id, event_id AS seq, event_type AS stage, EPOCH(ts) AS at_s FROM events",
    "generations": "SELECT conv_id AS card_key, CAST(CASE WHEN turn = 0 THEN 1 ELSE 2 END AS INT) AS attempt, CASE WHEN conv_id % 9 = 0 AND turn = 0 THEN '' WHEN (conv_id + turn) % 4 = 0 THEN substr(text, 1, 12) ELSE text END AS text, CASE WHEN conv_id % 5 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason FROM conversations WHERE turn IN (0, 2)",
}


def needed(name: str, found: list[str] | None = None) -> list[str]:
    """The views that a view or query text rests on, each after those it needs itself."""
    found = [] if found is None else found
    for other in VIEWS:
        if re.search(rf"\b{other}\b", VIEWS.get(name, name)) and other != name and other not in found:
            needed(other, found)
    if name in VIEWS and name not in found:
        found.append(name)
    return found


def _with(names: list[str], epoch: str, each: str) -> str:
    views = {n: re.sub(r"EACH\[([^]]*)\]", each, re.sub(r"EPOCH[(]", epoch, VIEWS[n])) for n in names}
    parts = [f"{n} AS ({text})" for n, text in views.items()]
    return f"WITH {', '.join(parts)} " if parts else ""


class Model:
    """The model views of one data folder: Model(spark, sf_dir)["cards"]."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A model view over streams of its tables' files; the pattern fits a table of one file or a folder of them."""
        return self._view(name, lambda t: self.spark.readStream.schema(self.table(t).schema).parquet(f"{self.sf_dir}/{t}.parquet*"))

    def __getitem__(self, name: str) -> DataFrame:
        if not set(needed(name)) & set(PREFERENCES):
            return self._view(name, self.table)
        tasks = -(-self.table("customer").count() * EXPLODED // ROWS_A_TASK)
        if tasks < 2:
            return self._view(name, self.table)
        rows = self._view(name, lambda t: self.table(t).repartition(tasks, "c_custkey") if t == "customer" else self.table(t))
        return rows.repartition(tasks, "user_id") if name == "user_topics" else rows  # its union forgets how they were dealt

    def _view(self, name: str, read: Callable[[str], DataFrame]) -> DataFrame:
        views = needed(name)
        text = " ".join(VIEWS[v] for v in views)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                read(t).createOrReplaceTempView(t)
        return self.spark.sql(_with(views, "unix_timestamp(", r"explode(array(\1))") + f"SELECT * FROM {name}")


def oracle(query: str) -> str:
    """An oracle query over the model views, as one SQL text for DuckDB."""
    head = _with(needed(query), "EPOCH(", r"unnest([\1])")
    query = re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", query.strip())
    query = re.sub(r"\b(\w+) -> ", r"lambda \1: ", query)
    recursive = query.upper().startswith("WITH RECURSIVE ")
    if recursive:
        query, head = "WITH " + query[15:], head.replace("WITH ", "WITH RECURSIVE ", 1) or "WITH RECURSIVE "
    if query.upper().startswith("WITH "):
        query = query[5:]
        head = "WITH " if not head else head if head.endswith("RECURSIVE ") else head.rstrip() + ", "
        return _epochs(head + query)
    return _epochs(head + query)


def _epochs(text: str) -> str:
    """DuckDB's epoch() is a double; make it whole seconds."""
    out, at = "", 0
    for m in re.finditer(r"\bEPOCH\(", text):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        if m.start() < at:
            continue
        out += text[at : m.start()] + f"CAST(floor(epoch({text[m.end() : end]}) AS BIGINT)"
        at = end
    return out + text[at:]
