"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table
from .conversations import damaged, repair
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .line_dedup import line_dedup
from .mixing import mixing_rates
from .packed_output import written_sequences
from .packing import pack
from .pii import find_pii
from .quality import fit, judge
from .ranked_search import search
from .url_filter import url_verdicts
from .warc import archive_round_trip


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_pii(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_packed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written matrices, with digests in place of the id and position rows."""
    prepare(spark)
    out = written_sequences(table(spark, sf_dir, "documents"))
    return out.select("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = table(spark, sf_dir, "conversations")
    return repair(damaged(rows), rows.select("conv_id"), digest=True)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_url_filter, op3_pii, op4_exact_dedup, op5_best_fit_packing, op6_quality_rules, op7_packed_output, op8_mixing, op9_warc, op10_jaccard_join, op11_ranked_search, op12_conversation_repair, op13_decontaminate, pipeline)
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULES = (("example.org", "/es/", "example.org/es/", "block"), ("example.org", "/en/1", "example.org/en/1", "block"), ("com", "/fr/", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("org", "/", "org/", "allow"))


def _rule_sql(host: str, path: str, what: int) -> str:
    """The longest rule first; what: 2 for the rule, 3 for its verdict."""
    cases = " ".join(f"WHEN ({host} = '{r[0]}' OR {host} LIKE '%.{r[0]}') AND starts_with({path}, '{r[1]}') THEN '{r[what]}'" for r in _RULES)
    return f"CASE {cases} END"


def _host_sql(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {_AZ}), '')"


def _path_sql(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"




def _crc32_sql(ascii_text: str) -> str:
    bits = "list_reduce(range(8), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({ascii_text}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: {bits}, 4294967295), 4294967295)"


def _put(x: str, edit: str, cost: int | str) -> str:
    """An audit behind its cost in ten digits, with one more edit before it; text order is then that of the contract."""
    return f"(printf('%010d', CAST(substr({x}, 1, 10) AS BIGINT) + {cost}) || '{edit}' || substr({x}, 11))"


def _edit_sql() -> str:
    """The best audits b0 to b3 of the four states before a row, given n0 to n3 after it."""
    keep = ("WHEN 's' THEN 1 WHEN 'u' THEN 2", "WHEN 'u' THEN 2", "WHEN 'a' THEN 3", "WHEN 'u' THEN 2")
    out = []
    for q, to in enumerate((2, 2, 3, 2)):
        kept = " ".join(f"WHEN '{c}' THEN {_put(f'n{t}', 'K', 'more')}" for c, t in zip(keep[q].split("'")[1::2], keep[q].split(" THEN ")[1:], strict=True) for t in [t[0]])
        out.append(f"CASE WHEN gone THEN {_put(f'n{q}', 'D', 3)} ELSE least({_put(f'n{q}', 'D', 3)}, {_put(f'n{to}', 'R', '2 + more')}, CASE initial {kept} ELSE 'x' END) END AS b{q}")
    return ", ".join(out)


def _node_sql(url: str) -> str:
    """A url without its fragment, scheme and host in lower case and / for an empty path; null without ://."""
    path = rf"CASE {_path_sql(url)} WHEN '' THEN '/' ELSE {_path_sql(url)} END"
    return rf"CASE WHEN contains({url}, '://') THEN translate(regexp_extract({url}, '(?s)^(.*?)://', 1), {_AZ}) || '://' || {_host_sql(url)} || {path} || regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) END"


def _value_sql(tag: str, name: str) -> str:
    """The value of an attribute; no tag of the tables' pages has entities or paths with dots, which tests hold."""
    return rf"""trim(regexp_extract({tag}, '(?is)[\s"'']{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '"'' ')"""


ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH l AS (
  SELECT doc_id, i, x AS line,
         translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), h AS (
  SELECT k, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM l WHERE length(k) >= 10 GROUP BY k
), j AS (
  SELECT l.doc_id, l.i, l.line, coalesce(h.n > 1 AND h.first <> l.doc_id, FALSE) AS gone FROM l LEFT JOIN h USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op2_url_filter": rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html, {_host_sql("url")} AS host, {_path_sql("url")} AS path, {_node_sql("url")} AS node FROM pages
), t AS (
  SELECT url, unnest([
    list_filter(list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda x: [{_value_sql("x", "rel")}, {_value_sql("x", "href")}]), lambda x: list_contains(regexp_split_to_array(lower(x[1]), '\s+'), 'canonical'))[1][2],
    regexp_extract(list_filter(list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda x: [{_value_sql("x", "http-equiv")}, {_value_sql("x", "content")}]), lambda x: lower(x[1]) = 'refresh')[1][2], '(?is)\burl\s*=\s*["'']?\s*([^"''\s]+)', 1)
  ]) AS a FROM p WHERE contains(url, '://')
), w AS (
  SELECT url, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS name, {_path_sql("url")} AS path, regexp_replace(a, '(?s)#.*$', '') AS a FROM t WHERE a <> ''
), x AS (
  SELECT url, CASE WHEN regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN a WHEN regexp_matches(a, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(a, '//') THEN scheme || ':' || a
    WHEN starts_with(a, '/') THEN scheme || '://' || name || a WHEN starts_with(a, '?') THEN scheme || '://' || name || path || a WHEN a = '' THEN regexp_replace(url, '(?s)#.*$', '')
    ELSE scheme || '://' || name || CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE '/' END || a END AS u
  FROM w
), e AS (
  SELECT {_node_sql("url")} AS src, {_node_sql("u")} AS dst FROM x WHERE u IS NOT NULL
), both_ways AS (
  SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other
), ruled AS (
  SELECT node, {_rule_sql(_host_sql("other"), _path_sql("other"), 3)} AS v FROM reach
), spread AS (
  SELECT node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' ELSE 'allow' END AS v FROM ruled GROUP BY node
)
SELECT page_id, host, path, {_rule_sql("host", "path", 2)} AS rule,
       coalesce({_rule_sql("host", "path", 3)}, s.v, 'allow') AS verdict
FROM p LEFT JOIN spread s ON s.node = p.node
""",
    "op4_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
""",
    "op9_warc": """
WITH d AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages
), f AS (
  SELECT x, min(page_id) AS first FROM d GROUP BY x
), b AS (
  SELECT x, array_to_string(list_transform(string_split(x, ''), lambda c: right('000' || bin(strpos('0123456789abcdef', c) - 1), 4)), '') AS bits FROM f
), g AS (
  SELECT x, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(5), lambda k: CASE WHEN substr(bits, CAST(5 * i + k + 1 AS BIGINT), 1) = '1' THEN [16, 8, 4, 2, 1][k + 1] ELSE 0 END)) AS BIGINT), 1)), '') AS payload_digest FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (x) JOIN g USING (x)
""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS class FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, x.b FROM reach r JOIN both_ways x ON x.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
       CASE WHEN n.n IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY n.class) END AS class_size
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op11_ranked_search": rf"""
WITH t AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}')) AS term FROM documents) GROUP BY 1, 2
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY 1
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_TERM}')) AS term FROM benchmark
), x AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (doc_id), s GROUP BY 1, 2
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 50
""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE k <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM d
), f AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prior, solid = '' AS blank,
         solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM o
), g AS (
  SELECT *, blank OR duplicate AS gone, CASE WHEN NOT (blank OR duplicate) AND right(solid, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS more FROM f
), v AS (
  SELECT conv_id, max(i) + 1 AS i, '0000000000' AS n0, '0000000004II' AS n1, '0000000002I' AS n2, '0000000000' AS n3 FROM g GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(b0, {_put("least(b2, " + _put("b3", "I", 2) + ")", "I", 2)}), least(b1, {_put("least(b2, " + _put("b3", "I", 2) + ")", "I", 2)}),
         least(b2, {_put("b3", "I", 2)}), least(b3, {_put("b2", "I", 2)})
  FROM (SELECT v.conv_id, g.i, {_edit_sql()} FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.i = v.i - 1)
), a AS (
  SELECT conv_id, CAST(substr(n0, 1, 10) AS BIGINT) AS cost, substr(n0, 11) AS audit FROM v WHERE i = 1
), e AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS at_edit FROM a WHERE audit <> ''
), p AS (
  SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w - 1 AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY at_edit)
), q AS (
  SELECT p.*, g.role, g.text, coalesce(max(CASE WHEN edit = 'K' AND place = 0 AND g.initial = 's' THEN 1 END) OVER (PARTITION BY p.conv_id), 0) AS system
  FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i AND p.edit <> 'I' WHERE edit <> 'D'
), r AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS x FROM q GROUP BY conv_id
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE more = 1) AS truncated, count(*) FILTER (WHERE i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id
)
SELECT t.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(x, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
""",
    "op13_decontaminate": rf"""
WITH i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS ws FROM benchmark
), v AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(1, CAST(len(ws) AS BIGINT) - 9) + 1)) AS s FROM i WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS s FROM d
), o AS (
  SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS win FROM p, (SELECT DISTINCT n FROM v) WHERE s + n - 1 <= len(ws)
), f AS (
  SELECT o.doc_id, o.s, o.n, v.item FROM o JOIN v USING (n, win)
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM f) GROUP BY doc_id
), g AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS x FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
""",
}
