"""URL filters: block rules, spread to aliases along redirect and canonical-link edges. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_groups, materialize

#: (verdict, host/path); the host holds for all its subdomains too.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(url.contains("://"), F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. Of equally long rules the first in
    alphabetical order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def page_node(url: Column) -> Column:
    """The page that a url names: its scheme and host in lower case, path and query, without a fragment; an empty path is /.
    Null for a url without ://, which names no page."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    return F.when(url.contains("://"), F.concat(F.translate(part(1), UPPER, LOWER), F.lit("://"), F.translate(part(2), UPPER, LOWER), path, part(4)))


def _without_dots(path: Column) -> Column:
    """A path without the segments . and .., and what these take away."""
    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).otherwise(F.array_append(acc, s)))
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))


def resolved(base: Column, to: Column) -> Column:
    """The url that a reference in a page means, by RFC 3986, without a fragment; null if it is of another kind, such as
    mailto:. Both urls are of schemes with ://."""
    to = F.regexp_replace(to, "(?s)#.*$", "")
    part = lambda k: F.regexp_extract(base, _URL, k)
    root = F.concat(part(1), F.lit("://"), part(2))
    folder = F.coalesce(F.nullif(F.regexp_extract(part(3), "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    whole = (
        F.when(to.rlike(_SCHEME + "//"), to)
        .when(to.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(part(1), F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, to))
        .when(to.startswith("?"), F.concat(root, part(3), to))
        .when(to == "", F.concat(root, part(3), part(4)))
        .otherwise(F.concat(root, folder, to))
    )
    of = lambda k: F.regexp_extract(whole, _URL, k)
    return F.when(whole.isNotNull(), F.concat(of(1), F.lit("://"), of(2), _without_dots(of(3)), of(4)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, with the entities that urls are written with."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    found = F.trim(F.regexp_replace(found, """^["']|["']$""", ""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"), ("&#38;", "&"), ("&amp;", "&")):
        found = F.replace(found, F.lit(entity), F.lit(char))
    return found


def _first_tag(html: Column, tag: str, fits) -> Column:
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0)), fits), F.lit(0))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of page_node: from a page to its canonical link and to its refresh redirect, the first of each outside of
    comments. rel is a list of words. Pages whose url has no :// have no edges."""
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://")).select("url", F.regexp_replace("html", "(?s)<!--.*?-->", "").alias("html"))
    html = F.col("html")
    canonical = _first_tag(html, "link", lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = _first_tag(html, "meta", lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    target = F.regexp_extract(_attribute(refresh, "content"), r"""(?is)\burl\s*=\s*["']?\s*([^"'\s]+)""", 1)
    found = found.select("url", F.explode(F.array(_attribute(canonical, "href"), target)).alias("to")).where("to <> ''")
    return found.select(page_node(F.col("url")).alias("src"), page_node(resolved(F.col("url"), F.col("to"))).alias("dst")).where("dst is not null").distinct()


def url_verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, alias_of.

    A page that a rule fits has the rule's verdict. Any other page is judged by the pages and link targets that are
    its aliases (connected by redirect and canonical-link edges, either way): allow if a rule allows any of them,
    else block if a rule blocks any, else allow. edges(src, dst) of urls as page_node writes them may be given, as a crawl
    log has them; else they are read from the html. alias_of is the smallest node of the component, null if it has no
    alias. Null urls and urls without :// have an empty host and path, name no page, and are allowed whatever links they
    hold. Rows that repeat a url have equal verdicts; an empty table gives an empty one.
    """
    url = F.col("url").cast("string")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), page_node(url).alias("node"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("own"))
    nodes = materialize(connected_components(alias_edges(pages) if edges is None else edges, "aliases"), "aliases")
    _, by_rule = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    ruled = nodes.select("*", by_rule.alias("by_rule"))
    group = ruled.groupBy("component").agg(F.max(F.col("by_rule") == "allow").alias("allows"), F.max(F.col("by_rule") == "block").alias("blocks"), F.count("*").alias("members"))
    group = materialize(group.select("component", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").otherwise("allow").alias("spread"), "members"), "spread")
    decided = materialize(join_groups(nodes, group, "component", "members").drop("members"), "decided")
    # A node may stand for any number of pages; the rows of hot ones do not shuffle.
    pages_of = judged.groupBy("node").agg(F.count("*").alias("pages"))
    decided = materialize(pages_of.join(decided.hint("merge"), "node"), "decided")
    out = join_groups(judged, decided, "node", "pages", how="left")
    final = F.coalesce(F.col("own"), F.col("spread"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), F.col("component").alias("alias_of"))
