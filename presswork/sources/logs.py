"""Run captures as tables: usage calls, verdicts, cuts and HTTP requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE = r"^\[usage\] (\S+) (\S+) in=(\d+) out=(\d+) cache_r=(\d+) cache_w=(\d+) \$([0-9.]+)$"
UNMEASURED = r"^\[usage\] (\S+) (\S+) no usage reported"
VERDICT = '^\\[triage\\] (.+?) — (?:(PASS) \\(severity (\\d)\\)|reject) — "([^"]*)"(?: — (.*))?$'
CUT = r"^\[digest\] (.+): kept (\d+) of (\d+) notable — dropped (\d+) at severity ([0-9, ]+)$"
HTTP = r"^\s*(GET|POST|PUT|DELETE|PATCH) (\S+) (\d{3}) in ([0-9.]+)\s?(ms|s)\b"


def _part(pattern: str, k: int, c: Column) -> Column:
    return F.regexp_extract(c, pattern, k)


def parse_usage_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """The call lines; tokens are null where no usage was reported."""
    c = F.col(text)
    full = c.rlike(USAGE)
    x = lines.where(full | c.rlike(UNMEASURED))
    number = lambda k, kind: F.when(full, _part(USAGE, k, c)).cast(kind)
    rest = [n for n in lines.columns if n != text]
    return x.select(
        *rest, F.when(full, _part(USAGE, 1, c)).otherwise(_part(UNMEASURED, 1, c)).alias("stage"), F.when(full, _part(USAGE, 2, c)).otherwise(_part(UNMEASURED, 2, c)).alias("model"),
        number(3, "bigint").alias("input"), number(4, "bigint").alias("output"), number(5, "bigint").alias("cache_read"), number(6, "bigint").alias("cache_write"), number(7, "double").alias("usd"), full.alias("measured"),
    )


def parse_verdict_log(lines: DataFrame, text: str = "value") -> DataFrame:
    c = F.col(text)
    rest = [n for n in lines.columns if n != text]
    severity = F.when(_part(VERDICT, 3, c) != "", _part(VERDICT, 3, c)).cast("int")
    return lines.where(c.rlike(VERDICT)).select(*rest, _part(VERDICT, 1, c).alias("topic"), (_part(VERDICT, 2, c) == "PASS").alias("notable"), severity.alias("severity"), _part(VERDICT, 4, c).alias("title"), _part(VERDICT, 5, c).alias("reason"))


def parse_cut_log(lines: DataFrame, text: str = "value") -> DataFrame:
    c = F.col(text)
    rest = [n for n in lines.columns if n != text]
    severities = F.transform(F.split(_part(CUT, 5, c), ", *"), lambda s: s.cast("int"))
    return lines.where(c.rlike(CUT)).select(*rest, _part(CUT, 1, c).alias("topic"), _part(CUT, 2, c).cast("int").alias("kept"), _part(CUT, 3, c).cast("int").alias("total"), _part(CUT, 4, c).cast("int").alias("dropped"), severities.alias("severities"))


def parse_http_log(lines: DataFrame, text: str = "value") -> DataFrame:
    c = F.col(text)
    rest = [n for n in lines.columns if n != text]
    ms = F.round(_part(HTTP, 4, c).cast("double") * F.when(_part(HTTP, 5, c) == "s", 1000.0).otherwise(1.0)).cast("bigint")
    return lines.where(c.rlike(HTTP)).select(*rest, _part(HTTP, 1, c).alias("method"), _part(HTTP, 2, c).alias("path"), _part(HTTP, 3, c).cast("int").alias("status"), ms.alias("ms"))
