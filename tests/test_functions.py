"""Table-driven cases of the column expressions."""

import pytest
from pyspark.sql import functions as F

from presswork.functions import exprs as X


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026-07-31T12:00:00Z", 1785499200),
        ("2026-07-31T14:00:00+02:00", 1785499200),
        ("Fri, 31 Jul 2026 12:00:00 +0000", 1785499200),
        ("Fri, 31 Jul 2026 12:00:00 GMT", 1785499200),
        ("Fri, 31 Jul 2026 12:00 GMT", 1785499200),
        ("Friday, 31-Jul-26 12:00:00 UTC", 1785499200),
        ("31 Jul 26 8:00 EDT", 1785499200),
        ("Fri, 31 Jul 2026 05:00:00 -0700 (PDT)", 1785499200),
        ("July 31, 2026 12:00:00.5", 1785499200),
        ("Fri 31 July 2026 13:30 +01:30", 1785499200),
        ("2026-07-31 12:00Z", 1785499200),
        ("2026-07-31T13:00:00.123+0100", 1785499200),
        ("2026-07-31", 1785456000),
        ("31 Jul 2026", 1785456000),
        ("2 Jan 50", -631065600),
        ("Fri, 31 Jun 2026 12:00 GMT", 5),
        ("Fri, 31 Anf 2026 12:00 GMT", 5),
        ("Fri, 31 Jul 2026 25:00 GMT", 5),
        ("Fri, 31 Jul 2026 12:00 XYZ", 5),
        ("1785499200", 5),
        ("soon", 5),
        ("", 5),
        (None, 5),
    ],
)
def test_published_or_now(spark, raw, expected):
    assert one(spark, X.published_or_now(F.lit(raw).cast("string"), F.lit(5))) == expected


@pytest.mark.parametrize("text, expected", [("  a\n", "a"), ("  b ", "b"), ("　c﻿", "c"), ("d e", "d e")])
def test_trim(spark, text, expected):
    assert one(spark, X.trim_ws(F.lit(text))) == expected


def test_strip_html_keeps_entities(spark):
    assert one(spark, X.strip_html(F.lit(" <p>a &amp; <b>b</b></p>\n"))) == "a &amp; b"


@pytest.mark.parametrize("text, complete", [("Done.", True), ('He said "no."', True), ("Done!) ", True), ("and then", False), ("", False), ("a.]", True)])
def test_looks_complete(spark, text, complete):
    assert one(spark, X.looks_complete(F.lit(text))) is complete


@pytest.mark.parametrize(
    "t1, s1, t2, expected",
    [
        ("", "end_turn", None, "failed_empty"),
        ("Fine.", "max_tokens", None, "first"),
        ("cut", "max_tokens", "Fine.", "failed_truncated"),
        ("cut", "end_turn", None, "to_retry"),
        ("cut", "end_turn", "Fine.", "retry"),
        ("cut", "end_turn", "cut", "failed_retry"),
        ("cut", "end_turn", " ", "failed_retry"),
    ],
)
def test_disposition(spark, t1, s1, t2, expected):
    assert one(spark, X.generation_disposition(F.lit(t1), F.lit(s1), F.lit(t2).cast("string"))) == expected


@pytest.mark.parametrize(
    "values, expected",
    [
        ((1, 2, None, None), (1, 2, 0, 0)),
        ((1, None, 0, 0), None),
        ((-1, 2, 0, 0), None),
        ((1, 2, -3, 0), None),
        ((float("nan"), 2, 0, 0), None),
        ((1, float("inf"), 0, 0), None),
        ((0, 0, 5, 6), (0, 0, 5, 6)),
    ],
)
def test_normalize_usage(spark, values, expected):
    got = one(spark, X.normalize_usage(*(F.lit(v).cast("double") for v in values)))
    assert (got and tuple(got)) == expected


def fnv(label):
    h = 0x811C9DC5
    data = label.strip().lower().encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = ((h ^ int.from_bytes(data[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return h % 6 + 1


@pytest.mark.parametrize("label", ["AI", "ai", " AI ", "économie", "a \U0001f600 b", ""])
def test_label_bucket(spark, label):
    assert one(spark, X.label_bucket(F.lit(label))) == fnv(label)


@pytest.mark.parametrize("value, severity, rank", [(0, "small", "hero"), (2.5, "medium", "medium"), (4.5, "hero", "medium"), (9, "hero", "small"), (1, "small", "hero"), (5.5, "hero", "small")])
def test_tiers(spark, value, severity, rank):
    assert one(spark, X.tier_for_severity(F.lit(value))) == severity
    assert one(spark, X.tier_for_rank(F.lit(value))) == rank


@pytest.mark.parametrize("age, expected", [(20, "just now"), (30, "1m ago"), (3569, "59m ago"), (3570, "1h ago"), (23.4 * 3600, "23h ago"), (23.6 * 3600, "1d ago"), (60 * 3600, "3d ago")])
def test_recency(spark, age, expected):
    assert one(spark, X.recency_bucket(F.lit(0), F.lit(age))) == expected


def test_flatten_cuts_by_code_point(spark):
    assert one(spark, X.flatten_text(F.lit('  a "b"\n\U0001f600\U0001f600'), 7)) == "a 'b' \U0001f600…"


def test_cosine(spark):
    assert one(spark, X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.9), F.lit(0.1)))) == pytest.approx(0.9)


def test_attempts_in_sql_trim_as_the_expression_does(spark):
    """Line ends, wide spaces and closing quotes: the SQL of the attempts gives what the expression gives."""
    import duckdb

    from presswork.plans.expr_queries import ATTEMPTS

    texts = ["Fine.\n", "\tFine!\u2003", "'Fine?'\u00a0", "Fine.\u0085", "cut\n", "\n \u3000", "", None]
    rows = [(100 * i + 10 * j + k, a, stop, b) for i, a in enumerate(texts) for j, stop in enumerate(["end_turn", "max_tokens", None]) for k, b in enumerate(texts)]
    df = spark.createDataFrame(rows, "card_key long, t1 string, stop string, t2 string")
    got = {r[0]: (r[1], r[2]) for r in df.select("card_key", X.generation_disposition(F.col("t1"), F.col("stop"), F.col("t2")), X.trim_ws(F.col("t1"))).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE generations (card_key BIGINT, attempt INT, text VARCHAR, stop_reason VARCHAR)")
    con.executemany("INSERT INTO generations VALUES (?, ?, ?, ?)", [(k, 1, a, s) for k, a, s, _ in rows] + [(k, 2, b, s) for k, _, s, b in rows])
    found = con.execute(f"WITH {ATTEMPTS} SELECT card_key, disposition, t1 FROM attempts").fetchall()
    assert {k: (d, t) for k, d, t in found} == {k: (d, t or "") for k, (d, t) in got.items()}
    assert {d for d, _ in got.values()} == {"failed_empty", "first", "failed_truncated", "to_retry", "retry", "failed_retry"}
