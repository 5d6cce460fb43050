"""Cases at the edges, and properties on random frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from presswork.operators import edition, ingest, quality, reads, stories, tables, triage, usage
from presswork.plans import dims
from presswork.plans.bridge import Model

NOW = 1785499200


def test_cutoff_ages_and_cursors(spark):
    ages = [1, 47, 48, 49, 200]
    users = {"none": None, "edge": NOW + 300, "corrupt": NOW + 301, "recent": NOW - 3600 * 2, "old": NOW - 3600 * 500}
    a = spark.createDataFrame([(u, h, NOW - 3600 * h) for u in users for h in ages], "user_id string, h int, published_s long")
    c = spark.createDataFrame(list(users.items()), "user_id string, cursor_s long")
    kept = {}
    for r in ingest.recency_cutoff(a, c, NOW).collect():
        kept.setdefault(r["user_id"], set()).add(r["h"])
    assert kept == {"none": {1, 47, 48}, "corrupt": {1, 47, 48}, "old": {1, 47, 48}, "recent": {1}}


@pytest.mark.parametrize("n, sizes", [(1, [1]), (20, [20]), (21, [11, 10]), (62, [16, 16, 15, 15])])
def test_batches(spark, n, sizes):
    c = spark.createDataFrame([("r", "t", i) for i in range(n)], "run_id string, topic string, cluster_pos long")
    got = triage.triage_batches(c).groupBy("batch").agg(F.count("*").alias("n"), F.min("cluster_pos").alias("first")).orderBy("batch").collect()
    assert [r["n"] for r in got] == sizes
    assert [r["first"] for r in got] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_first_verdict_wins(spark):
    rows = [("b", 2, [(1, True, 4), (1, False, 1), (5, True, 5), (-1, True, 5)]), ("c", 1, None)]
    r = spark.createDataFrame(rows, "batch_id string, batch_size int, verdicts array<struct<index:int,notable:boolean,severity:int>>")
    assert [tuple(x) for x in triage.first_verdict_wins(r).select("batch_id", "index", "notable", "severity").collect()] == [("b", 1, True, 4)]


def test_cap_properties(spark):
    rng = random.Random(42)
    rows = [(f"r{t}", rng.choice("abc"), i, rng.random() < 0.8, rng.randint(1, 5)) for t in range(60) for i in range(rng.randint(1, 30))]
    j = spark.createDataFrame(rows, "run_id string, topic string, cluster_pos long, notable boolean, severity int")
    kept = [tuple(r) for r in edition.cap_per_topic(j).select("run_id", "topic", "cluster_pos", "severity").collect()]
    by = {}
    for r, t, p, ok, s in rows:
        if ok:
            by.setdefault((r, t), []).append((-s, p))
    assert sorted(kept) == sorted((r, t, p, -s) for (r, t), v in by.items() for s, p in sorted(v)[:8])
    cuts = {(r["run_id"], r["topic"]): (r["dropped"], r["total"], r["severities"]) for r in edition.topic_cuts(j).collect()}
    assert cuts == {k: (len(v) - 8, len(v), [-s for s, _ in sorted(v)[8:]]) for k, v in by.items() if len(v) > 8}


@pytest.mark.parametrize(
    "size, picks, expected",
    [
        (3, [(99, 1), (-1, 2)], [None, None, None]),
        (3, [], [None, None, None]),
        (3, [(0, 1), (0, 2), (1, 1), (1, 2)], [1, 2, None]),
        (2, [(9, 1), (0, 1)], [1, None]),
        (2, [(0, 7), (0, 6)], [6, None]),
        (2, None, []),
        (0, [(0, 1)], []),
    ],
)
def test_picks(spark, size, picks, expected):
    r = spark.createDataFrame([("r", size, picks)], "run_id string, pool_size int, picks array<struct<index:int,rank:int>>")
    assert [x["rank"] for x in edition.front_page_picks(r).orderBy("pool_pos").collect()] == expected


def test_rank_updates(spark):
    cards = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, front_page_rank long")
    updates = spark.createDataFrame([(1, None), (3, 4), (9, 5)], "id long, new_rank long")
    assert sorted((r["id"], r["front_page_rank"]) for r in edition.apply_rank_updates(cards, updates).collect()) == [(1, None), (2, 2), (3, 4)]


def test_promotion_days(spark):
    days = [(0, 1767225599), (1, 1767225600), (2, 1788220799), (3, 1788220800)]
    calls = spark.createDataFrame([(r, s, "writing", "large", 1000000, 0, 0, 0, True) for r, s in days], "run_id long, at_s long, stage string, model string, input long, output long, cache_read long, cache_write long, measured boolean")
    p = usage.promo_price(usage.usage_by_stage_model(calls), dims.dim_price(spark), dims.dim_promo(spark))
    assert [(r["billed_usd"], r["list_usd"], r["promo_applied"]) for r in p.orderBy("run_id").collect()] == [(3.0, 3.0, False), (2.0, 3.0, True), (2.0, 3.0, True), (3.0, 3.0, False)]


def test_unmeasured_calls_are_counted_but_not_summed(spark):
    calls = spark.createDataFrame([(1, 5, "a", "small", 10, 1, 0, 0, True), (1, 5, "a", "small", None, None, None, None, False)], "run_id long, at_s long, stage string, model string, input long, output long, cache_read long, cache_write long, measured boolean")
    r = usage.usage_by_stage_model(calls).first()
    assert (r["calls"], r["unmeasured"], r["input"], r["output"]) == (1, 1, 10, 1)


def test_published_verdict_figures(spark):
    """Passes of two published runs by severity give their published means and counts."""
    runs = {"first": {2: 29, 3: 91, 4: 10}, "third": {1: 1, 2: 110, 3: 89, 4: 10}}
    rows = [(k, "all", True, s) for k, v in runs.items() for s, n in v.items() for _ in range(n)]
    got = {r["run_id"]: (round(r["mean_severity"], 3), r["severe"]) for r in usage.verdict_stats(spark.createDataFrame(rows, "run_id string, topic string, notable boolean, severity int")).collect()}
    assert got == {"first": (2.854, 101), "third": (2.514, 99)}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "run_id string, pos long, topic string, embedding array<float>")


def test_greedy_stories(spark):
    at = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = [("a", 0, "x", [1.0, 0.0]), ("a", 1, "y", [0.9, math.sqrt(1 - 0.81)]), ("b", 0, "x", [1.0, 0.0]), ("b", 1, "x", [0.6, 0.8]), ("c", 0, "x", at(0)), ("c", 1, "y", at(90)), ("c", 2, "z", at(48))]
    got = {(r["run_id"], r["pos"]): (r["story"], r["story_topic"]) for r in stories.greedy_stories(vectors(spark, rows)).collect()}
    assert got == {("a", 0): (0, "x"), ("a", 1): (0, "x"), ("b", 0): (0, "x"), ("b", 1): (1, "x"), ("c", 0): (0, "x"), ("c", 1): (1, "y"), ("c", 2): (1, "y")}


def test_components_of_a_chain(spark):
    nodes = spark.range(40).withColumnRenamed("id", "id")
    pairs = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r["id"]: r["story"] for r in stories.story_components(nodes, pairs).collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(40)}


def test_no_existing_cards_keeps_all(spark):
    c = spark.createDataFrame([(1, "x", [1.0, 0.0])], "cluster_pos long, topic string, embedding array<float>")
    none = spark.createDataFrame([], "id long, topic string, embedding array<float>")
    judged = spark.createDataFrame([], "cluster_pos long, card_id long, same boolean")
    assert stories.filter_already_covered(c, none, judged).count() == 1


@pytest.mark.parametrize("tiers", ["h", "hh", "m", "mmm", "s", "ssss", "hmmmms", "hhmmmsssss", "sm", "mshsmsh"])
def test_layout(spark, tiers):
    names = {"h": "hero", "m": "medium", "s": "small"}
    items = spark.createDataFrame([("p", i, i, names[t]) for i, t in enumerate(tiers)], "page_id string, pos int, id long, tier string")
    cells = {}
    for r in reads.edition_layout(items).collect():
        for x in range(r["col_start"], r["col_start"] + r["col_span"]):
            for y in range(r["row_start"], r["row_start"] + r["row_span"]):
                assert (x, y) not in cells
                cells[x, y] = r["tier"]
    high = max(y for _, y in cells)
    assert set(cells) == {(x, y) for x in range(1, 7) for y in range(1, high + 1)}
    order = [cells[1, y] for y in range(1, high + 1)]
    assert order == sorted(order, key=["hero", "medium", "small"].index)


def test_runs_replay(spark):
    cards = spark.createDataFrame([(1, "d", 1, 10), (2, "e", 1, 10)], "id long, digest_id string, front_page_rank long, created_s long")
    digests = spark.createDataFrame([("d", 10), ("e", 10)], "id string, last_generated_s long")
    new = spark.createDataFrame([(3, 1)], "id long, front_page_rank long")
    updates = spark.createDataFrame([(1, None), (2, 5)], "id long, new_rank long")
    c, d = tables.persist_run(cards, digests, new, updates, "d", 20)
    assert sorted(map(tuple, c.select("id", "digest_id", "front_page_rank", "created_s").collect())) == [(1, "d", None, 10), (2, "e", 1, 10), (3, "d", 1, 20)]
    assert sorted(map(tuple, d.collect())) == [("d", 20), ("e", 10)]
    badge = {r["id"]: r["is_new"] for r in reads.new_run_badge(c, "digest_id").collect()}
    assert badge == {1: False, 2: False, 3: True}


def test_open_digest_twice(spark):
    digests = spark.createDataFrame([], "id string, user_id long, date_s long, last_generated_s long, generating boolean, started_s long")
    wanted = spark.createDataFrame([(1, 5), (1, 5)], "user_id long, date_s long")
    once = tables.open_digest(digests, wanted)
    assert tables.open_digest(once, wanted).count() == once.count() == 1


def test_empty_report_counts_as_written(spark):
    cards = spark.createDataFrame([(1, ""), (2, None)], "id long, expanded_report string")
    reports = spark.createDataFrame([(1, "x"), (2, "y")], "id long, report string")
    assert sorted(map(tuple, tables.fill_reports(cards, reports).collect())) == [(1, ""), (2, "y")]


def test_midnight_runs_overlap(spark):
    runs = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 90, 150), (1, 3, 150, 200), (2, 4, 90, 95)], "user_id long, run long, since_s long, at_s long")
    assert [r["run"] for r in quality.overlapping_runs(runs).collect()] == [2]


def test_articles_grow_with_the_table(spark, tmp_path):
    """No cap on (user, url) pairs; a user and a run have a thousand articles at most, and copies share a url."""
    docs = spark.range(20000).selectExpr("id AS doc_id", "concat('text ', if(id = 10, 5, id)) AS text", "'en' AS lang", "'src1' AS source")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    a = Model(spark, str(tmp_path))["articles"]
    first = {r["pos"] for r in ingest.first_sighting(a, ["pos"]).select("pos").collect()}
    assert first >= {i for i in range(20000) if i % 97 and i != 10} and 10 not in first
    for key in ("user_id", "run_id"):
        assert {r["count"] for r in a.groupBy(key).count().collect()} == {1000}


def test_snippets_hold_the_rest_of_the_text(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(500))
    docs = spark.createDataFrame([(0, text, "en", "src1"), (1, None, "en", "src1")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for view in ("articles", "cluster_articles"):
        got = {r["pos"]: r["title"] + r["snippet"] for r in Model(spark, str(tmp_path))[view].collect()}
        assert got == {0: text, 1: ""}


# ---- skew
def test_components_of_chains_stars_and_hot_nodes(spark):
    from presswork.operators.skew import star_components

    links = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(70)] + [(500, 501), (501, 500), (7, 7), (900, 900)]
    got = {r["id"]: r["component"] for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(71)}, 500: 500, 501: 500}
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedder_hook_is_held_to_its_contract(spark):
    import pytest

    from presswork.operators import stories

    texts = spark.createDataFrame([(i, None if i == 3 else "t" * i) for i in range(130)], "id long, text string")
    unit = lambda found: [(1.0, 0.0)] * len(found)
    assert stories.embed_with(texts, unit).count() == 130
    for bad in (lambda found: [(1.0, 1.0)] * len(found), lambda found: [(1.0, 0.0)], lambda found: 1 / 0):
        with pytest.raises(Exception):
            stories.embed_with(texts, bad).count()


def test_texts_far_beyond_the_limits_are_clipped_there(spark):
    from presswork.functions import exprs

    one = spark.createDataFrame([("t", "x" * 5000)], "title string, snippet string")
    n = one.select(*(F.length(exprs.clip(F.col("snippet"), k)).alias(f"n{k}") for k in (200, 300, 1200))).first()
    assert tuple(n) == (200, 300, 1200)


def test_stored_editions_are_pruned_and_do_not_shuffle_by_digest(spark, sf_dir, tmp_path):
    import re

    from presswork.sources import layout

    m = Model(spark, sf_dir)
    layout.store_editions(m["cards"], m["digests"], "editions_test", str(tmp_path), 4)
    cards, digests = layout.stored_editions(spark, "editions_test", 870000000, 890000000)
    columns = ["digest_id", "id", "place", "bookmarked"]
    stored = reads.digest_for_date(digests.hint("merge"), cards, m["bookmarks"]).select(*columns)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\((digest_id|id)#\d+,", plan)
    filters = re.findall(r"PartitionFilters: \[([^]]*)\]", plan)
    assert sum("870000000" in f and "890000000" in f for f in filters) == 2
    plain = reads.digest_for_date(m["digests"].where("date_s between 870000000 and 890000000"), m["cards"], m["bookmarks"]).select(*columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, plain.collect())) != []
    spark.sql("DROP TABLE editions_test_cards")
    spark.sql("DROP TABLE editions_test_digests")


def test_cost_per_card(spark):
    priced = spark.createDataFrame([(r, s, 0.05 + k * n * 0.5) for r, n in ((1, 2), (2, 4), (3, 9)) for s, k in (("writing", 0.01), ("triage", 0.0)) for _ in range(2)], "run_id long, stage string, list_usd double")
    cards = spark.createDataFrame([(1, 2), (2, 4), (3, 9), (4, 7)], "run_id long, cards long")
    per = usage.cost_per_card(priced, cards)
    got = {r["stage"]: (r["runs"], round(r["slope_usd"], 9), round(r["intercept_usd"], 9)) for r in per.collect()}
    assert got == {"writing": (3, 0.01, 0.1), "triage": (3, 0.0, 0.1)}
    assert {r["cards"]: round(r["usd"], 9) for r in usage.cost_of_cards(per, [0, 30]).collect()} == {0: 0.2, 30: 0.5}
    same = usage.cost_per_card(priced.where("run_id = 1"), cards).collect()
    assert all(r["slope_usd"] is None and r["intercept_usd"] is None for r in same)


def test_batch_contexts_are_numbered_from_zero(spark):
    c = spark.createDataFrame([("r", "t", i, f"- c{i}" if i else None) for i in range(21)], "run_id string, topic string, cluster_pos long, context string")
    got = {r["batch"]: (r["clusters"], r["text"]) for r in triage.batch_contexts(triage.triage_batches(c)).collect()}
    assert got[0] == (11, "\n\n".join(f"{i}. {f'- c{i}' if i else ''}" for i in range(11)))
    assert got[1] == (10, "\n\n".join(f"{i}. - c{i + 11}" for i in range(10)))


def test_formats(spark):
    from presswork.functions.exprs import valid_uuid

    t = spark.createDataFrame([("123e4567-e89b-42d3-a456-426614174000",), ("not-a-uuid",), ("not-a-uuid",), (None,)], "id string")
    assert [tuple(r) for r in quality.bad_formats(t, "t.id", "id", valid_uuid(F.col("id"))).collect()] == [("t.id", "not-a-uuid", 2)]


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_by_rounds_and_by_one_task(spark, few):
    from presswork.operators.skew import star_components

    rng = random.Random(8)
    links = [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(7, 7), (400, 400)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = a
                todo += near[x]
    lone = {x for x in near if near[x] == {x}}
    got = {r["id"]: r["component"] for r in star_components(spark.createDataFrame(links, "a long, b long").repartition(4), few=few).collect()}
    assert got == {k: v for k, v in want.items() if k not in lone}
    assert star_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_scratch_tables_go(spark):
    import os

    from presswork.operators.skew import scratch, written

    with scratch(spark) as folder:
        assert written(spark.range(5)).count() == 5
        with scratch(spark) as inner:
            assert inner.startswith(folder) and written(spark.range(3)).count() == 3
        assert len(os.listdir(folder)) == 1
    assert not os.path.exists(folder)
    assert written(spark.range(2)).count() == 2


def test_embedding_shuffles_no_words(spark):
    """Counts are made in the row of a text, so that nothing is grouped by text and word; nulls and blanks have the null vector."""
    rows = [(1, "t", "One", "two two"), (2, "t", "one", "Zwei\tdrei\n"), (3, "u", " ", "."), (4, "u", None, "x"), (5, "u", "", "one two")]
    out = stories.embed_articles(spark.createDataFrame(rows, "pos long, topic string, title string, snippet string"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["pos"]: [float(v) for v in r["embedding"]] for r in out.collect()}
    assert got[4] == [0.0] * 64 and all(len(v) == 64 for v in got.values())
    assert all(abs(sum(x * x for x in got[k]) - 1) < 1e-6 for k in (1, 2, 3, 5))


def test_preferences_are_dealt_before_they_are_made(spark, sf_dir, monkeypatch):
    """A file of customers is small for the preferences that come of it, which grow the tasks and not a task."""
    from presswork.plans import bridge

    def parts(name):
        return bridge.Model(spark, sf_dir)[name].rdd.getNumPartitions()

    whole = {n: sorted(map(tuple, bridge.Model(spark, sf_dir)[n].collect())) for n in bridge.PREFERENCES}
    monkeypatch.setattr(bridge, "ROWS_A_TASK", 100)
    assert all(parts(n) == -(-spark.read.parquet(f"{sf_dir}/customer.parquet").count() * 12 // 100) for n in bridge.PREFERENCES)
    assert whole == {n: sorted(map(tuple, bridge.Model(spark, sf_dir)[n].collect())) for n in bridge.PREFERENCES}
