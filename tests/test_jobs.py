"""The edition job acts at every stage, on the tables that the oracle reads too."""

import collections

import pytest
from pyspark.sql import functions as F

from presswork.plans.bridge import Model
from presswork.plans.queries import _edition

SF = "/root/testdata/sf0.01"


def test_every_stage_of_the_edition_acts(spark):
    rows, judged, failures = _edition(Model(spark, SF))
    rows, judged = rows.collect(), judged.collect()
    new = [r for r in rows if r["part"] == "card" and r["writer"]]
    assert any(r["same"] for r in judged) and any(not r["same"] for r in judged)  # some stories are covered, some are not
    assert not {r["cluster_pos"] for r in judged if r["same"]} & {r["id"] for r in new}
    assert {r["id"] for r in new} & {r["cluster_pos"] for r in judged if not r["same"]}  # asked about, and kept
    assert collections.Counter(r["writer"] for r in new).keys() == {"small", "large"}
    assert all((r["n_sources"] > 1) == (r["writer"] == "large") for r in new) and max(r["n_sources"] for r in new) > 2
    old = [r for r in rows if r["part"] == "card" and not r["writer"]]
    assert any(r["front_page_rank"] is None for r in old) and any(r["front_page_rank"] for r in new)
    assert {r["digest_id"] for r in new} <= {r["digest_id"] for r in rows if r["part"] == "digest" and r["created_s"]}
    assert failures.count() > 0 and failures.where("failed > 0").count() == 0  # every item that landed was read


def test_cards_tell_what_feeds_would_give(spark, monkeypatch):
    """Cards and articles are embedded together, so the texts of both are trimmed and freed of tags."""
    from presswork.functions import exprs as X
    from presswork.operators import stories

    class Seen(Exception):
        pass

    def spy(texts):
        raise Seen(texts)

    monkeypatch.setattr(stories, "embed_articles", spy)
    with pytest.raises(Seen) as seen:
        _edition(Model(spark, "/root/testdata/sf0.001"))
    texts = seen.value.args[0]
    assert texts.where("pos < 0").count() > 0
    assert texts.where((F.col("title") != X.trim_ws(F.col("title"))) | (F.col("snippet") != X.strip_html(F.col("snippet")))).count() == 0
