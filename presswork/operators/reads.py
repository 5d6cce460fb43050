"""Reads of the day, the topic page, history, the saved list and the front page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BANDS, plausible_cursor


def card_view(cards: DataFrame) -> DataFrame:
    """Cards with the defaults that readers expect in place of nulls."""
    return cards.withColumns({"title": F.coalesce("title", F.lit("")), "labels_text": F.coalesce("labels_text", F.lit("")), "severity": F.coalesce("severity", F.lit(1)), "generated_s": F.col("created_s")})


def bookmark_flag(cards: DataFrame, bookmarks: DataFrame) -> DataFrame:
    marked = bookmarks.select("user_id", F.col("card_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return cards.join(marked, ["user_id", "id"], "left").withColumn("bookmarked", F.col("hit").isNotNull()).drop("hit")


def digest_for_date(digests: DataFrame, cards: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Every digest's cards with the bookmark flag and their place in the day: newest first, then by id."""
    of = digests.select(F.col("id").alias("digest_id"), "last_generated_s")
    place = Window.partitionBy("digest_id").orderBy(F.desc("published_s"), "id")
    # Numbered before the bookmarks are joined by reader and card, while rows still lie by digest.
    return bookmark_flag(card_view(cards).join(of, "digest_id").withColumn("place", F.row_number().over(place)), bookmarks)


def topic_page(day: DataFrame, topic: str) -> DataFrame:
    """One topic's cards of each digest, most severe first."""
    order = Window.partitionBy("digest_id").orderBy(F.desc("severity"), F.desc("published_s"), "id")
    return day.where(F.col("topic") == topic).withColumn("topic_place", F.row_number().over(order))


def topic_order(cards: DataFrame) -> DataFrame:
    """(digest_id, id, topic_place): the place of every card on its topic's page, most severe first."""
    order = Window.partitionBy("digest_id", "topic").orderBy(F.desc("severity"), F.desc("published_s"), "id")
    return cards.select("digest_id", "id", F.row_number().over(order).alias("topic_place"))


def saved_cards(bookmarks: DataFrame, cards: DataFrame, digests: DataFrame) -> DataFrame:
    """Bookmarks with their cards, the newest first; a bookmark without a card is dropped."""
    c = cards.select(F.col("id").alias("card_id"), "digest_id", "title", "topic")
    d = digests.select(F.col("id").alias("digest_id"), F.col("date_s").cast("string").alias("date"))
    out = bookmarks.join(c, "card_id").join(d, "digest_id", "left").withColumn("date", F.coalesce("date", F.lit("")))
    order = Window.partitionBy("user_id").orderBy(F.desc("created_s"), "card_id")
    return out.withColumn("place", F.row_number().over(order))


def digests_with_cards(digests: DataFrame, cards: DataFrame) -> DataFrame:
    return digests.join(cards.select(F.col("digest_id").alias("id")), "id", "left_semi")


def history_dates(digests: DataFrame, cards: DataFrame, today_s: int, from_s: int | None = None, through_s: int | None = None) -> DataFrame:
    """Days before today with their number of cards, the newest first; days without cards are left out."""
    past = digests.where(F.col("date_s") < today_s)
    past = past if from_s is None else past.where(F.col("date_s") >= from_s)
    past = past if through_s is None else past.where(F.col("date_s") <= through_s)
    counted = cards.groupBy(F.col("digest_id").alias("id")).agg(F.count("*").alias("n_cards"))
    order = Window.partitionBy("user_id").orderBy(F.desc("date_s"))
    return past.join(counted, "id").withColumn("place", F.row_number().over(order))


def cursor_candidates(digests: DataFrame, now_s: int) -> DataFrame:
    return digests.where(F.col("last_generated_s").isNotNull() & plausible_cursor(F.col("last_generated_s"), F.lit(now_s)))


def latest_cursor(digests: DataFrame, now_s: int) -> DataFrame:
    """Each user's newest plausible run instant over all days; null if there is none."""
    good = F.when(plausible_cursor(F.col("last_generated_s"), F.lit(now_s)), F.col("last_generated_s"))
    return digests.groupBy("user_id").agg(F.max(good).alias("cursor_s"))


def front_page(cards: DataFrame, most: int = 6) -> DataFrame:
    """The ranked cards of each digest, best first."""
    order = Window.partitionBy("digest_id").orderBy("front_page_rank", "id")
    ranked = cards.where("front_page_rank is not null").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most)


def new_run_badge(cards: DataFrame, page: str) -> DataFrame:
    """Cards of a page's latest run are new, if the page has at least two runs."""
    w = Window.partitionBy(page)
    latest, first = F.max("created_s").over(w), F.min("created_s").over(w)
    return cards.withColumn("is_new", F.coalesce((F.col("created_s") == latest) & (latest != first), F.lit(False)))


def dense_run_number(cards: DataFrame) -> DataFrame:
    return cards.withColumn("run_number", F.dense_rank().over(Window.partitionBy("digest_id").orderBy("created_s")))


def edition_layout(items: DataFrame) -> DataFrame:
    """Place items(page_id, pos, id, tier) on six columns: bands of one hero, two mediums or three smalls.

    The last card of a band widens to the edge. Spans are the same for all cards of a tier, so a card's band and row
    follow from its number within the tier and the sizes of the tiers above.
    """
    case = lambda k: F.when(F.col("tier") == "hero", BANDS["hero"][k]).when(F.col("tier") == "medium", BANDS["medium"][k]).otherwise(BANDS["small"][k])
    in_tier = Window.partitionBy("page_id", "tier")
    x = items.withColumns({"nth": F.row_number().over(in_tier.orderBy("pos", "id")) - 1, "n": F.count("*").over(in_tier), "per": case(0), "width": case(1), "height": case(2)})
    x = x.withColumns({"band": F.floor(F.col("nth") / F.col("per")), "bands": F.ceil(F.col("n") / F.col("per"))})
    page = Window.partitionBy("page_id")
    rows_of = lambda tier: F.coalesce(F.max(F.when(F.col("tier") == tier, F.col("bands") * F.col("height"))).over(page), F.lit(0))
    x = x.withColumns({"hero_rows": rows_of("hero"), "medium_rows": rows_of("medium")})
    above = F.when(F.col("tier") == "hero", 0).when(F.col("tier") == "medium", F.col("hero_rows")).otherwise(F.col("hero_rows") + F.col("medium_rows"))
    column = (F.col("nth") % F.col("per")) * F.col("width") + 1
    closes = (F.col("nth") % F.col("per") == F.col("per") - 1) | (F.col("nth") == F.col("n") - 1)
    span = F.when(closes, 7 - column).otherwise(F.col("width"))
    return x.select("page_id", "id", "tier", column.cast("int").alias("col_start"), span.cast("int").alias("col_span"), (above + F.col("band") * F.col("height") + 1).cast("int").alias("row_start"), F.col("height").cast("int").alias("row_span"))


def owned_cards(cards: DataFrame, digests: DataFrame, user_id) -> DataFrame:
    """The cards that a user may see: those of their own digests."""
    own = digests.where(F.col("user_id") == user_id).select(F.col("id").alias("digest_id"))
    return cards.join(own, "digest_id", "left_semi")


def stale_runs(digests: DataFrame, now_s: int) -> DataFrame:
    """Digests whose run could be claimed: none is under way, or it began over two minutes ago."""
    return digests.where(~F.col("generating") | (F.col("started_s") < now_s - 120))
