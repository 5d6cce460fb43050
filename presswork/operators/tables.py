"""Write paths as pure functions from tables to tables, and the snapshot writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edition import apply_rank_updates

CARD_JSON = "array<struct<id:bigint,topic:string,title:string,severity:int,published_s:bigint,labels:array<string>>>"


def explode_cards_json(runs: DataFrame, column: str = "cards_json") -> DataFrame:
    """The cards of a JSON array, typed; a card without labels has an empty array."""
    x = runs.withColumn("c", F.explode(F.from_json(F.col(column), CARD_JSON))).drop(column)
    return x.select(*(c for c in x.columns if c != "c"), "c.*").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def persist_run(cards: DataFrame, digests: DataFrame, new_cards: DataFrame, updates: DataFrame, digest_id, run_at_s: int) -> tuple[DataFrame, DataFrame]:
    """The tables after a run: its cards inserted with the run's stamp, ranks of cards of the same digest updated, and
    the digest's cursor advanced."""
    mine = F.col("digest_id") == F.lit(digest_id)
    updated = apply_rank_updates(cards.where(mine), updates).unionByName(cards.where(~mine))
    stamped = new_cards.withColumns({"digest_id": F.lit(digest_id), "created_s": F.lit(run_at_s).cast("bigint")})
    is_digest = F.col("id") == F.lit(digest_id)
    advanced = digests.withColumn("last_generated_s", F.when(is_digest, F.lit(run_at_s).cast("bigint")).otherwise(F.col("last_generated_s")))
    return updated.unionByName(stamped, allowMissingColumns=True), advanced


def persist_runs(cards: DataFrame, digests: DataFrame, new_cards: DataFrame, updates: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """persist_run for all runs(digest_id, run_at_s) at once: updates(digest_id, id, new_rank) change cards of their own
    digest only, new cards of a digest without a run are not written, and each run moves its digest's cursor."""
    u = updates.select("digest_id", "id", "new_rank", F.lit(True).alias("hit")).join(runs.select("digest_id"), "digest_id", "left_semi")
    x = cards.join(u.hint("merge"), ["digest_id", "id"], "left")
    x = x.withColumn("front_page_rank", F.when(F.col("hit"), F.col("new_rank")).otherwise(F.col("front_page_rank"))).drop("hit", "new_rank")
    stamped = new_cards.join(runs.withColumnRenamed("run_at_s", "created_s").hint("merge"), "digest_id")
    advanced = digests.join(runs.withColumnRenamed("digest_id", "id").hint("merge"), "id", "left")
    advanced = advanced.withColumn("last_generated_s", F.coalesce("run_at_s", "last_generated_s")).drop("run_at_s")
    return x.unionByName(stamped, allowMissingColumns=True), advanced


def open_digest(digests: DataFrame, wanted: DataFrame) -> DataFrame:
    """digests and one new row for each wanted (user_id, date_s) that has none. Ids derive from the key, so repeating it
    changes nothing."""
    new = wanted.select("user_id", "date_s").distinct().join(digests, ["user_id", "date_s"], "left_anti")
    ident = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("date_s").cast("string")), 256)
    new = new.select(ident.alias("id"), "user_id", "date_s", F.lit(None).cast("bigint").alias("last_generated_s"), F.lit(False).alias("generating"), F.lit(None).cast("bigint").alias("started_s"))
    return digests.select(*new.columns).unionByName(new)


def add_bookmarks(bookmarks: DataFrame, wanted: DataFrame, cards: DataFrame) -> DataFrame:
    """Add wanted(user_id, card_id, created_s) for cards that the user owns; pairs that exist stay as they are."""
    owned = wanted.join(cards.select("user_id", F.col("id").alias("card_id")), ["user_id", "card_id"], "left_semi")
    new = owned.join(bookmarks, ["user_id", "card_id"], "left_anti").groupBy("user_id", "card_id").agg(F.min("created_s").alias("created_s"))
    return bookmarks.unionByName(new)


def remove_bookmarks(bookmarks: DataFrame, gone: DataFrame) -> DataFrame:
    return bookmarks.join(gone, ["user_id", "card_id"], "left_anti")


def replace_preferences(stored: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the users in new are replaced."""
    return stored.join(new.select("user_id").distinct().hint("merge"), "user_id", "left_anti").unionByName(new.distinct())


def fill_reports(cards: DataFrame, reports: DataFrame) -> DataFrame:
    """The first report written stays; an empty one counts as written."""
    x = cards.join(reports.select("id", F.col("report").alias("new_report")), "id", "left")
    return x.withColumn("expanded_report", F.coalesce("expanded_report", "new_report")).drop("new_report")


def cascade_delete(users_gone: DataFrame, digests: DataFrame, cards: DataFrame, bookmarks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """digests, cards and bookmarks without what belongs to the users gone."""
    d = digests.join(users_gone.select("user_id"), "user_id", "left_anti")
    c = cards.join(d.select(F.col("id").alias("digest_id")), "digest_id", "left_semi")
    b = bookmarks.join(users_gone.select("user_id"), "user_id", "left_anti")
    return d, c, b.join(c.select(F.col("id").alias("card_id")), "card_id", "left_semi")
