"""Pricing of model usage, and the statistics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import token_cost, utc_date

TOKENS = ("input", "output", "cache_read", "cache_write")


def usage_by_stage_model(calls: DataFrame) -> DataFrame:
    """Calls, unmeasured calls and token sums of each run, stage and model, and the run's one instant."""
    sums = [F.sum(F.when(F.col("measured"), F.col(t)).otherwise(0)).alias(t) for t in TOKENS]
    x = calls.groupBy("run_id", "stage", "model").agg(F.count_if("measured").alias("calls"), F.count_if(~F.col("measured")).alias("unmeasured"), *sums)
    at = calls.groupBy("run_id").agg(F.max("at_s").alias("at_s"))
    return x.join(at, "run_id")


def promo_price(usage: DataFrame, prices: DataFrame, promos: DataFrame) -> DataFrame:
    """Both prices of each row: list, and billed, which is the promotion's while it lasts (both ends inclusive)."""
    x = usage.withColumn("day", utc_date(F.col("at_s"))).join(F.broadcast(prices.withColumnsRenamed({t: f"rate_{t}" for t in TOKENS})), "model", "left")
    p = F.broadcast(promos.withColumnRenamed("model", "promo_model"))
    x = x.join(p, (F.col("model") == F.col("promo_model")) & F.col("day").between(F.col("from_day"), F.col("through_day")), "left")
    c = F.col
    cost = lambda i, o: token_cost(c("input"), c("output"), c("cache_read"), c("cache_write"), i, o, c("rate_cache_read"), c("rate_cache_write"))
    x = x.withColumn("list_usd", cost(c("rate_input"), c("rate_output")))
    x = x.withColumn("billed_usd", F.when(c("promo_model").isNotNull(), cost(c("promo_input"), c("promo_output"))).otherwise(c("list_usd")))
    x = x.withColumn("promo_applied", c("promo_model").isNotNull() & (c("billed_usd") < c("list_usd")))
    return x.drop("promo_model", "from_day", "through_day", "promo_input", "promo_output", "day", *(f"rate_{t}" for t in TOKENS))


def usage_totals(priced: DataFrame) -> DataFrame:
    """Totals of each stage and model, and a grand total with both null."""
    sums = [F.sum(c).alias(c) for c in ("calls", "unmeasured", *TOKENS, "billed_usd", "list_usd")]
    return priced.groupingSets([[F.col("stage"), F.col("model")], []], "stage", "model").agg(*sums)


def promo_notices(priced: DataFrame, promos: DataFrame) -> DataFrame:
    """Each run's models that have a promotion, and whether it applied."""
    x = priced.groupBy("run_id", "model").agg(F.max("promo_applied").alias("applied"))
    return x.join(F.broadcast(promos.select("model").distinct()), "model", "left_semi")


def expected_vs_actual(expected: DataFrame, usage: DataFrame) -> DataFrame:
    """Calls of each expected stage against those made, measured or not, over all models."""
    made = usage.groupBy("run_id", "stage").agg(F.sum(F.col("calls") + F.col("unmeasured")).alias("actual"))
    x = expected.join(made, ["run_id", "stage"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    gap = F.col("actual") - F.col("expected")
    return x.withColumn("finding", F.when(gap > 0, "extra").when(gap < 0, "floor").otherwise("equal")).withColumn("gap", gap)


def token_distribution(calls: DataFrame) -> DataFrame:
    """Order statistics a[int(n p)] of the input tokens of each stage, without interpolation, as exact counts.

    Ranks come from counts of distinct values, so no task holds a stage's rows, only its distinct token counts.
    """
    counts = calls.where("measured").groupBy("stage", "input").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stage")
    run = w.orderBy("input").rowsBetween(Window.unboundedPreceding, 0)
    x = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("all") * p), F.col("input")))
    return x.groupBy("stage").agg(F.min("input").alias("least"), at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.max("input").alias("most"), (F.sum(F.col("input") * F.col("n")) / F.sum("n")).alias("mean"))


def verdict_stats(judged: DataFrame) -> DataFrame:
    """Of each run and topic: clusters, passes, pass rate, severities of the passes, and their mean."""
    ok = F.col("notable")
    of = [F.count_if(ok & (F.col("severity") == s)).alias(f"severity_{s}") for s in range(1, 6)]
    return judged.groupBy("run_id", "topic").agg(
        F.count("*").alias("clusters"), F.count_if(ok).alias("passes"), F.avg(ok.cast("double")).alias("pass_rate"), *of,
        F.count_if(ok & (F.col("severity") >= 3)).alias("severe"), F.avg(F.when(ok, F.col("severity"))).alias("mean_severity"),
    )


def run_acceptance(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """stats(run_id, metric, value) against baseline(metric, low, high)."""
    x = stats.join(F.broadcast(baseline), "metric")
    return x.withColumn("passed", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)))


def cost_projection(priced: DataFrame, users: int, days: int) -> DataFrame:
    """Per stage: mean spend of a run, its share, and the month's spend for so many users and days."""
    per_run = priced.groupBy("run_id", "stage").agg(F.sum("list_usd").alias("usd"))
    x = per_run.rollup("stage").agg(F.sum("usd").alias("spent"), F.countDistinct("run_id").alias("runs"))
    few = Window.partitionBy(F.lit(0))  # a row for each stage, and the total
    x = x.withColumns({"whole": F.max(F.when(F.col("stage").isNull(), F.col("spent"))).over(few), "runs": F.max(F.when(F.col("stage").isNull(), F.col("runs"))).over(few)})
    x = x.where("stage is not null")
    return x.select("stage", (F.col("spent") / F.col("runs")).alias("per_run_usd"), (F.col("spent") / F.col("whole")).alias("share"), (F.col("spent") / F.col("runs") * users * days).alias("monthly_usd"))


def cost_per_card(priced: DataFrame, cards: DataFrame) -> DataFrame:
    """How each stage's list price of a run grows with its cards(run_id, cards): (stage, runs, slope_usd, intercept_usd, r2) of
    the line of least squares. slope_usd is what one more card costs; all three are null where all runs have as many."""
    per_run = priced.groupBy("run_id", "stage").agg(F.sum("list_usd").alias("usd")).join(cards.select("run_id", "cards").hint("merge"), "run_id")
    x = per_run.groupBy("stage").agg(F.count("*").alias("runs"), *(f("usd", "cards").alias(name) for f, name in ((F.regr_slope, "slope_usd"), (F.regr_intercept, "intercept_usd"), (F.regr_r2, "r2"))))
    return x.select("stage", "runs", *(F.when(F.col("slope_usd").isNotNull(), F.col(c)).alias(c) for c in ("slope_usd", "intercept_usd", "r2")))


def cost_of_cards(per_card: DataFrame, sizes: list[int]) -> DataFrame:
    """(cards, usd): the list price of a run of so many cards, by the lines of cost_per_card over all stages."""
    x = per_card.where("slope_usd is not null").agg(F.sum("slope_usd").alias("slope"), F.sum("intercept_usd").alias("base"))
    return x.select(F.explode(F.array(*(F.lit(n).cast("long") for n in sizes))).alias("cards"), "slope", "base").select("cards", (F.col("base") + F.col("slope") * F.col("cards")).alias("usd"))


def single_source_share(members: DataFrame) -> DataFrame:
    """Of each topic the share of stories that rest on one article, from members(topic, cluster_pos)."""
    n = members.groupBy("topic", "cluster_pos").agg(F.count("*").alias("n"))
    return n.groupBy("topic").agg(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)).alias("share"))
