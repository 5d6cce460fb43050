"""Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.commits import CommitLog, saver


def stream_new_articles(articles: DataFrame) -> DataFrame:
    """The first sighting of each url; state is kept for the lookback of 48 hours, after which nothing is fresh."""
    return articles.withWatermark("published_at", "48 hours").dropDuplicatesWithinWatermark(["user_id", "url"])


def late_articles_sink(save: Callable[[DataFrame, int], None], cutoff_s: int) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: articles before the cutoff go to save, as the watermark would drop them for good."""
    return lambda batch, batch_id: save(batch.where(F.unix_timestamp("published_at") < cutoff_s), batch_id)


def stream_persist(changes: DataFrame, log: CommitLog, run_id: str, checkpoint: str) -> StreamingQuery:
    """Persist every micro-batch of changes as commits.persist_batch does: its cards, rank changes and cursors together. A
    batch that is run again, after a kill at any point, is committed once."""
    return changes.writeStream.foreachBatch(saver(log, run_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Groups whose state holds many keys each: a micro-batch costs a call of Python for a group and not for a key. A stream
#: keeps the number that it began with; more of them make smaller states, for streams of very many open keys.
GROUPS = 512
KEPT = "rows binary"


def _group(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(groups)).alias("part")


def _kept(state: GroupState, kinds: dict[str, str]) -> pd.DataFrame:
    """The rows that a group's state holds."""
    if not state.exists:
        return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in kinds.items()})
    return pa.ipc.open_stream(state.get[0]).read_all().to_pandas().astype(kinds)


def _keep(state: GroupState, rows: pd.DataFrame) -> None:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table)
    state.update((out.getvalue().to_pybytes(),))


def _in_bulk(frames: Iterator[pd.DataFrame], least: Callable[[], int]) -> Iterator[pd.DataFrame]:
    """The frames, several as one while they have fewer rows than the state, so that it is merged few times."""
    some: list[pd.DataFrame] = []
    for pdf in frames:
        some.append(pdf)
        if sum(map(len, some)) >= least():
            yield pd.concat(some, ignore_index=True)
            some = []
    if some:
        yield pd.concat(some, ignore_index=True)


RUN_STATE = "run_id string, stage string, seq long, status string"
_RUN = {"run_id": "object", "stage": "object", "seq": "Int64", "ended": "object", "end_seq": "Int64", "latest": "int64", "due": "int64", "came": "bool"}


def run_states(events: DataFrame, terminal: dict[str, str], lost_after_s: int, groups: int = GROUPS) -> DataFrame:
    """events(run_id, seq, stage, at), with a watermark on at -> (run_id, stage, seq, status), a row whenever a run changes.

    stage is the one of the highest seq. The first terminal stage, by seq, gives the run its status, such as done or error;
    until then it is running. A run without one is lost when the watermark is more than lost_after_s beyond its last
    event, by a timer of event time, so also if no event of it comes again; one that does, and is not late, sets it running.
    The runs of a group share its timer, which is set to the first of theirs.
    """

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        """One row a run; of equal seqs the first stands."""
        last = rows.sort_values("seq", ascending=False, kind="stable").drop_duplicates("run_id")[["run_id", "stage", "seq"]]
        ends = rows[rows["ended"].notna()].sort_values("end_seq", kind="stable").drop_duplicates("run_id")[["run_id", "ended", "end_seq"]]
        most = rows.groupby("run_id", sort=False, dropna=False, as_index=False)[["latest", "due", "came"]].max()
        return last.merge(ends, "left", "run_id").merge(most, "inner", "run_id").astype(_RUN)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, runs = state.getCurrentWatermarkMs(), _kept(state, _RUN)
        for pdf in [] if state.hasTimedOut else _in_bulk(frames, lambda: len(runs)):
            new = pdf[["run_id", "stage", "seq"]].assign(ended=pdf["stage"].map(terminal), latest=pdf["ms"], due=0, came=True)
            new["end_seq"] = new["seq"].where(new["ended"].notna())
            runs = folded(pd.concat([runs, new[list(_RUN)].astype(_RUN)], ignore_index=True))
        came = runs["came"]
        runs["due"] = runs["due"].where(~came, (runs["latest"] + lost_after_s * 1000).clip(lower=now + 1))
        over = ~came & (runs["due"] < now)
        status = runs["ended"].where(runs["ended"].notna(), "running").mask(over, "lost")
        said = came | (over & runs["ended"].isna())
        left = runs[~over].assign(came=False)
        if len(left):
            _keep(state, left)
            state.setTimeoutTimestamp(int(left["due"].min()))
        elif state.exists:
            state.remove()
        yield runs.assign(status=status)[said][["run_id", "stage", "seq", "status"]]

    x = events.select("run_id", "seq", "stage", "at", F.coalesce(F.unix_millis("at"), F.lit(0)).alias("ms"), _group("run_id", groups))
    return x.groupBy("part").applyInPandasWithState(fold, RUN_STATE, KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def run_progress(events: DataFrame) -> DataFrame:
    """The latest stage of each run. Works on batches, and on streams in update mode."""
    return events.groupBy("run_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


def usage_stream(calls: DataFrame) -> DataFrame:
    """Running totals of each run, stage and model."""
    sums = [F.sum(F.when(F.col("measured"), F.col(t)).otherwise(0)).alias(t) for t in ("input", "output")]
    return calls.groupBy("run_id", "stage", "model").agg(F.count_if("measured").alias("calls"), F.count_if(~F.col("measured")).alias("unmeasured"), *sums)


def daily_edition_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events of each UTC day. On a stream with a watermark on ts, in append mode, a day comes out once, when the watermark
    has closed it, and leaves the state; rows of closed days are dropped, and late_events gives them."""
    x = events.groupBy(F.window(ts, "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return x.select(F.unix_timestamp("w.start").alias("day_s"), "event_type", "n")


LATE = "day_s long, event_id long, event_type string"


def late_events(events: DataFrame) -> DataFrame:
    """Of a stream with a watermark on ts, the rows whose UTC day the watermark had closed when they came, as daily_edition_counts
    drops them. Keeps no state."""

    def closed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if (key[0] + 86400) * 1000 <= state.getCurrentWatermarkMs():
            for pdf in frames:
                yield pdf[["day_s", "event_id", "event_type"]]

    x = events.withColumn("day_s", F.unix_timestamp(F.date_trunc("day", "ts")))
    return x.groupBy("day_s").applyInPandasWithState(closed, LATE, "nothing boolean", "append", GroupStateTimeout.NoTimeout)


CARD_STATE = "id long, front_page_rank long, updates long"
_CARD = {"id": "Int64", "front_page_rank": "Int64", "updates": "int64"}


def card_state(changes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """changes(id, kind, rank): a card's rank after its insert and all rank updates, where null demotes.

    An update for a card that was never inserted is ignored, as in the batch form.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cards, came = _kept(state, _CARD), []
        for pdf in _in_bulk(frames, lambda: len(cards)):
            inserted, at = pdf["kind"] == "insert", pdf.index.to_series()
            since = at.where(inserted).groupby(pdf["id"], dropna=False).transform("min")
            some = pdf[pdf["id"].isin(cards["id"]) | (at >= since)]  # of a new card, from its insert on
            some = some[["id"]].assign(front_page_rank=some["rank"], updates=~inserted[some.index]).astype(_CARD)
            rows = pd.concat([cards, some], ignore_index=True)
            cards = rows.drop_duplicates("id", keep="last").drop(columns="updates")
            cards = cards.merge(rows.groupby("id", as_index=False, dropna=False)["updates"].sum(), "inner", "id").astype(_CARD)
            came.append(some["id"])
        if len(cards):
            _keep(state, cards)
        yield cards[cards["id"].isin(pd.concat(came))] if came else cards[:0]

    return changes.select("id", "kind", "rank", _group("id", groups)).groupBy("part").applyInPandasWithState(fold, CARD_STATE, KEPT, "update", GroupStateTimeout.NoTimeout)
