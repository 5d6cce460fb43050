"""Streams over several runs, and the commit log under kills and rival writers."""

import collections
import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from presswork.operators import tables
from presswork.sources import commits
from presswork.streaming import streams

START = dt.datetime(2026, 7, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


class Turns:
    """A stream that is run once for each part of its input, from one checkpoint; keeps all that it gave."""

    def __init__(self, spark, tmp_path, schema, of, mode):
        self.spark, self.base, self.schema, self.of, self.mode, self.rows = spark, str(tmp_path), schema, of, mode, []

    def turn(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        stream = self.of(self.spark.readStream.schema(self.schema).parquet(f"{self.base}/in"))
        got = []
        q = stream.writeStream.foreachBatch(lambda b, k: got.extend(b.collect())).outputMode(self.mode)
        q = q.option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        self.rows += got
        return got, q.recentProgress


def test_runs_end_or_are_lost(spark, tmp_path):
    of = lambda s: streams.run_states(s.withWatermark("at", "1 hour"), {"done": "done", "error": "error"}, 2 * 3600)
    turns = Turns(spark, tmp_path, "run_id string, seq long, stage string, at timestamp", of, "update")

    def states(rows):
        return {r["run_id"]: (r["stage"], r["seq"], r["status"]) for r in turns.turn(rows)[0]}

    first = states([("a", 1, "ingest", at(0)), ("a", 2, "done", at(0.1)), ("b", 1, "ingest", at(0)), ("c", 3, "error", at(0.2)), ("c", 1, "ingest", at(0)), ("c", 4, "done", at(0.3))])
    assert first == {"a": ("done", 2, "done"), "b": ("ingest", 1, "running"), "c": ("done", 4, "error")}
    # The watermark goes to 2.5 hours: b's last event is more than two hours behind, and ended runs say nothing more.
    assert states([("d", 1, "ingest", at(3.5))]) == {"d": ("ingest", 1, "running"), "b": ("ingest", 1, "lost")}
    # An event that is late is dropped; one in time sets a lost run running again.
    assert states([("b", 2, "write", at(1)), ("b", 3, "rank", at(3))]) == {"b": ("rank", 3, "running")}
    assert states([("e", 1, "ingest", at(30))]) == {"e": ("ingest", 1, "running"), "b": ("rank", 3, "lost"), "d": ("ingest", 1, "lost")}


def test_closed_days_leave_the_state_and_late_rows_go_aside(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string"
    marked = lambda s: s.withWatermark("ts", "2 hours")
    counts = Turns(spark, tmp_path / "counts", schema, lambda s: streams.daily_edition_counts(marked(s)), "append")
    late = Turns(spark, tmp_path / "late", schema, lambda s: streams.late_events(marked(s)), "append")
    day = lambda n: int(START.replace(tzinfo=dt.timezone.utc).timestamp()) + 86400 * n
    bulk = [(1, at(1), "a"), (2, at(5), "a"), (3, at(23.9), "b"), (4, at(25), "a"), (5, at(50), "a")]
    got, progress = counts.turn(bulk)
    assert {tuple(r) for r in got} == {(day(0), "a", 2), (day(0), "b", 1), (day(1), "a", 1)}
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # only the day that is open
    assert late.turn(bulk)[0] == []
    more = [(6, at(2), "a"), (7, at(49), "b"), (8, at(100), "a")]
    got, progress = counts.turn(more)
    assert {tuple(r) for r in got} == {(day(2), "a", 1), (day(2), "b", 1)}
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    assert [tuple(r) for r in late.turn(more)[0]] == [(day(0), 6, "a")]
    assert collections.Counter(r["day_s"] for r in counts.rows)[day(0)] == 2  # no day comes out twice


def test_usage_totals_run_on(spark, tmp_path):
    schema = "run_id long, stage string, model string, input long, output long, measured boolean"
    turns = Turns(spark, tmp_path, schema, streams.usage_stream, "update")
    assert [tuple(r) for r in turns.turn([(1, "s", "m", 5, 1, True), (1, "s", "m", 7, 2, False)])[0]] == [(1, "s", "m", 1, 1, 5, 1)]
    assert {tuple(r) for r in turns.turn([(1, "s", "m", 10, 3, True), (2, "s", "m", 1, 1, True)])[0]} == {(1, "s", "m", 2, 1, 15, 4), (2, "s", "m", 1, 0, 1, 1)}


# ---- the commit log
CHANGES = "digest_id string, id long, kind string, rank long, run_at_s long, seq long"


def store(spark, base):
    log = commits.CommitLog(spark, base)
    cards = spark.createDataFrame([("d1", 1, 1, 10), ("d1", 2, None, 10), ("d2", 3, 2, 10)], commits.CARDS)
    commits.open_store(log, cards, spark.createDataFrame([("d1", 10), ("d2", None), ("d3", 7)], commits.DIGESTS))
    return log


BATCHES = [
    [("d1", 10, "insert", 3, 100, 1), ("d1", 1, "rank", None, 100, 2), ("d1", 3, "rank", 6, 100, 3), ("d1", 77, "rank", 1, 100, 4)],
    [("d1", 10, "rank", 5, 200, 1), ("d2", 20, "insert", None, 200, 2), ("d2", 3, "rank", 1, 200, 3), ("d2", 3, "rank", 4, 200, 4)],
    [("d4", 40, "insert", 1, 300, 1), ("d1", 1, "rank", 2, 300, 2)],
]


def contents(log):
    cards, digests = commits.current(log)
    return sorted(tuple(r) for r in cards.collect()), sorted((r["id"], r["last_generated_s"]) for r in digests.collect())


def replayed(spark):
    """The batches by the operator that takes whole tables."""
    cards = spark.createDataFrame([("d1", 1, 1, 10), ("d1", 2, None, 10), ("d2", 3, 2, 10)], commits.CARDS)
    digests = spark.createDataFrame([("d1", 10), ("d2", None), ("d3", 7), ("d4", None)], commits.DIGESTS)
    for rows in BATCHES:
        new = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows if r[2] == "insert"], "digest_id string, id long, front_page_rank long")
        last = {(r[0], r[1]): r[3] for r in rows if r[2] == "rank"}
        updates = spark.createDataFrame([(*k, v) for k, v in last.items()], "digest_id string, id long, new_rank long")
        runs = spark.createDataFrame(list({(r[0], r[4]) for r in rows}), "digest_id string, run_at_s long")
        cards, digests = tables.persist_runs(cards, digests, new, updates, runs)
    cards = sorted(tuple(r) for r in cards.select("digest_id", "id", "front_page_rank", "created_s").collect())
    return cards, sorted((r["id"], r["last_generated_s"]) for r in digests.collect())


@pytest.mark.parametrize("compacted", [False, True])
def test_batches_persist_as_whole_tables_do(spark, tmp_path, compacted):
    log = store(spark, str(tmp_path))
    for k, rows in enumerate(BATCHES):
        changes = spark.createDataFrame(rows, CHANGES)
        assert commits.persist_batch(log, "run", k, changes) is not None
        if compacted:
            commits.compact(log)
        assert commits.persist_batch(log, "run", k, changes) is None  # again
    assert contents(log) == replayed(spark)
    assert len(log.commits()) == (1 if compacted else 4)


def test_killed_batches(spark, tmp_path, monkeypatch):
    """Killed before the commit, and after it but before the stream's checkpoint: one version, and readers go on."""
    log = store(spark, str(tmp_path / "store"))
    before = contents(log)
    spark.createDataFrame(BATCHES[0], CHANGES).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))
        streams.stream_persist(stream, log, "s", str(tmp_path / "checkpoint")).awaitTermination()

    take, state = commits.CommitLog._take, {"fails": "before"}

    def dying(self, *args):
        if state["fails"] == "before":
            raise RuntimeError("killed before the commit")
        done = take(self, *args)
        if state["fails"] == "after":
            raise RuntimeError("killed after the commit")
        return done

    monkeypatch.setattr(commits.CommitLog, "_take", dying)
    with pytest.raises(Exception, match="killed before"):
        run()
    assert contents(log) == before
    state["fails"] = "after"
    with pytest.raises(Exception, match="killed after"):
        run()
    after = contents(log)
    state["fails"] = ""
    run()
    assert contents(log) == after != before and [c["version"] for c in log.commits()] == [0, 1]


def test_rival_writers_take_turns(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path))
    stale = log.commits()
    errors = []

    def write(name):
        try:
            for k in range(3):
                assert commits.CommitLog(spark, str(tmp_path)).commit(name, k, {"t": spark.range(2).withColumn("who", F.lit(name))}) is not None
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted(c["version"] for c in log.commits()) == list(range(9))
    assert collections.Counter(r["who"] for r in log.read("t", "id long, who string").collect()) == {"x": 6, "y": 6, "z": 6}
    assert log.replace(stale, {"t": spark.range(1)}) is None  # others came in between


# ---- many keys
def test_runs_of_a_group_share_its_state(spark, tmp_path):
    """200 runs in 4 groups: each run keeps its own timer, and ties of seq, late rows and terminal stages hold."""
    of = lambda s: streams.run_states(s.withWatermark("at", "1 hour"), {"done": "done"}, 2 * 3600, groups=4)
    turns = Turns(spark, tmp_path, "run_id string, seq long, stage string, at timestamp", of, "update")
    got, progress = turns.turn([(f"r{i}", s, "done" if s == 2 and i % 4 == 0 else "ingest", at(i / 100)) for i in range(200) for s in (1, 2)])
    assert collections.Counter(r["status"] for r in got) == {"running": 150, "done": 50}
    assert progress[0]["stateOperators"][0]["numRowsTotal"] <= 4
    got, _ = turns.turn([("new", 1, "ingest", at(4.005)), ("r199", 3, "write", at(4))])  # the watermark goes to 3.005
    lost = {r["run_id"] for r in got if r["status"] == "lost"}
    assert lost == {f"r{i}" for i in range(101) if i % 4}
    assert {(r["run_id"], r["stage"], r["seq"]) for r in got if r["status"] == "running"} == {("new", "ingest", 1), ("r199", "write", 3)}


def test_cards_of_a_group_share_its_state(spark, tmp_path):
    turns = Turns(spark, tmp_path, "id long, kind string, rank long", lambda s: streams.card_state(s, groups=4), "update")
    got, progress = turns.turn([(i, "insert" if i % 2 else "update", i if i % 3 else None) for i in range(200)])
    assert {tuple(r) for r in got} == {(i, i if i % 3 else None, 0) for i in range(1, 200, 2)}
    assert progress[0]["stateOperators"][0]["numRowsTotal"] <= 4
    got, _ = turns.turn([(1, "update", 7), (1, "update", None), (2, "update", 5), (4, "update", 1), (4, "insert", 2), (4, "update", 3)])
    assert {tuple(r) for r in got} == {(1, None, 2), (4, 3, 1)}
