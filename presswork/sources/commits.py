"""A log of commits over table folders: each commit is one new file that names the folders it adds."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """Tables beneath one folder. Data folders are written first and belong to no table until a commit names them.

    Commits are numbered from 0, and a number is taken by moving a finished file to its name, which fails if that name
    exists; so of two writers one takes the next number instead, and readers only ever see whole commits. Nothing is
    overwritten: a reader that took a version keeps reading it while others commit.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        folder = self._path(f"{self.base}/_log")
        folder.getFileSystem(self._conf).mkdirs(folder)

    def _path(self, path: str):
        return self._fs.Path(path)

    def _create(self, path: str, text: str) -> bool:
        """Whether the file was made; false if there is one of that name."""
        draft, to = self._path(f"{self.base}/_log/.{uuid.uuid4().hex}"), self._path(path)
        files = draft.getFileSystem(self._conf)
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        how = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(how, 1)
        options[0] = how.NONE
        try:
            self._fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(draft, to, options)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            files.delete(draft, False)
            return False

    def commits(self) -> list[dict]:
        """All commits from the last one that replaced what was before, in order; each has its version."""
        files = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.base}/_log")
        found = sorted((json.loads(r["value"]) for r in files.collect()), key=lambda c: c["version"])  # a small file a commit
        starts = [i for i, c in enumerate(found) if c["replaces"]]
        return found[starts[-1] if starts else 0 :]

    def has(self, run_id: str, batch_id: int, commits: list[dict] | None = None) -> bool:
        """Whether the batch is committed; the batches of a run are committed in order."""
        return any(c["batches"].get(run_id, -1) >= batch_id for c in (self.commits() if commits is None else commits))

    def _write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        folders = {name: uuid.uuid4().hex for name in tables}
        for name, rows in tables.items():
            rows.write.parquet(f"{self.base}/data/{folders[name]}")
        return folders

    def _take(self, version: int, replaces: bool, batches: dict[str, int], folders: dict[str, str]) -> bool:
        record = {"version": version, "replaces": replaces, "batches": batches, "folders": folders}
        return self._create(f"{self.base}/_log/{version:020d}.json", json.dumps(record))

    def commit(self, run_id: str, batch_id: int, tables: dict[str, DataFrame]) -> int | None:
        """Write the tables' new rows and commit them, once for each (run_id, batch_id): None if that is committed already.
        A writer killed before the commit leaves folders that no reader looks at."""
        known = self.commits()
        if self.has(run_id, batch_id, known):
            return None
        folders = self._write(tables)
        while not self._take(version := known[-1]["version"] + 1 if known else 0, not known, {run_id: batch_id}, folders):
            known = self.commits()
            if self.has(run_id, batch_id, known):
                return None
        return version

    def replace(self, commits: list[dict], tables: dict[str, DataFrame]) -> int | None:
        """One commit in place of these, the newest ones: None, and nothing done, if another commit came after them."""
        version = commits[-1]["version"] + 1 if commits else 0
        batches: dict[str, int] = {}
        for c in commits:
            batches |= {k: max(v, batches.get(k, -1)) for k, v in c["batches"].items()}
        return version if self._take(version, True, batches, self._write(tables)) else None

    def read(self, name: str, schema: str, commits: list[dict] | None = None) -> DataFrame:
        """The rows of all commits of a table, with the version that added each in column version."""
        folders = {c["folders"][name]: c["version"] for c in (self.commits() if commits is None else commits) if name in c["folders"]}
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("long"))
        x = self.spark.read.schema(schema).parquet(*(f"{self.base}/data/{f}" for f in folders))
        versions = self.spark.createDataFrame(list(folders.items()), "folder string, version long")  # a row a commit
        columns = x.columns
        x = x.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1))
        return x.join(F.broadcast(versions), "folder").select(*columns, "version")


def write_snapshot(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> int:
    """These tables in place of all that was before: readers see the old ones or the new ones, never a mix."""
    log = CommitLog(spark, base)
    while (version := log.replace(log.commits(), tables)) is None:
        continue
    return version


def read_snapshot(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table of the newest snapshot, with its own columns."""
    log = CommitLog(spark, base)
    return spark.read.parquet(f"{log.base}/data/{log.commits()[-1]['folders'][name]}")


CARDS = "digest_id string, id bigint, front_page_rank bigint, created_s bigint"
RANKS = "digest_id string, id bigint, new_rank bigint, seq bigint"
DIGESTS = "id string, last_generated_s bigint"
RUNS = "digest_id string, run_at_s bigint"


def open_store(log: CommitLog, cards: DataFrame, digests: DataFrame) -> None:
    """Start from these tables, unless the log has started already."""
    log.commit("open", 0, {"cards": cards.selectExpr(*_typed(CARDS)), "digests": digests.selectExpr(*_typed(DIGESTS))})


def _typed(schema: str) -> list[str]:
    return [f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", ")]


def persist_batch(log: CommitLog, run_id: str, batch_id: int, changes: DataFrame) -> int | None:
    """One batch of changes(digest_id, id, kind, rank, run_at_s, seq): kind insert is a new card of the run, rank changes the
    rank of a card of the same digest that was there before, and every row's digest gets the run's stamp as its cursor.
    One commit takes all of it; a batch that comes again changes nothing. Only the batch is written, not the tables."""
    new = changes.where("kind = 'insert'").selectExpr("digest_id", "id", "rank as front_page_rank", "run_at_s as created_s")
    ranks = changes.where("kind = 'rank'").selectExpr("digest_id", "id", "rank as new_rank", "seq")
    runs = changes.groupBy("digest_id").agg(F.max("run_at_s").alias("run_at_s"))
    return log.commit(run_id, batch_id, {"cards": new.selectExpr(*_typed(CARDS)), "ranks": ranks.selectExpr(*_typed(RANKS)), "runs": runs.selectExpr(*_typed(RUNS))})


def current(log: CommitLog, commits: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cards, digests) of the newest version: each card with the rank that the last commit after its own gave it, null
    included, and each digest with the stamp of its last run. Of several ranks in a commit that of the highest seq stands."""
    at = log.commits() if commits is None else commits
    last = F.max_by(F.struct("new_rank", "version"), F.struct("version", "seq")).alias("last")
    ranks = log.read("ranks", RANKS, at).groupBy("digest_id", "id").agg(last)
    x = log.read("cards", CARDS, at).join(ranks.hint("merge"), ["digest_id", "id"], "left")
    rank = F.when(F.col("last.version") > F.col("version"), F.col("last.new_rank")).otherwise(F.col("front_page_rank"))
    cards = x.select("digest_id", "id", rank.alias("front_page_rank"), "created_s")
    runs = log.read("runs", RUNS, at).groupBy("digest_id").agg(F.max_by("run_at_s", "version").alias("run_at_s"))
    digests = log.read("digests", DIGESTS, at).drop("version").join(runs.withColumnRenamed("digest_id", "id").hint("merge"), "id", "full")
    return cards, digests.select("id", F.coalesce("run_at_s", "last_generated_s").alias("last_generated_s"))


def compact(log: CommitLog) -> int | None:
    """One commit that holds all there is and replaces the ones before it, so that readers open few folders again; None if
    another commit came in between."""
    at = log.commits()
    cards, digests = current(log, at)
    return log.replace(at, {"cards": cards, "digests": digests})


def saver(log: CommitLog, run_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every micro-batch of a stream of changes as a commit."""

    def save(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # written three times
        try:
            persist_batch(log, run_id, batch_id, kept)
        finally:
            kept.unpersist()

    return save
