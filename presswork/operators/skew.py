"""Joins and components that stay spread over tasks when one key holds a large share of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least 1 / HOT of the rows is hot, so there are at most HOT of them to broadcast.
HOT = 1000
#: So many links, some megabytes, are worked by one task rather than by rounds of joins.
FEW_LINKS = 100_000
#: Where written tables go, if not straight into the shared folder.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in a single process, and else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _FOLDERS.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def package_on_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package; on a cluster it is installed, or sent with --py-files."""
    if spark.sparkContext.master.startswith("local"):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that written makes inside of it are deleted at its end, so results must be used or saved before."""
    folder = f"{_SCRATCH.get() or shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    before = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and its size known. See scratch for when it goes."""
    path = f"{_SCRATCH.get() or shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_hot_keys(rows: DataFrame, per_key: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with a written table of one row a key, whose column size counts the rows of the key."""
    most = per_key.agg(F.sum(size).alias("all"), F.max(size).alias("top")).first()
    if not most["all"] or most["top"] * HOT < most["all"]:
        return rows.join(per_key.hint("merge"), key)
    hot = F.col(size) * HOT >= F.lit(most["all"])
    few = per_key.where(hot)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(per_key.where(~hot).hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(others)


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of a few links, by a forest whose roots are the smallest ids."""
    above: dict = {}
    kind = None

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for b in batches:
        kind = b.schema.field("a").type
        for a, c in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            low, high = sorted((root(a), root(c)))
            above[high] = low
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([root(x) for x in list(above)], kind)], ["id", "component"])


def star_components(links: DataFrame, rounds: int = 200, few: int = FEW_LINKS) -> DataFrame:
    """(id, component) of every end of links(a, b): the smallest id that it reaches. Ends that link to nothing but
    themselves are left out.

    At most few links are worked by one task, which a table of that size does not burden; more of them go by rounds. Each
    round hangs every id's larger neighbours on the smallest one, then every id's smaller neighbours too, so the
    distances shrink by a factor each round; it ends when all links form stars. Rounds grow with the logarithm of
    the longest chain, so the bound is far beyond what any table needs.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    if links.count() <= few:
        kind = links.schema["a"].dataType.simpleString()
        package_on_workers(links.sparkSession)
        return links.coalesce(1).mapInArrow(_joined_up, f"id {kind}, component {kind}")

    def smallest(ends: DataFrame) -> DataFrame:
        return written(ends.groupBy("x").agg(F.least(F.min("y"), "x").alias("root"), F.count("*").alias("n")))

    def all_stars(x: DataFrame) -> bool:
        ends = x.select(F.col("b").alias("id"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(x.select(F.col("a").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        ends = ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        return not ends.where("hangs > 1 or hangs + holds > 1").count()

    for _ in range(rounds):
        if all_stars(links):
            break
        both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        wide = with_hot_keys(both.where("y > x"), smallest(both), "x", "n").select(F.col("root").alias("a"), F.col("y").alias("b"))
        down = written(wide.where("a <> b").distinct()).select(F.col("b").alias("x"), F.col("a").alias("y"))
        roots = smallest(down)
        near = with_hot_keys(down, roots, "x", "n").select(F.col("root").alias("a"), F.col("y").alias("b"))
        near = near.unionByName(roots.select(F.col("root").alias("a"), F.col("x").alias("b")))
        links = written(near.where("a <> b").distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
