"""Helpers that the operators share: written tables, joins on skewed groups, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters [\x20\x09-\x0D], the only ones that count as white space in this subpackage.
WHITE = " \t\n\x0b\x0c\r"
#: A group with at least 1 / HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000
_OWN_DIRS: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, as one row may hold a very long text, and let workers on this machine import this
    package; on a cluster it is installed, or sent with --py-files."""
    if is_local(spark):
        spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors run on one machine."""
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, as in tests, a folder of our
    own if driver and executor are one process, and else an error, as executors would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: it cuts the lineage, survives a lost executor, and gives
    joins a table of known size."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_struct(docs: DataFrame) -> Column:
    """The whole row as one struct, whatever its columns are called."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns))


def field(struct: str, name: str) -> Column:
    """One field of row_struct under its own name."""
    return F.col(f"{struct}.{quoted(name)}").alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join of rows with one row per key, inner or left, safe when one key holds a large share of the rows.

    groups must be a written table with the number of rows of each key in column size. Its hot keys, at most
    HOT_SHARE of them by definition, are broadcast; the others, each below 1 / HOT_SHARE of the rows, shuffle.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    cold = groups.hint("merge")
    if not total or largest * HOT_SHARE < total:
        return rows.join(cold, key, how)
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    rest = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold.where(~is_hot), key, how))


def connected_components(edges: DataFrame, label: str = "components", most: int = 60) -> DataFrame:
    """(node, component) for every node of edges(src, dst); component is the smallest node that it reaches.

    Alternates large-star and small-star steps, each an aggregation and a skew-safe join, until all edges form stars: no
    node hangs on two others, or on one that hangs itself. Nodes may be of any ordered type; null ends and loops are
    ignored. An empty table gives an empty one.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    edges = materialize(edges.where("src <> dst").select(low, high).distinct(), label)

    def settled(e: DataFrame) -> bool:
        below = e.select(F.col("dst").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
        above = e.select(F.col("src").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")).distinct()
        both = below.unionByName(above).groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        return not both.where("hangs > 1 or hangs > 0 and holds > 0").count()

    for _ in range(most):
        if settled(edges):
            break
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
        both = both.unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = materialize(least.withColumn("m", F.least("m", "u")), label)
        large = join_groups(both.where("v > u"), least, "u", "n").select(F.col("m").alias("src"), F.col("v").alias("dst"))
        large = materialize(large.where("src <> dst").distinct(), label)
        down = large.select(F.col("dst").alias("u"), F.col("src").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), label)
        small = join_groups(down, least, "u", "n").select(F.col("m").alias("src"), F.col("v").alias("dst"))
        small = small.unionByName(least.select(F.col("m").alias("src"), F.col("u").alias("dst")))
        edges = materialize(small.where("src <> dst").distinct(), label)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    members = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("component"))
    roots = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    return members.unionByName(roots)


def shared_bits(ids: DataFrame, column: str, per_row: int = 16, most: int = 1 << 28) -> DataFrame:
    """(block, bitmap) rows of a filter with one bit for the hash of each id; at most `most` bits in all."""
    bits = max(1 << 15, min(most, 1 << max(0, ids.count() * per_row - 1).bit_length()))
    cell = F.pmod(F.xxhash64(column), F.lit(bits))
    block, bit = F.shiftright(cell, 15).alias("block"), cell.bitwiseAND(F.lit((1 << 15) - 1))
    made = ids.groupBy(block).agg(F.bitmap_construct_agg(bit).alias("bitmap"))
    return materialize(made.withColumn("bits", F.lit(bits)), "bits")


def marked_bits(rows: DataFrame, column: str, filter_rows: DataFrame) -> DataFrame:
    """rows with a column maybe: whether the id may be in the filter. The filter is broadcast; its size is bounded where
    it is made."""
    found = filter_rows.select("bits").first()
    if found is None:
        return rows.withColumn("maybe", F.lit(False))
    cell = F.pmod(F.xxhash64(column), F.lit(found["bits"]))
    marked = rows.withColumn("_cell", cell).withColumn("_block", F.shiftright("_cell", 15))
    marked = marked.join(F.broadcast(filter_rows.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))), "_block", "left")
    byte = F.expr("cast(conv(hex(substring(_bitmap, int((_cell & 32767) div 8) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, F.expr("int(_cell & 7)")).bitwiseAND(F.lit(1)) == 1
    return marked.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def with_bits(rows: DataFrame, column: str, filter_rows: DataFrame) -> DataFrame:
    """The rows whose id may be in the filter."""
    return marked_bits(rows, column, filter_rows).where("maybe").select(*rows.columns)
