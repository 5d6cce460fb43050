"""Exact dedup: two passes over Bloom filter cells, so that only rows that may be repeated shuffle. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, field, join_groups, materialize, row_struct, text_or_empty

#: Bits of one bitmap row of the filter (what bitmap_construct_agg makes).
BLOCK = 1 << 15


def keyed(docs: DataFrame) -> list[Column]:
    """doc_id, the digest of the text without white space, and the code points of the original text."""
    text = text_or_empty()
    digest = F.sha2(F.translate(text, WHITE, ""), 256)
    return [F.col("doc_id"), digest.alias("text_sha256"), F.length(text).alias("n_code_points")]


def filter_bits(rows: int, bits_per_row: int, most_bits: int) -> int:
    """A power of two of at least bits_per_row bits a row, within [BLOCK, most_bits]."""
    return max(BLOCK, min(most_bits, 1 << max(0, rows * bits_per_row - 1).bit_length()))


def _cells(bits: int) -> list[Column]:
    """Two cells in one block, so that a row meets one bitmap."""
    first = F.xxhash64("text_sha256")
    cell = F.pmod(first, F.lit(bits))
    return [cell, cell - cell % BLOCK + F.pmod(F.xxhash64(first, F.lit(7)), F.lit(BLOCK))]


def repeat_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: the Bloom filter of cells that at least two rows hit, as (block, bitmap) rows.

    Its size is at most bits / 8 bytes. Counts are combined on the map side, so a hot digest is one row a task.
    """
    cell = digests.select(F.explode(F.array(*_cells(bits))).alias("cell"))
    again = cell.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    block, bit = F.shiftright("cell", 15).alias("block"), F.col("cell").bitwiseAND(F.lit(BLOCK - 1))
    return again.groupBy(block).agg(F.bitmap_construct_agg(bit).alias("bitmap"))


def _probe(rows: DataFrame, cells: DataFrame, bits: int) -> DataFrame:
    """Pass 2: rows with a column maybe, true if both of the row's cells are in the filter, which is broadcast once."""
    first, second = _cells(bits)
    x = rows.withColumn("_cell0", first).withColumn("_cell1", second).withColumn("_block", F.shiftright("_cell0", 15))
    x = x.join(F.broadcast(cells.select(F.col("block").alias("_block"), F.col("bitmap").alias("_bitmap"))), "_block", "left")
    tests = [
        F.expr(f"shiftright(cast(conv(hex(substring(_bitmap, int((_cell{k} & {BLOCK - 1}) div 8) + 1, 1)), 16, 10) as int), int(_cell{k} & 7)) & 1")
        for k in (0, 1)
    ]
    return x.select(*rows.columns, F.coalesce(tests[0] * tests[1] == 1, F.lit(False)).alias("maybe"))


def _more_bits(rows: int) -> int:
    """The filter's bound in bits: 32 MB, and from 16.8 million rows on as many as the rows need, up to 256 MB, which a
    broadcast can carry; see exact_dedup for what is beyond."""
    return max(1 << 28, min(1 << 31, 1 << max(0, rows * 8 - 1).bit_length()))


def exact_dedup(docs: DataFrame, carry: bool = False, bits_per_row: int = 16, most_bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, n_code_points, keep_id, group_size, kept.

    With carry=True also the whole row as struct column row (so extra columns of any name do not clash). Texts are
    equal when identical without white space; null counts as empty. The longest original text stays, then the
    smallest doc_id; a null doc_id comes last. Exactly one row of a group is kept: of rows that repeat its keep_id, the
    longest text's, and of identical rows any one. An empty table gives an empty one.

    The filter is broadcast, so its size is bounded (_more_bits, unless most_bits is given). Beyond 2^31 bits, some 270
    million rows at 8 bits a row, it lets more single rows through to the shuffle; the result stays the same.
    """
    digests = materialize(docs.select(*keyed(docs)), "digests")
    n_rows = digests.count()
    bits = filter_bits(n_rows, bits_per_row, _more_bits(n_rows) if most_bits is None else most_bits)
    cells = materialize(repeat_filter(digests, bits), "cells")
    rows = _probe(docs.select(row_struct(docs).alias("row"), *keyed(docs)) if carry else digests, cells, bits)
    by_doc = _probe(digests, cells, bits).where("maybe").groupBy("text_sha256", "doc_id").agg(F.max("n_code_points").alias("n"), F.count("*").alias("rows"))
    best = F.max_by(F.struct("doc_id", "rows"), F.struct("n", F.bitwise_not("doc_id"))).alias("best")
    groups = by_doc.groupBy("text_sha256").agg(best, F.sum("rows").alias("group_size"))
    groups = materialize(groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.rows").alias("keepers"), "group_size"), "groups")
    single = rows.where("not maybe").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    single = single.withColumn("kept", F.lit(True)).drop("maybe")
    several = join_groups(rows.where("maybe"), groups, "text_sha256", "group_size").drop("maybe")
    candidate = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if not groups.where("keepers > 1").count():
        return single.unionByName(several.drop("keepers").withColumn("kept", candidate))
    # Rows that repeat the keep_id of their group: number them, and keep the first of the longest.
    tied = (F.col("keepers") > 1) & candidate
    rest = several.where(~tied).drop("keepers").withColumn("kept", candidate)
    tied = materialize(several.where(tied).withColumn("nth", F.monotonically_increasing_id()), "tied")
    first = tied.groupBy("text_sha256").agg(F.min(F.struct(-F.col("n_code_points"), "nth"))["nth"].alias("first"), F.count("*").alias("ties"))
    tied = join_groups(tied.drop("keepers"), materialize(first, "first"), "text_sha256", "ties")
    tied = tied.withColumn("kept", F.col("nth") == F.col("first")).drop("nth", "first", "ties")
    return single.unionByName(rest).unionByName(tied)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with the columns of docs, whatever their names.

    Nulls, empty texts, ties and repeated rows are as in exact_dedup; an empty table gives an empty one.
    """
    kept = exact_dedup(docs, carry=True).where("kept")
    return kept.select(*(field("row", c) for c in docs.columns))
