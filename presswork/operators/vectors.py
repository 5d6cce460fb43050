"""Joins of vectors by similarity: tiles of two sides multiplied as matrices, bands of hyperplanes, and pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import package_on_workers, with_hot_keys, written

#: Rows of one side of a tile: 1 MB of vectors of 64 doubles, and 8 MB of products.
TILE = 1024
#: Where all rows of a block meet, a side has no more bytes of doubles than the second, so that rows are sent a few times
#: only, and fewer, down to the first, where the session's tasks would have no tiles. Products are made a strip at a time.
SIDE_BYTES = 1 << 22, 1 << 24
#: Numbers of a product, or of rows gathered for one, that a worker holds at a time: 16 MB of doubles.
CELLS = 1 << 21
#: Tiles of TILE rows, or as many pairs, that one task works, where there are many; and most tasks of a stage.
TILES_A_TASK, MOST_TASKS = 256, 1 << 20
#: Least recall asked of the bands for pairs right at the threshold; those above it fare better.
RECALL = 0.95
#: Rows that one code of a band should bring together on average, if the vectors lie at random. A tile's products cost
#: less than to send its rows, so buckets are large and bands few.
BUCKET = 512
#: Rows that one row is compared with in the time that it takes to send it once.
COMPARED = 1024
#: Share of the vectors' squared length that the pivots carry.
CARRIED = 0.9
#: Pivots are fitted on a sample of at most so many vectors; results do not depend on which.
PIVOT_ROWS = 4096
#: Products of matrices and sums in order may differ in the last digits; so far apart, they cannot swap.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in order, so that equal vectors have equal products wherever they are worked."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _products(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dots of the rows a of left and b of right, a piece at a time, as the rows of many pairs are far more than those of the sides."""
    out, piece = np.empty(len(a)), max(1, CELLS // max(1, left.shape[1]))
    for lo in range(0, len(a), piece):
        out[lo : lo + piece] = dots(left[a[lo : lo + piece]], right[b[lo : lo + piece]])
    return out


def _usable(rows: DataFrame, key: list[str], vector: str) -> DataFrame:
    package_on_workers(rows.sparkSession)
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(" and ".join(f"{k} is not null" for k in key))


def _parts(rows: DataFrame, key: list[str], tile: int, name: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias(name), F.count("*").alias(f"n_{name}"))


def _part(of: Column, parts: str) -> Column:
    return F.pmod(F.xxhash64(of), F.col(parts)).cast("int")


def _tile_key(*columns: str) -> Column:
    """One text for all of a tile's columns, so that tasks are dealt tiles and read one after the other."""
    return F.concat_ws("\0", *(F.col(c).cast("string") for c in columns)).alias("tile")


def _dealt(rows: DataFrame, tiles: int) -> DataFrame:
    """rows by tile, over the session's number of shuffle partitions, or more where tiles are many; a large tile counts as
    many. The number is fixed, as tiles cost far more work than bytes, by which adaptive execution would join partitions."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tiles // TILES_A_TASK))
    return rows.repartition(min(tasks, MOST_TASKS), "tile").sortWithinPartitions("tile")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile at a time, from batches sorted by tile."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        tiles = b["tile"].to_numpy(zero_copy_only=False)
        heads = [0, *(np.flatnonzero(tiles[1:] != tiles[:-1]) + 1).tolist(), len(tiles)]
        if kept and kept[-1]["tile"][0].as_py() != tiles[0]:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        for at, to in zip(heads[:-1], heads[1:], strict=True):
            kept.append(b.slice(at, to - at))
            if to < len(tiles):
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t[name]
    return x.chunk(0) if x.num_chunks == 1 else x.combine_chunks()


# ---- pairs of one table
class Bands:
    """The signs of random hyperplanes as codes of some bits, one for each band; the same planes for the same seed."""

    def __init__(self, bits: int, bands: int, seed: int):
        self.bits, self.bands, self.seed, self.planes = bits, bands, seed, None

    def codes(self, vectors: np.ndarray, bands: int | None = None) -> np.ndarray:
        """The codes of all bands, or of the first ones, worked out for some rows at a time."""
        bands = self.bands if bands is None else bands
        if self.planes is None or self.planes.shape[0] != vectors.shape[1]:
            self.planes = np.random.default_rng(self.seed).standard_normal((vectors.shape[1], self.bits * self.bands))
        planes, weights = self.planes[:, : bands * self.bits], (1 << np.arange(self.bits)).astype(np.int32)
        out, step = np.empty((len(vectors), bands), np.int32), max(1, CELLS // max(1, planes.shape[1]))
        for lo in range(0, len(vectors), step):
            part = vectors[lo : lo + step]
            signs = (part @ planes > 0).reshape(len(part), bands, self.bits)
            out[lo : lo + step] = (signs * weights).sum(axis=2, dtype=np.int32)
        return out

    def first(self, vectors: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
        """Which pairs of rows a and b meet in no band before this one."""
        used = np.zeros(len(vectors), bool)
        used[a] = used[b] = True
        at, codes = np.cumsum(used) - 1, self.codes(vectors[used], band).T
        apart = np.arange(len(a))
        for code in codes:
            apart = apart[code[at[a[apart]]] != code[at[b[apart]]]]
        return apart


def _similar(left: np.ndarray, right: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of at least that product, those above the diagonal where both sides are the same; a strip of the left
    side at a time, and so few pairs at once that their rows may be gathered."""
    step, piece = max(1, CELLS // max(1, len(right))), max(1, CELLS // max(1, left.shape[1]))
    for lo in range(0, len(left), step):
        start = lo if same else 0
        a, b = np.divmod(np.flatnonzero(left[lo : lo + step] @ right[start:].T >= least), max(1, len(right) - start))
        a, b = a + lo, b + start
        if same:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), piece):
            yield a[at : at + piece], b[at : at + piece]


def _pairs_of_tiles(least: float, bands: Bands | None = None):
    """Pairs of a tile: of all its rows with one another on the diagonal, else of its first part with its second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches):
            ids, parts, vectors = t["id"].to_numpy(), t["part"].to_numpy(), _matrix(_column(t, "embedding"))
            left = np.flatnonzero(parts == t["i"][0].as_py())
            same = t["i"][0].as_py() == t["j"][0].as_py()
            right = left if same else np.flatnonzero(parts == t["j"][0].as_py())
            for a, b in _similar(vectors[left], vectors[right], least - SLACK, same):
                a, b = left[a], right[b]
                if bands is not None:  # only in the first band that brings the two together
                    first = bands.first(vectors, a, b, t["band"][0].as_py())
                    a, b = a[first], b[first]
                sims = dots(vectors[a], vectors[b])
                keep = (sims >= least) & (ids[a] != ids[b])
                a, b, sims = ids[a][keep], ids[b][keep], sims[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(sims)], ["a", "b", "sim"])

    return run


def _side(groups: DataFrame, tasks: int) -> int:
    """Rows of a side of a tile, so that tasks of such a number have two tiles each, within SIDE_BYTES."""
    x = groups.agg(F.sum(F.expr("n_parts * (n_parts - 1D) / 2")).alias("pairs"), F.max("dims").alias("dims")).first()
    low, high = (max(1, size // (8 * max(1, x["dims"] or 1))) for size in SIDE_BYTES)
    return max(low, min(high, math.isqrt(int((x["pairs"] or 0) / (2 * tasks)))))


def _tiled(rows: DataFrame, key: list[str], tile: int | None) -> DataFrame:
    """rows dealt into parts of their group, each row once for every tile (i, j), i <= j, that its part is a side of.
    Groups of one row are left out, as they have no pairs. Without tile, its rows are as many as _side says."""
    groups = rows.groupBy(*key).agg(F.count("*").alias("n_parts"), F.max(F.size("embedding")).alias("dims")).where("n_parts > 1")
    groups = written(groups.withColumn("group", F.xxhash64(*key)))
    tile = tile or _side(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = groups.withColumn("parts", F.ceil(F.col("n_parts") / tile).cast("int"))
    # Groups are met by a hash of their key; the key itself is in the tile, so two groups of one hash stay apart.
    x = with_hot_keys(rows.withColumn("group", F.xxhash64(*key)), parts.select("group", "parts", "n_parts", *(F.col(k).alias(f"of_{k}") for k in key)), "group", "n_parts")
    x = x.where(" and ".join(f"{k} = of_{k}" for k in key)).withColumn("part", _part(F.col("id"), "parts"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    n = parts.agg(F.sum(F.expr("parts * (parts + 1L) div 2")).alias("tiles"), F.sum(F.expr("n_parts * (n_parts - 1D) / 2")).alias("pairs")).first()
    return _dealt(x.withColumn("tile", _tile_key(*key, "i", "j")), max(n["tiles"] or 0, int(n["pairs"] or 0) // TILE**2))


def _block_rows(vectors: DataFrame, block: str) -> DataFrame:
    return _usable(vectors.select("id", F.col(block).alias("block"), "embedding"), ["block"], "embedding")


def exact_pairs(vectors: DataFrame, least: float, block: str, tile: int | None = None) -> DataFrame:
    """(a, b, sim) of all pairs a < b of a block of vectors(id, embedding) with at least that similarity.

    A block is dealt into parts of about tile rows, and every two parts make a tile, so every pair is compared once and
    no task holds a block; a row goes to as many tiles as its block has parts. Without tile, parts grow with the tables up
    to a bound of bytes, and a row goes to few tiles until then. Rows without a vector or block have no pairs, nor have
    rows that repeat an id with each other.
    """
    rows = _block_rows(vectors, block)
    return _tiled(rows, ["block"], tile).select("tile", "i", "j", "part", "id", "embedding").mapInArrow(_pairs_of_tiles(least), "a long, b long, sim double")


def bands_for(least: float, recall: float, rows: int, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, bands): a code of so many bits spreads a block of so many rows to buckets of about bucket rows or more, and so
    many bands bring a pair right at the threshold together with at least that probability. Of those the one of least work,
    where a row is sent once a band and compared with half a bucket there; (0, 1), where comparing it with half its block
    is less work than any. A recall near 1 of a low threshold takes bands by the thousand, so there it is."""
    best, work = (0, 1), COMPARED + rows / 2
    for bits in range(1, min(24, math.ceil(math.log2(max(1, rows / bucket)))) + 1):
        agree = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
        if not agree:
            break
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else 1
        if bands * (COMPARED + rows / 2 ** (bits + 1)) < work:
            best, work = (bits, bands), bands * (COMPARED + rows / 2 ** (bits + 1))
    return best


def _coded(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // bands.bands)
        for b in (whole.slice(lo, step) for whole in batches for lo in range(0, whole.num_rows, step)):
            codes = bands.codes(_matrix(b["embedding"]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * bands.bands, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b["id"], b["block"], b["embedding"], lists], ["id", "block", "embedding", "codes"])

    return run


def pairs_by_bands(vectors: DataFrame, least: float, block: str, bands: Bands, tile: int = TILE) -> DataFrame:
    """(a, b, sim) of the pairs of exact_pairs that have the same code in one of the bands, each once."""
    rows = _block_rows(vectors, block)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = rows.mapInArrow(_coded(bands), f"id {kinds['id']}, block {kinds['block']}, embedding {kinds['embedding']}, codes array<int>")
    coded = coded.select("id", "block", "embedding", F.posexplode("codes").alias("band", "code"))
    x = _tiled(coded, ["block", "band", "code"], tile)
    return x.select("tile", "i", "j", "part", "band", "id", "embedding").mapInArrow(_pairs_of_tiles(least, bands), "a long, b long, sim double")


def banded_pairs(vectors: DataFrame, least: float, block: str, recall: float = RECALL, tile: int | None = None, bucket: int = BUCKET, seed: int = 1) -> DataFrame:
    """As exact_pairs, but where that is less work only of rows that random hyperplanes bring together: the signs of some of
    them are a code, and rows with the same code in one of several bands of a block are compared. What it finds is exact;
    of the pairs right at the threshold it finds a share of about recall or more, and more of those above it.

    Codes are sized by the largest block, so the rows that meet by chance do not grow with it. Buckets are dealt into
    tiles like blocks, so copies of one vector, which all meet, are spread over tasks too. bands_for weighs bands against
    all pairs of the largest block, so rows are never sent more often than comparisons spared are worth.
    """
    largest = _block_rows(vectors, block).groupBy("block").count().agg(F.max("count")).first()[0] or 0
    bits, bands = bands_for(least, recall, largest, bucket)
    if not bits:
        return exact_pairs(vectors, least, block, tile)
    return pairs_by_bands(vectors, least, block, Bands(bits, bands, seed), tile or TILE)


# ---- the best of another table
class Pivots:
    """Orthonormal directions, and what they say of a product: it is at most that of the shares along them, plus the
    lengths of the rests (Cauchy and Schwarz), so most pairs need not be compared in full."""

    def __init__(self, directions: np.ndarray):
        self.directions = directions

    @classmethod
    def fit(cls, sample: np.ndarray, share: float) -> Pivots:
        """The main directions of the sample, as few as carry so much of its squared length."""
        values, found = np.linalg.eigh(sample.T @ sample)
        order = np.argsort(-values)
        carried = np.cumsum(np.maximum(values[order], 0))
        n = int(np.searchsorted(carried, share * carried[-1])) + 1 if len(carried) and carried[-1] > 0 else 0
        return cls(found[:, order[:n]])

    def bounds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = left @ self.directions, right @ self.directions
        rest = [np.sqrt(np.maximum((x * x).sum(axis=1) - (y * y).sum(axis=1), 0)) for x, y in ((left, a), (right, b))]
        return a @ b.T + np.outer(*rest) + SLACK


def best_of_tile(left: np.ndarray, right: np.ndarray, ids: np.ndarray, least: float, pivots: Pivots, seeds: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """(similarity, id) of the best right row of each left row, the smallest id of equals, and the number of pairs that
    were compared in full. Similarity is -inf where nothing reaches least.

    The rows of the highest bounds are compared first; their best, or least, is what other bounds must reach.
    """
    bounds = pivots.bounds(left, right)
    many = min(seeds, len(right))
    first = np.argpartition(-bounds, many - 1, axis=1)[:, :many]
    rows = np.repeat(np.arange(len(left)), many)
    sims = dots(left[rows], right[first.ravel()]).reshape(len(left), many)
    bar = np.maximum(sims.max(axis=1), least)
    hopeful = bounds >= bar[:, None]
    np.put_along_axis(hopeful, first, False, axis=1)
    a, b = np.nonzero(hopeful)
    rows, cols, all_sims = np.concatenate([rows, a]), np.concatenate([first.ravel(), b]), np.concatenate([sims.ravel(), _products(left, a, right, b)])
    good = all_sims >= max(least, -math.inf)
    rows, cols, all_sims = rows[good], cols[good], all_sims[good]
    order = np.lexsort((ids[cols], -all_sims, rows))
    heads = order[np.unique(rows[order], return_index=True)[1]] if len(order) else order
    sim, best = np.full(len(left), -math.inf), np.zeros(len(left), np.int64)
    sim[rows[heads]], best[rows[heads]] = all_sims[heads], ids[cols[heads]]
    return sim, best, len(left) * many + len(a)


def _best_of_tiles(least: float, pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches):
            side, ids, vectors = t["side"].to_numpy(), t["id"].to_numpy(), _matrix(_column(t, "vector"))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            sim, best, compared = best_of_tile(vectors[left], vectors[right], ids[right], least, pivots)
            found = sim > -math.inf
            count = np.zeros(len(left), np.int64)
            count[0] = compared
            keep = found | (count > 0)
            arrays = [pa.array(ids[left][keep], pa.int64()), pa.array(best[keep], pa.int64(), mask=~found[keep]), pa.array(np.where(found, sim, 0.0)[keep], mask=~found[keep]), pa.array(count[keep])]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "other", "sim", "compared"])

    return run


def compared_tiles(left: DataFrame, right: DataFrame, block: str, least: float | None, tile: int = TILE, share: float = CARRIED) -> DataFrame:
    """(id, other, sim, compared): the best right row of each left row within each tile that the two meet in, and on one
    row of each tile the number of its pairs that were compared in full; other is null where none reaches least."""
    kind = "array<double>" if "double" in (left.schema["vector"].dataType.simpleString() + right.schema["vector"].dataType.simpleString()) else "array<float>"
    sides = [_usable(x.select("id", F.col(block).alias("block"), F.col("vector").cast(kind).alias("vector")), ["block"], "vector") for x in (left, right)]
    sample = sides[1].orderBy(F.xxhash64("id")).limit(PIVOT_ROWS).select("vector").toArrow()["vector"]
    pivots = Pivots.fit(_matrix(sample.combine_chunks()) if len(sample) else np.zeros((1, 1)), share)
    parts = written(_parts(sides[0], ["block"], tile, "left_parts").join(_parts(sides[1], ["block"], tile, "right_parts").hint("merge"), "block"))
    dealt = []
    for side, (own, others) in enumerate((("left_parts", "right_parts"), ("right_parts", "left_parts"))):
        x = with_hot_keys(sides[side], parts, "block", f"n_{own}").withColumn("part", _part(F.col("id"), own))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        i, j = ("part", "other") if side == 0 else ("other", "part")
        dealt.append(x.select(_tile_key("block", i, j), F.lit(side).alias("side"), "id", "vector"))
    both = _dealt(dealt[0].unionByName(dealt[1]), parts.agg(F.sum(F.expr("bigint(left_parts) * right_parts"))).first()[0] or 0)
    return both.mapInArrow(_best_of_tiles(-math.inf if least is None else least, pivots), "id long, other long, sim double, compared long")


def best_matches(left: DataFrame, right: DataFrame, block: str, least: float | None = None, tile: int = TILE) -> DataFrame:
    """(id, other, sim): of each row of left(id, vector) the most similar row of right in its block, the smallest id of
    equals; rows that nothing of at least that similarity matches are left out, as are those without a vector or block.

    Both sides are dealt into parts, and a tile is a part of each, so no task holds a block; it gives a row for each
    of its left rows, not for each pair. Pivots bound the similarity of a pair, and only those that may be best are
    compared in full; ids of left are unique.
    """
    found = compared_tiles(left, right, block, least, tile).where("other is not null")
    return found.groupBy("id").agg(F.max_by(F.struct("other", "sim"), F.struct("sim", -F.col("other"))).alias("s")).select("id", "s.other", "s.sim")
