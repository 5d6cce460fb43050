"""Joins of vectors and stories across runs, against brute force."""

import collections
import statistics
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from presswork.operators import story_state
from presswork.operators import vectors as V
from presswork.plans.bridge import Model

SF = "/root/testdata/sf0.1"


def unit(rng, n, dims=16, near=()):
    v = rng.standard_normal((n, dims))
    for a, b, noise in near:
        v[b] = v[a] / np.linalg.norm(v[a]) + noise * rng.standard_normal(dims) / dims**0.5
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, ids, blocks, vectors, name="embedding", block="topic"):
    rows = [(int(i), b, None if v is None else [float(x) for x in v]) for i, b, v in zip(ids, blocks, vectors, strict=True)]
    return spark.createDataFrame(rows, f"id long, {block} string, {name} array<double>").repartition(4)


def brute_pairs(ids, blocks, vectors, least):
    out = {}
    for x in range(len(ids)):
        for y in range(x):
            if blocks[x] is not None and blocks[x] == blocks[y] and vectors[x] is not None and vectors[y] is not None and ids[x] != ids[y]:
                sim = float(np.dot(vectors[x], vectors[y]))
                if sim >= least:
                    out[min(ids[x], ids[y]), max(ids[x], ids[y])] = round(sim, 9)
    return out


def pair_rows(seed=3, n=260):
    """A hot block, small blocks, blocks of one row, exact and near copies, and rows without block or vector."""
    rng = np.random.default_rng(seed)
    near = [(i, i + 1, rng.choice([0.0, 0.3, 0.8])) for i in range(0, n - 1, 5)]
    vectors = list(unit(rng, n, near=near))
    blocks = ["hot" if i < 180 else f"b{i // 7}" if i < n - 3 else f"one{i}" for i in range(n)]
    blocks[20], vectors[30], blocks[200] = None, None, "b\0x"
    return list(range(1000, 1000 + n)), blocks, vectors


@pytest.mark.parametrize("tile", [1, 16, 1024])
def test_exact_pairs(spark, tile):
    ids, blocks, vectors = pair_rows()
    got = V.exact_pairs(frame(spark, ids, blocks, vectors), 0.5, "topic", tile).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got} == brute_pairs(ids, blocks, vectors, 0.5)


@pytest.mark.parametrize("bucket, tile", [(4, 1024), (4, 8), (1 << 20, 64)])
def test_banded_pairs_are_exact_pairs_once(spark, bucket, tile):
    ids, blocks, vectors = pair_rows(4)
    got = V.banded_pairs(frame(spark, ids, blocks, vectors), 0.7, "topic", 1 - 1e-9, tile, bucket).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got} == brute_pairs(ids, blocks, vectors, 0.7)


def test_pairs_of_nothing(spark):
    none = frame(spark, [1], ["a"], [[1.0, 0.0]])
    for rows in (none, none.where("false")):
        assert V.exact_pairs(rows, 0.5, "topic").count() == V.banded_pairs(rows, 0.5, "topic").count() == 0


@pytest.mark.parametrize("bucket", [8, V.BUCKET])
def test_recall_of_bands(spark, bucket):
    """At least 0.9 of all pairs of the tables, which are random vectors, so most pairs lie right at the threshold."""
    v = Model(spark, SF)["vectors"]
    exact = {(r["a"], r["b"]) for r in V.exact_pairs(v, 0.35, "topic").collect()}
    found = {(r["a"], r["b"]) for r in V.banded_pairs(v, 0.35, "topic", bucket=bucket).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 300


@pytest.mark.parametrize("tile", [8, 1024])
@pytest.mark.parametrize("bits, bands", [(1, 15), (3, 40), (6, 110)])
def test_pairs_by_bands_are_exact_pairs_once(spark, bits, bands, tile):
    """So many bands that a pair of 0.7 is missed less than once in a thousand million times."""
    ids, blocks, vectors = pair_rows(4)
    got = V.pairs_by_bands(frame(spark, ids, blocks, vectors), 0.7, "topic", V.Bands(bits, bands, 1), tile).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got} == brute_pairs(ids, blocks, vectors, 0.7)


@pytest.mark.parametrize("bits, bands", [(3, 11), (7, 89)])
def test_recall_of_pairs_by_bands(spark, bits, bands):
    """So many bands that a pair of 0.35 is found with a probability of 0.95."""
    v = Model(spark, SF)["vectors"]
    exact = {(r["a"], r["b"]) for r in V.exact_pairs(v, 0.35, "topic").collect()}
    found = {(r["a"], r["b"]) for r in V.pairs_by_bands(v, 0.35, "topic", V.Bands(bits, bands, 1)).collect()}
    assert found < exact and len(found) >= 0.9 * len(exact) > 300


@pytest.mark.parametrize("rows", [2, 200, 5_000, 60_000, 1_000_000])
def test_bands_are_fewer_than_the_comparisons_that_they_spare(rows):
    for recall, bucket in ((1 - 1e-9, 8), (0.95, 8), (0.95, 512)):
        for least in (0.35, 0.65, 0.9):
            bits, bands = V.bands_for(least, recall, rows, bucket)
            assert bands <= 1 + rows / 2048 and 0 <= bits <= 24
    assert V.bands_for(0.65, 0.95, 600_000)[0] > 0


def test_banded_query_sends_rows_a_few_times(spark, monkeypatch):
    """Over 2,000 vectors, and over four times as many in the same blocks."""
    sent, dealt = [], V._dealt
    monkeypatch.setattr(V, "_dealt", lambda rows, tiles: sent.append(rows.count()) or dealt(rows, tiles))
    v = Model(spark, SF)["vectors"]
    for k in (1, 4):
        more = v.crossJoin(spark.range(k).withColumnRenamed("id", "k")).select((F.col("id") * 4 + F.col("k")).alias("id"), "topic", "embedding")
        V.banded_pairs(more, 0.35, "topic", recall=1 - 1e-9, bucket=8)
        assert sent.pop() <= 3 * 2000 * k


@pytest.mark.parametrize("side", [1, 60])
def test_sides_of_tiles_fit_the_tasks(spark, monkeypatch, side):
    """Without a tile, sides grow with the pairs within bounds of bytes, here of 16 doubles each."""
    monkeypatch.setattr(V, "SIDE_BYTES", (side * 128, 1 << 24))
    ids, blocks, vectors = pair_rows()
    groups = spark.createDataFrame([(180, 16), (80, 16)], "n_parts long, dims int")
    assert V._side(groups, 4) == max(side, 49)  # 19,270 pairs in eight tiles
    assert V._side(groups.where("false"), 4) == side * 16
    got = V.exact_pairs(frame(spark, ids, blocks, vectors), 0.5, "topic").collect()
    assert {(r["a"], r["b"]): round(r["sim"], 9) for r in got} == brute_pairs(ids, blocks, vectors, 0.5)
    assert len(got) == len({(r["a"], r["b"]) for r in got})


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_similar_rows_by_strips(monkeypatch, cells):
    monkeypatch.setattr(V, "CELLS", cells)
    left, right = unit(np.random.default_rng(5), 40), unit(np.random.default_rng(6), 30)
    for same, other in ((False, right), (True, left)):
        got = [(int(x), int(y)) for a, b in V._similar(left, other, 0.1, same) for x, y in zip(a, b, strict=True)]
        want = [(x, y) for x in range(40) for y in range(len(other)) if left[x] @ other[y] >= 0.1 and (not same or x < y)]
        assert sorted(got) == want and want


def peak_of(run):
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak / 1e6


def test_workers_hold_few_codes():
    """A batch of 10,000 rows and 1,000 bands of 11 bits, of which a block of 10,000 rows took 4,437."""
    rows = pa.array(unit(np.random.default_rng(1), 10_000).astype(np.float32).tolist(), pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(["t"] * 10_000), rows], ["id", "block", "embedding"])
    n, peak = peak_of(lambda: sum(b.num_rows for b in V._coded(V.Bands(11, 1000, 1))(iter([batch]))))
    assert n == 10_000 and peak < 150


@pytest.mark.parametrize("bands", [None, V.Bands(3, 40, 1)])
def test_workers_hold_few_rows_of_copies(bands):
    """A tile of 1,500 near copies, so 1.1 million pairs, of which a worker gathers the rows of some at a time."""
    n = 1500
    rng = np.random.default_rng(2)
    rows = rng.standard_normal(64) + 0.05 * rng.standard_normal((n, 64))
    rows = pa.array((rows / np.linalg.norm(rows, axis=1, keepdims=True)).tolist(), pa.list_(pa.float64()))
    names = ["tile", "i", "j", "part", "band", "id", "embedding"]
    zero = pa.array([0] * n, pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * n), zero, zero, zero, zero, pa.array(range(n)), rows], names)
    found, peak = peak_of(lambda: sum(b.num_rows for b in V._pairs_of_tiles(0.35, bands)(iter([batch]))))
    assert found == n * (n - 1) // 2 and peak < 250


def test_tiles_are_even(spark):
    """One block holds nearly all rows: no tile, and no task, has more than twice the pairs of the median one."""
    rows = spark.range(8000).select("id", F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot").alias("block"), F.array(F.rand(1)).alias("embedding"))
    tiles = V._tiled(rows, ["block"], 256).groupBy("tile", "i", "j", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    pairs = [r["n"] ** 2 / 4 if r["i"] != r["j"] else r["n"] ** 2 / 2 for r in tiles]
    assert max(pairs) <= 2 * statistics.median(pairs)
    tasks = collections.Counter()
    for r, p in zip(tiles, pairs, strict=True):
        tasks[r["task"]] += p
    assert len(tasks) > 1 and max(tasks.values()) <= 2 * statistics.median(tasks.values())


def brute_best(left, right, least):
    out = {}
    for i, b, v in left:
        found = [(-float(sum(x * y for x, y in zip(v, w, strict=True))), j) for j, c, w in right if c == b and c is not None and w is not None] if v is not None else []
        if found and -min(found)[0] >= least:
            out[i] = (min(found)[1], round(-min(found)[0], 9))
    return out


@pytest.mark.parametrize("tile", [8, 1024])
@pytest.mark.parametrize("least", [None, 0.4])
def test_best_matches(spark, tile, least):
    """Centroids that are not of unit length, and copies among the right rows, whose smallest id wins over all tiles."""
    rng = np.random.default_rng(9)
    right = unit(rng, 150)
    right[100:140] = right[60:100]
    ids, blocks = list(range(5, 155)), ["hot" if i % 4 else f"s{i % 5}" for i in range(150)]
    left = unit(rng, 90) * rng.uniform(0.2, 1, (90, 1))
    left[:30] = right[60:90] * 0.9
    lefts, lblocks = list(range(90)), ["hot" if i % 3 else f"s{i % 7}" for i in range(90)]
    lv, rv = list(left), list(right)
    lv[7], rv[9], lblocks[8], blocks[11] = None, None, None, None
    got = V.best_matches(frame(spark, lefts, lblocks, lv, "vector"), frame(spark, ids, blocks, rv, "vector"), "topic", least, tile)
    got = {r["id"]: (r["other"], round(r["sim"], 9)) for r in got.collect()}
    assert got == brute_best(list(zip(lefts, lblocks, lv, strict=True)), list(zip(ids, blocks, rv, strict=True)), -9 if least is None else least)


def test_best_matches_of_nothing(spark):
    some = frame(spark, [1, 2], ["a", "b"], [[1.0, 0.0], [0.0, 1.0]], "vector")
    assert V.best_matches(some, some.where("false"), "topic").count() == V.best_matches(some.where("false"), some, "topic").count() == 0
    assert [tuple(r) for r in V.best_matches(some, some, "topic").orderBy("id").collect()] == [(1, 1, 1.0), (2, 2, 1.0)]


@pytest.mark.parametrize("least", [None, 0.5])
def test_pivots_spare_two_thirds_of_all_comparisons(spark, least):
    v = Model(spark, SF)["vectors"].select("id", "topic", F.col("embedding").alias("vector"))
    a, b = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    pairs = a.groupBy("topic").count().join(b.groupBy("topic").agg(F.count("*").alias("n")), "topic").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert 0 < V.compared_tiles(a, b, "topic", least).agg(F.sum("compared")).first()[0] < pairs / 3


# ---- stories across runs
def replay(batches, attach):
    """{id: (story, is_new)} and {story: (sum, n)} by brute force."""
    state, out = {}, {}
    for rows in batches:
        before = {k: (topic, total / n) for k, (topic, total, n) in state.items()}
        members, free = [], []
        for i, topic, v in rows:
            sims = [(-sum(x * y for x, y in zip(v, c, strict=True)), k) for k, (t, c) in before.items() if t == topic and topic is not None] if v is not None else []
            if sims and -min(sims)[0] >= attach:
                out[i] = (min(sims)[1], False)
                members.append((out[i][0], topic, v))
            else:
                free.append((i, topic, v))
        root = {i: i for i, *_ in free}

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i, t, v in free:
            for j, u, w in free:
                if i < j and t is not None and t == u and v is not None and w is not None and np.dot(v, w) >= attach:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        for i, topic, v in free:
            out[i] = (find(i), True)
            members.append((find(i), topic, v))
        for story, topic, v in members:
            if v is not None and topic is not None:
                _, total, n = state.get(story, (topic, 0.0, 0))
                state[story] = (topic, total + np.asarray(v), n + 1)
    return out, state


def test_stories_across_three_batches(spark):
    rng = np.random.default_rng(12)
    centres, rows = unit(rng, 12), []
    for i in range(150):
        v = centres[rng.integers(12)] + 0.35 * rng.standard_normal(16) / 4
        rows.append((i, None if i == 77 else f"t{i % 2}", None if i in (5, 90, 91) else v / np.linalg.norm(v)))
    batches = [rows[:60], rows[60:70], rows[70:]]
    want, sums = replay(batches, 0.65)
    state, got = story_state.no_stories(spark), {}
    for batch in batches:
        assigned, state = story_state.advance(state, frame(spark, *zip(*batch, strict=True)), 0.65)
        found = assigned.collect()
        assert len(found) == len(batch)
        got |= {r["id"]: (r["story"], r["is_new"]) for r in found}
    assert got == want
    kept = {r["story"]: r for r in state.collect()}
    assert kept.keys() == sums.keys() and any(not new for _, new in want.values()) and any(k >= 60 for k in sums)
    for story, (topic, total, n) in sums.items():
        assert (kept[story]["topic"], kept[story]["n"]) == (topic, n) and np.allclose(kept[story]["total"], total)
