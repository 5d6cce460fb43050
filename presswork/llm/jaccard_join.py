"""N-gram Jaccard join: globally ordered shingle sets in prefix trees, traversed with shared partial overlaps.

Two sets x, y of hashed shingles link when 100 |x & y| >= 80 |x | y|. Then they differ in at most (|x| + |y|) / 9 shingles.

Where sets meet. The range of hashes is cut into equal parts, more parts than a linked pair can have differences; a
difference spoils one part, so most parts are the same in both sets. The digest of a part is a signature. Of a set with
m filled parts and at most d differences, a partner shares m - d signatures at least, so it shares one of the d + 1 that
the fewest classes have: only those are kept (prefix filtering, in the order of frequency). A document that shares no
more than a passage with others has d + 1 signatures of its own, and drops out.

What is compared. Sets that are equal are one class. Every class is first compared with one centre, the least class
that it shares a signature with; that joins up families of copies with as many comparisons as members. Then only
signatures that hold classes of different components are left; the classes around them are compared with one another
where they are not yet connected, in blocks: those outside of the largest component around, with one another and with
the blocks of that component. All comparisons walk a prefix tree of the sets in the order of hashes.

Why signatures. One tree over all sets, whose branches tasks would walk, has a root with as many children as there are
least hashes, so near copies sit in unrelated branches as soon as one early shingle differs; only a tree in order of
frequency brings them together, and its probes then send every shingle of every set through the shuffle: 8 bytes times
some 480 shingles a document, 1 GB for the 0.5 GB that the check tool reads, and the rows of the commonest shingles in one
task. A set has 0.4 to 0.8 parts a shingle, and a signature that no two classes share is dropped where it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, field, join_groups, materialize, row_struct, shared_bits, text_or_empty, with_bits
from .quality import _IDS

WORDS = 5
PERCENT = 80
#: Parts for each shingle, at least; over 1/4 is needed, the most differences that a set can have.
PARTS = 0.4
#: Of classes that meet a centre, or a block of others, in one task: each counts 1, and 1 more for any 2,048 shingles.
BLOCK = 128
WEIGHT_SHINGLES = 2048
#: Weight that a task of the comparisons takes together, so that their number follows the work.
TASK = 4 * BLOCK
DOCS_PER_BUCKET = 2048
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; of all its words if they are fewer than five."""
    words = text.encode().lower().split()  # on bytes: only A-Z and [\x20\x09-\x0D]
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = h[:n].copy()
    for k in range(1, WORDS):
        out *= _A
        out += h[k : k + n]
    return np.unique(mix(out))


def class_key(s: np.ndarray) -> int:
    """The class of a set: a digest of its hashes, as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def level_of(n: int) -> int:
    level = 0
    while (1 << level) < PARTS * n:
        level += 1
    return level


def signatures(s: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(signatures, how) of a set: those of its parts at its own level, and at the next if a larger partner may be there.

    how is 64 times the least number of signatures that a partner shares, plus the level. Empty parts count only for a
    set with no more filled parts than differences, which then keeps them all: any other set shares a filled part with
    each partner, and two sets of the first kind meet on their empty parts too.
    """
    n = len(s)
    mixed, out = mix(s ^ _A), []
    for level in {level_of(n), level_of(n * 100 // PERCENT)}:
        part = s >> np.uint64(64 - level) if level else np.zeros(n, np.uint64)
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        salt = part[start] * _C + np.uint64(level + 1)
        found, least = mix(np.add.reduceat(mixed, start) ^ mix(salt)), len(start) - n // 4
        if least < 1:
            empty = np.setdiff1d(np.arange(1 << level, dtype=np.uint64), part)
            found, least = np.concatenate([found, mix(empty * _C + np.uint64(level + 1 + 64))]), 1
        out.append((found, 64 * least + level))
    return out


class PrefixTree:
    """Sorted sets in lexicographic order with the lengths of the prefixes that neighbours share: a prefix tree laid
    out flat, where the sets below a node are a stretch."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        self.sets = [sets[i] for i in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            self.shared.append(at if n and differ[at] else n)
        self.shared = np.array(self.shared)
        self.longest = max(map(len, sets), default=0)

    def linked(self, probe: np.ndarray, wanted: list[bool] | None = None) -> list[int]:
        """The sets (by their place in the list given) that link with probe.

        Goes through the tree in order. What a set shares with the one before it keeps its overlap; below a node whose
        prefix already misses more shingles of the probe than the longest set there may, all sets are skipped.
        """
        n, out = len(probe), []
        if not n:
            return out
        most = (5 * min(self.longest, n * 100 // PERCENT) - 4 * n) // 9
        overlap, reached, dead, before = np.zeros(1, np.int64), 0, None, -1
        fits = [len(s) * 100 >= PERCENT * n and n * 100 >= PERCENT * len(s) for s in self.sets]
        for i in np.flatnonzero(fits if wanted is None else np.array(fits) & np.array(wanted)[self.order]):
            common = int(self.shared[before + 1 : i + 1].min()) if before >= 0 else 0
            before = i
            if dead is not None and (reached := min(reached, common)) >= dead:
                continue
            s, at = self.sets[i], min(reached, common)
            size, step, dead = len(s), 64, None
            parts, last = [overlap[: at + 1]], int(overlap[at])
            while at < size:
                some = s[at : at + step]
                where = np.searchsorted(probe, some)
                hits = last + np.cumsum(probe[np.minimum(where, n - 1)] == some)
                missed = np.arange(at + 1, at + len(some) + 1) - hits > most
                parts.append(hits)
                last, at, step = int(hits[-1]), at + len(some), 4 * step
                if missed[-1]:
                    dead = at - len(some) + 1 + int(missed.argmax())
                    break
            overlap, reached = np.concatenate(parts), at
            if dead is None and 100 * last >= PERCENT * (n + size - last):
                out.append(self.order[i])
        return out


def _sets_and_signatures(buckets: int):
    names = ("bucket", "ids", "nulls", "sizes", "keys", "sigs", "of", "how")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            key = np.array([class_key(s) for s in sets], np.int64)
            size = np.array([len(s) for s in sets], np.int64)
            doc = np.array(b.column(0).to_pylist(), np.int64)
            null = np.array(b.column(1).to_pylist(), np.uint8)
            once = {int(k): i for i, k in enumerate(key) if size[i]}
            found = [(own, how, k) for k, i in once.items() for own, how in signatures(sets[i])]
            sigs = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
            sizes = [len(x[0]) for x in found]
            of = np.repeat(np.array([x[2] for x in found], np.int64), sizes)
            how = np.repeat(np.array([x[1] for x in found], np.int32), sizes)
            to = (sigs >> np.uint64(32)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            sigs, of, how, to = sigs[order].astype(np.uint32), of[order], how[order], to[order]
            ends = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            own = key.view(np.uint64) % np.uint64(buckets)
            for at in np.union1d(np.unique(to), np.unique(own)).astype(int):
                me, piece = own == at, slice(ends[at], ends[at + 1])
                row = (int(at), doc[me].tobytes(), null[me].tobytes(), size[me].tobytes(), key[me].tobytes(), sigs[piece].tobytes(), of[piece].tobytes(), how[piece].tobytes())
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row, strict=True)}, schema=pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names[1:])]))

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the buckets in this task: documents as rows (id, size, key, null), and the signatures that two or more classes
    have as rows (signature, number of classes, key, how), one a class."""
    held: dict[int, list] = {}
    schema = pa.schema([("is_doc", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("is_null", pa.bool_()), ("how", pa.int32())])
    for b in batches:
        for r in b.to_pylist():
            n = len(r["ids"]) // 8
            if n:
                null = np.frombuffer(r["nulls"], np.uint8).astype(bool)
                columns = (np.ones(n, bool), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["keys"], np.int64), null)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.int32())], schema=schema)
            held.setdefault(r["bucket"], []).append((r["sigs"], r["of"], r["how"]))
    for bucket, parts in held.items():
        sig, key, how = (np.frombuffer(b"".join(p[i] for p in parts), kind) for i, kind in enumerate((np.uint32, np.int64, np.int32)))
        parts.clear()
        if len(sig) < 2:
            continue
        order = np.argsort(sig, kind="stable")
        twin = sig[order][1:] == sig[order][:-1]
        order = order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]
        order = order[np.lexsort((key[order], sig[order]))]
        sig, key, how = sig[order], key[order], how[order]
        if not len(sig):
            continue
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
        sig, key, how = sig[new], key[new], how[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        classes = np.repeat(size := np.diff(np.append(start, len(sig))), size)
        some = classes > 1
        n = int(some.sum())
        columns = (np.zeros(n, bool), (bucket << 32) + sig[some].astype(np.int64), classes[some], key[some])
        whole = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.bool_()), pa.array(how[some])], schema=schema)
        for at in range(0, n, 100_000):
            yield whole.slice(at, 100_000)


def _with_centre(t: pa.Table) -> pa.Table:
    """Links of the classes of one block with its centre."""
    centre, sets, keys = t["centre"][0].as_py(), {}, []
    for k, text in zip(t["k"].to_pylist(), t["text"].to_pylist(), strict=True):
        if k not in sets:
            s = shingle_set(text)
            if class_key(s) == k:
                sets[k] = s
    keys = [k for k in sets if k != centre]
    found = PrefixTree([sets[k] for k in keys]).linked(sets[centre]) if centre in sets else []
    return pa.table({"src": pa.array([keys[i] for i in found], pa.int64()), "dst": pa.array([centre] * len(found), pa.int64())})


def _one_another(t: pa.Table) -> pa.Table:
    """Links that connect classes of one block, or of two; pairs that share no signature or are connected are left out."""
    sets: dict[int, np.ndarray] = {}
    side, groups, root = {}, {}, {}
    for r in t.to_pylist():
        if r["k"] in sets:
            continue
        s = shingle_set(r["text"])
        if class_key(s) == r["k"]:
            sets[r["k"]], side[r["k"]], groups[r["k"]] = s, r["side"], r["groups"]
            root[r["k"]] = ("c", r["component"])

    def top(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    keys = sorted(sets)
    place = {k: i for i, k in enumerate(keys)}
    tree = PrefixTree([sets[k] for k in keys])
    holds: dict[int, list[int]] = {}
    for k in keys:
        for g in groups[k]:
            holds.setdefault(g, []).append(k)
    two = len(set(side.values())) > 1
    links = []
    for x in keys:
        wanted = [False] * len(keys)
        for y in {y for g in groups[x] for y in holds[g] if y > x}:
            wanted[place[y]] = (not two or side[x] != side[y]) and top(x) != top(y)
        if not any(wanted):
            continue
        for i in tree.linked(sets[x], wanted):
            a, b = top(x), top(keys[i])
            if a != b:
                root[a] = b
                links.append((x, keys[i]))
    return pa.table({"src": pa.array([a for a, _ in links], pa.int64()), "dst": pa.array([b for _, b in links], pa.int64())})


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The texts of the documents that need names by (id, is_null), with need's other columns.

    A bitmap of fixed size drops most other documents before the join, so their texts do not shuffle.
    """
    need = materialize(need, "need")
    likely = with_bits(docs, "id", shared_bits(need, "id"))
    return likely.join(need.hint("merge"), ["id", "is_null"])


def _identity() -> list[Column]:
    """id, is_null, text: a row without doc_id goes by the hash of its text."""
    text = text_or_empty()
    doc = F.col("doc_id").cast("long")
    return [F.coalesce(doc, F.xxhash64(text)).alias("id"), doc.isNull().alias("is_null"), text.alias("text")]


def _class_of(text: pa.Array) -> pa.Array:
    """The class of each text; null for a text without shingles."""
    sets = map(shingle_set, text.to_pylist())
    return pa.array([class_key(s) if len(s) else None for s in sets], pa.int64())


def _classed(docs: DataFrame, docs_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: the rows of docs as (id, is_null, n, k), and the classes of those with shingles as (k, rep,
    null_rep, size, component); component is the least class that a class reaches by links."""
    own = docs.select(*_identity())
    buckets = max(1, -(-docs.count() // docs_per_bucket))
    blobs = own.mapInArrow(_sets_and_signatures(buckets), "bucket int, ids binary, nulls binary, sizes binary, keys binary, sigs binary, of binary, how binary")
    met = blobs.repartition(buckets, "bucket").mapInArrow(_meet, "is_doc boolean, id long, n long, k long, is_null boolean, how int")
    met = materialize(met, "met")
    all_docs = met.where("is_doc").select("id", "is_null", "n", "k")
    live = _shared(met.where("not is_doc").select(F.col("id").alias("group"), F.col("n").alias("classes"), "k", "how"))
    classes = all_docs.where("n > 0").groupBy("k").agg(F.min(F.when(~F.col("is_null"), F.col("id"))).alias("rep"), F.max(F.when(F.col("is_null"), F.col("id"))).alias("null_rep"), F.count("*").alias("size"), F.max("n").alias("n"))
    classes = materialize(classes, "classes")
    named = classes.select("k", F.coalesce("rep", "null_rep").alias("id"), F.col("rep").isNull().alias("is_null"))
    weight = classes.select("k", (1 + F.floor(F.col("n") / WEIGHT_SHINGLES)).alias("weight"))

    edges = materialize(live.groupBy("k").agg(F.min("centre").alias("centre")).where("k <> centre"), "edges")
    links = None
    if edges.count():
        heavy = materialize(edges.hint("merge").join(weight.hint("merge"), "k"), "edges")
        crowd = materialize(heavy.groupBy("centre").agg(F.count("*").alias("members"), F.sum("weight").alias("weight")), "crowd")
        blocks = F.ceil(F.col("weight") / BLOCK).cast("long")
        placed = join_groups(edges, crowd, "centre", "members").select("centre", F.pmod(F.xxhash64("k"), blocks).alias("block"), "k")
        centres = crowd.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.col("centre").alias("k"))
        need = materialize(placed.unionByName(centres), "placed").hint("merge").join(named, "k")
        tasks = -(-crowd.agg(F.sum("weight")).first()[0] // TASK)
        links = _texts(own, need).repartition(tasks, "centre", "block").groupBy("centre", "block").applyInArrow(_with_centre, "src long, dst long")
        links = materialize(links, "links")
        so_far = materialize(connected_components(links, "first"), "first")
        more = _rest(own, named, weight, live, so_far)
        if more is not None:
            links = links.unionByName(more)
            so_far = materialize(connected_components(links, "second"), "second")
        classes = classes.hint("merge").join(so_far.withColumnRenamed("node", "k").hint("merge"), "k", "left")
    else:
        classes = classes.withColumn("component", F.col("k"))
    return all_docs, materialize(classes.withColumn("component", F.coalesce("component", "k")), "classed")


def jaccard_components(docs: DataFrame, docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_size (rows with the same set).

    Links are exact but for collisions of 64-bit hashes. component_id is the smallest doc_id that the row reaches by
    links. Null and empty texts have no shingles and are linked with nothing; their component_id is their doc_id. A row
    with a null doc_id links as any other and has a null component_id only where no doc_id is reached. Rows that repeat
    a doc_id are rows of their own. An empty table gives an empty one. Other columns are not read.
    """
    all_docs, classes = _classed(docs, docs_per_bucket)
    least = materialize(classes.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("members")), "least")
    final = join_groups(classes, least, "component", "members").select("k", "component_id", F.col("size").alias("class_size"))
    final = materialize(final, "final")
    doc = F.when(~F.col("is_null"), F.col("id")).alias("doc_id")
    linked = join_groups(all_docs.where("n > 0"), final, "k", "class_size")
    linked = linked.select(doc, F.col("n").alias("n_shingles"), "component_id", "class_size")
    alone = all_docs.where("n = 0").select(doc, F.col("n").alias("n_shingles"), doc.alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return linked.unionByName(alone)


def _shared(live: DataFrame) -> DataFrame:
    """(group, k, centre): the signatures that each class keeps and another class keeps too, and their least class.

    Of the signatures of a class and level those that most classes have are left out, one fewer than a partner must
    share; a class whose own signatures leave too few to share keeps none.
    """
    one = Window.partitionBy("k", "how")
    ranked = live.withColumns({"shared": F.count("*").over(one), "nth": F.row_number().over(one.orderBy("classes", "group"))})
    kept = ranked.where(F.col("nth") <= F.col("shared") - F.floor(F.col("how") / 64) + 1)
    kept = materialize(kept.select("group", "k"), "kept")
    groups = kept.groupBy("group").agg(F.min("k").alias("centre"), F.count("*").alias("classes")).where("classes > 1")
    return materialize(join_groups(kept, materialize(groups, "groups"), "group", "classes").select("group", "k", "centre"), "shared")


def _rest(own: DataFrame, named: DataFrame, weight: DataFrame, live: DataFrame, so_far: DataFrame) -> DataFrame | None:
    """Links between classes that share a signature and are in different components; None if there are no such classes.

    Around shared signatures most classes are in one component by now. Its members need not meet one another: blocks of
    the other classes meet each other, and each block of the largest component.
    """
    known = so_far.select(F.col("node").alias("k"), "component")
    placed = live.hint("merge").join(known.hint("merge"), "k", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "k")), "shared")
    mixed = placed.groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("rows"))
    mixed = materialize(mixed.where("a <> b").select("group", "rows"), "mixed")
    if not mixed.count():
        return None
    left = materialize(join_groups(placed, mixed, "group", "rows").select("group", "k", "centre", "component"), "left")
    around = materialize(connected_components(left.select(F.col("k").alias("src"), F.col("centre").alias("dst")), "around"), "around")
    members = left.groupBy("k").agg(F.min("component").alias("component"), F.collect_set("group").alias("groups"))
    members = members.hint("merge").join(around.select(F.col("node").alias("k"), F.col("component").alias("cluster")).hint("merge"), "k")
    members = materialize(members.join(weight.hint("merge"), "k"), "clustered")
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    largest = F.max_by(F.struct("component", "weight"), F.struct("n", "component")).alias("largest")
    sizes = sizes.groupBy("cluster").agg(largest, F.sum("n").alias("members"), F.sum("weight").alias("weight"))
    sizes = sizes.select("cluster", "members", F.col("largest.component").alias("main"), F.ceil(F.col("largest.weight") / BLOCK).cast("long").alias("inner"), F.ceil((F.col("weight") - F.col("largest.weight")) / BLOCK).cast("long").alias("outer"))
    sizes = materialize(sizes, "clusters")
    # Blocks 0 .. outer - 1 hold the others, the next ones the largest component.
    outside = F.col("component") != F.col("main")
    side = F.when(outside, F.pmod(F.xxhash64("k"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("k"), F.col("inner")))
    last = F.when(outside, F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1)
    spread = join_groups(members, sizes, "cluster", "members").where("outer > 0").withColumn("side", side)
    spread = spread.select("cluster", "component", "groups", "side", "k", "weight", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    spread = spread.select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "k", "component", "groups", "weight")
    spread = materialize(spread, "spread")
    tasks = -(-(spread.agg(F.sum("weight")).first()[0] or 1) // TASK)
    need = spread.drop("weight").hint("merge").join(named, "k")
    return materialize(_texts(own, need).repartition(tasks, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInArrow(_one_another, "src long, dst long"), "more-links")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns of docs: the one of the smallest doc_id; a null doc_id comes last.

    Rows are told apart by doc_id (or the hash of the text where it is null) and class, so rows that only share a doc_id,
    or only lack one, stay or go each by its own text. Of rows with the same doc_id and class the least text stays. Null
    and empty texts are linked with nothing and stay.
    """
    all_docs, classes = _classed(docs, DOCS_PER_BUCKET)
    first = F.min(F.struct(F.col("rep").isNull().alias("is_null"), F.coalesce("rep", "null_rep").alias("id"), "k")).alias("first")
    keepers = materialize(classes.groupBy("component").agg(first).select("first.*"), "keepers")
    zero, one = F.lit(0).alias("rows"), F.lit(1).alias("keeps")
    rows = all_docs.select("id", "is_null", F.lit(1).alias("rows"), F.when(F.col("n") == 0, 1).otherwise(0).alias("keeps"))
    fates = rows.unionByName(keepers.select("id", "is_null", zero, one)).groupBy("id", "is_null").agg(F.sum("rows").alias("rows"), F.sum("keeps").alias("keeps"))
    fates = materialize(fates.where("keeps < rows").select("id", "is_null", (F.col("keeps") > 0).alias("some")), "fates")
    doc, is_null, _ = _identity()
    stay = docs.join(fates.hint("merge"), (doc == fates["id"]) & (is_null == fates["is_null"]), "left_anti")
    some = fates.where("some").select("id", "is_null")
    if not some.count():
        return stay
    own = _texts(docs.select(*_identity(), row_struct(docs).alias("row")), some)
    own = materialize(own.withColumn("k", F.arrow_udf(_class_of, "long")("text")), "some")
    least = own.where("k is not null").groupBy("id", "is_null", "k").agg(F.min_by("row", "text").alias("row"))
    left = own.where("k is null").select("row").unionByName(least.join(keepers.hint("merge"), ["id", "is_null", "k"]).select("row"))
    return stay.unionByName(left.select(*(field("row", c) for c in docs.columns)))
