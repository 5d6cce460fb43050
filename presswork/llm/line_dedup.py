"""Line dedup: sharded minimal perfect hashes over repeated line hashes, probed by batches of documents.

Only hashes travel: each batch of documents, as it is read, sends its distinct line hashes once, and learns from the shards'
arrays which of them to drop. Texts shuffle only where a document loses a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_bits, materialize, shared_bits, text_or_empty

LEAST_CHARS = 10
#: A row with a null doc_id stands for one document that comes after all others.
LAST = (1 << 63) - 1
LEVELS = 64
#: Line hashes at most, of those that the most batches hold, in the shard that goes to all tasks: some 30 MB.
HEAVY = 1 << 20


def line_key(line: bytes) -> bytes | None:
    """The key of a line, or None if it has fewer than LEAST_CHARS code points."""
    key = line.strip().lower()  # on bytes: only [\x20\x09-\x0D] and only A-Z
    if len(key) < LEAST_CHARS or len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS:
        return None
    return key


def line_hash(key: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(key)
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    x = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash: a cascade of bit arrays, where a key sits at the first level that it has a bit of its
    own on; its index is the rank of that bit. About 3.5 bits a key, next to the caller's arrays."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """a, b: the two halves of distinct 128-bit hashes, as uint64."""
        sizes, parts = [], []
        while len(a) and len(sizes) < LEVELS:
            size = max(8, 2 * len(a))
            slot = (_mix(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
            once = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            parts.append(once)
            left = ~once[slot]
            a, b = a[left], b[left]
        if len(a):
            raise ValueError("keys must be distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; for keys that were not built in, any index or -1."""
        out, todo, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            slot = base + (_mix(a[todo], b[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[slot]
            out[todo[hit]] = self.rank[slot[hit]]
            todo, base = todo[~hit], base + size
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, sizes: list[int], data: bytes) -> PerfectHash:
        sizes = [int(x) for x in sizes]
        return cls(sizes, np.unpackbits(np.frombuffer(data, np.uint8), count=sum(sizes)).astype(bool))


def _unsigned(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)


LINES = pa.schema([*((k, pa.int64()) for k in ("h", "g", "n", "first", "last")), ("rows", pa.binary()), ("docs", pa.binary())])


def _batch_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of documents: every distinct line hash with its number of documents, smallest and largest doc_id, and
    the row keys and doc_ids that hold it."""
    for b in batches:
        found: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        docs = [LAST if d is None else d for d in b.column("doc_id").to_pylist()]
        for row, doc, text in zip(b.column("row").to_pylist(), docs, b.column("text").to_pylist(), strict=True):
            for h in {line_hash(k) for x in set(text.encode().split(b"\n")) if (k := line_key(x)) is not None}:
                rows, of = found.setdefault(h, ([], []))
                rows.append(row)
                of.append(doc)
        keys, values = list(found), list(found.values())
        columns = [[k[0] for k in keys], [k[1] for k in keys], [len(v[0]) for v in values], [min(v[1]) for v in values], [max(v[1]) for v in values]]
        binary = [[np.array(v[i], np.int64).tobytes() for v in values] for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns + binary, LINES.types, strict=True)], schema=LINES)


def _build_shard(t: pa.Table) -> pa.Table:
    """One shard of the index: a perfect hash, and arrays of fingerprints, counts and first documents by its index."""
    a, b = _unsigned(t["h"]), _unsigned(t["g"])
    mph = PerfectHash.build(a, b)
    order = np.argsort(mph.index(a, b))
    sizes, bits = mph.dump()
    count = np.minimum(t["n"].to_numpy(), 2**32 - 1).astype(np.uint32)
    row = {"shard": [t["shard"][0].as_py()], "sizes": [sizes], "bits": [bits], "fingerprints": [b[order].tobytes()], "counts": [count[order].tobytes()], "firsts": [t["first"].to_numpy()[order].tobytes()]}
    return pa.table(row, schema=pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())]))


class ShardArrays:
    """A shard as documents probe it: the perfect hash and the arrays that it indexes."""

    def __init__(self, row: dict):
        self.mph = PerfectHash.load(row["sizes"], row["bits"])
        self.fingerprints = np.frombuffer(row["fingerprints"], np.uint64)
        self.counts, self.firsts = np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["firsts"], np.int64)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each hash is in two documents or more, its first document)."""
        where = self.mph.index(a, b)
        at = np.maximum(where, 0)
        if not len(self.fingerprints):
            return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
        hit = (where >= 0) & (self.fingerprints[at] == b) & (self.counts[at] > 1)
        return hit, self.firsts[at]


DROPS = pa.schema([(k, pa.int64()) for k in ("row", "h", "g")])


def _drops(lines: pa.Table | pa.RecordBatch, arrays: ShardArrays) -> pa.Table:
    """(row, h, g) of each line that is to go, of the rows whose doc_id is not the first with it."""
    hit, first = arrays.probe(_unsigned(lines["h"]), _unsigned(lines["g"]))
    at = np.flatnonzero(hit)
    rows, docs = ([np.frombuffer(x, np.int64) for x in lines[k].take(pa.array(at)).to_pylist()] for k in ("rows", "docs"))
    times = [len(x) for x in rows]
    if not at.size:
        return DROPS.empty_table()
    row, doc = np.concatenate(rows), np.concatenate(docs)
    gone = doc != np.repeat(first[at], times)
    h, g = (np.repeat(_unsigned(lines[k]).view(np.int64)[at], times) for k in ("h", "g"))
    return pa.table([row[gone], h[gone], g[gone]], schema=DROPS)


def _probe_shard(lines: pa.Table, index: pa.Table) -> pa.Table:
    if not len(index) or not len(lines):
        return DROPS.empty_table()
    return _drops(lines, ShardArrays({k: index[k][0].as_py() for k in ("sizes", "bits", "fingerprints", "counts", "firsts")}))


def _finish(with_text: bool):
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256") + ("text",) * with_text
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string()) + (pa.string(),) * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text, drops in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("drops").to_pylist(), strict=True):
                whole = text.encode()
                lines = kept = whole.split(b"\n")
                if drops:
                    gone = {(x["h"], x["g"]) for x in drops}
                    kept = [x for x in lines if (k := line_key(x)) is None or line_hash(k) not in gone]
                    whole = b"\n".join(kept)
                found = (doc, len(lines), len(lines) - len(kept), hashlib.sha256(whole).hexdigest()) + ((whole.decode(),) if with_text else ())
                for to, value in zip(rows, found, strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names)

    return run


def line_dedup(docs: DataFrame, with_text: bool = True, probes_per_shard: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, kept_sha256, and the text of the lines that stay.

    1. Each batch of documents gives its distinct line hashes once, so a line that is everywhere costs one row a
       batch. 2. Hashes found in at least two documents go to shards by hash; each shard is a minimal perfect hash over
       arrays of fingerprints, counts and first documents. Hashes that very many rows hold make one more shard, of at
       most HEAVY of them, which goes to all tasks, so no shard is probed by more than its share of rows, 16 bytes each. 3. The batches'
       hashes are looked up in the arrays; the documents that lose a line meet the list of their hashes, by a key of
       the whole row, and drop the lines; all others pass straight through.

    A key that is in two or more documents stays only in the smallest doc_id. A null text is one empty line. A null
    doc_id counts as one document after all others; rows that repeat a doc_id count as one document. An empty table
    gives an empty one. Other columns are not read.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    text = text.withColumn("row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"))
    lines = materialize(text.mapInArrow(_batch_lines, "h long, g long, n long, first long, last long, rows binary, docs binary"), "lines")
    total = lines.agg(F.sum("n")).first()[0] or 0  # a line of a batch has two numbers for each of its rows
    shards = max(1, -(-total // probes_per_shard))
    shard = F.pmod("h", F.lit(shards))
    repeated = lines.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    heavy = F.col("n") >= max(probes_per_shard // 4, -(-total // HEAVY))
    repeated = repeated.where(F.expr("first < last") | heavy).select(F.when(heavy, -1).otherwise(shard).alias("shard"), "h", "g", "n", "first")
    schema = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, firsts binary"
    index = materialize(repeated.groupBy("shard").applyInArrow(_build_shard, schema), "line-index")

    found = index.where("shard = -1").collect()  # one row at most, of at most HEAVY keys
    probes = lines.select("h", "g", "rows", "docs")
    drops = None
    if found:
        arrays = ShardArrays(found[0].asDict())

        def probe_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _drops(b, arrays).to_batches(max_chunksize=100_000)

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(~arrays.probe(_unsigned(b["h"]), _unsigned(b["g"]))[0]))

        drops = probes.mapInArrow(probe_heavy, "row long, h long, g long")
        probes = probes.mapInArrow(others, probes.schema)
    cold = probes.withColumn("shard", shard).groupBy("shard").cogroup(index.where("shard >= 0").groupBy("shard")).applyInArrow(_probe_shard, "row long, h long, g long")
    drops = materialize(cold if drops is None else drops.unionByName(cold), "drops")
    lists = materialize(drops.groupBy("row").agg(F.collect_set(F.struct("h", "g")).alias("drops")), "drop-lists")
    marked = marked_bits(text, "row", shared_bits(lists.select("row"), "row"))
    several = marked.where("maybe").select("doc_id", "text", "row").join(lists.hint("merge"), "row", "left").select("doc_id", "text", "drops")
    single = marked.where("not maybe").select("doc_id", "text", F.lit(None).cast(lists.schema["drops"].dataType).alias("drops"))
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * with_text
    return single.mapInArrow(_finish(with_text), out).unionByName(several.mapInArrow(_finish(with_text), out))
