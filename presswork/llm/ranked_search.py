"""Ranked lexical search: hashed max-sketches bound every document's score, and exact scores stop at a threshold."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Documents for each query; coordinates of a sketch.
TOP, WIDTH = 50, 1024
#: Queries are worked in blocks of about so many terms, which is all of them that the driver and a task hold at a time.
BLOCK_TERMS = 1 << 18
#: A first pass over one in so many documents finds scores that the top ones must reach; the result rests on none of it.
SEED_SHARE = 16
#: Documents of a query that are scored at a time, in order of their bounds.
_STEP = 64
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(32 if b in _SEPARATORS else b for b in range(256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else _TABLE[b] for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: digits, letters and all beyond ASCII, with only A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


def _text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary").alias("text")


def _index(vocabulary):
    """Documents as (doc_id, n, terms, tfs): the number of all terms, and the queries' terms among them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        many = len(vocabulary.value)
        for b in batches:
            found = [terms_of(t) for t in b.column(1).to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((get(t, -1) for one in found for t in one), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(found)), n)
            keys, tf = np.unique((doc * many + ids)[ids >= 0], return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(len(found) + 1) * many), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (keys % max(many, 1), tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return run


class Scorer:
    """Impacts, bounds and exact scores of batches of the index for a block of queries."""

    def __init__(self, queries: list[np.ndarray], df: np.ndarray, docs: int, length: int, width: int):
        self.queries, self.docs, self.length, self.width, self.many = queries, docs, length, width, len(df)
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.bucket = np.array([xxhash.xxh32_intdigest(int(i).to_bytes(4, "little")) % width for i in range(len(df))], np.int64)
        self.lookups = np.zeros((width, len(queries)))
        for q, terms in enumerate(queries):
            np.add.at(self.lookups[:, q], self.bucket[terms], 1)

    def load(self, b: pa.RecordBatch) -> None:
        n = b["n"].to_numpy()
        lists = b["terms"]
        doc = np.repeat(np.arange(len(n)), np.diff(lists.offsets.to_numpy()))
        term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, b["tfs"]))
        m = 100 - 50 + (50 * n * self.docs) // self.length
        self.impact = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        self.keys = doc * self.many + term
        sketches = np.zeros((len(n), self.width))
        np.maximum.at(sketches, (doc, self.bucket[term]), self.impact)
        self.bounds = sketches @ self.lookups * (1 + 1e-9)  # sums in doubles, rounded up

    def exact(self, docs: np.ndarray, q: int) -> np.ndarray:
        keys = docs[:, None] * self.many + self.queries[q][None, :]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.impact[at], 0).sum(axis=1)


def _best(scorer: Scorer, least: np.ndarray, top: int):
    """The best documents of each query among those of a task, (q, doc_id, score).

    least holds a score for each query that the top documents reach. Documents are scored in descending order of
    their bounds, until these fall below it, or below the lowest of as many scores as are asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in scorer.queries]
        bar = np.maximum(least, 1)
        for b in batches:
            scorer.load(b)
            if not len(scorer.keys):
                continue
            ids = b["doc_id"].to_pylist()
            hopeful = scorer.bounds >= bar
            for q in np.flatnonzero(hopeful.any(axis=0)):
                docs, heap = np.flatnonzero(hopeful[:, q]), heaps[q]
                docs = docs[np.argsort(-scorer.bounds[docs, q], kind="stable")]
                for at in range(0, len(docs), _STEP):
                    some = docs[at : at + _STEP]
                    if scorer.bounds[some[0], q] < bar[q]:
                        break
                    scores = scorer.exact(some, q)
                    for d, score in zip(some[scores >= bar[q]].tolist(), scores[scores >= bar[q]].tolist(), strict=True):
                        entry = (score, ids[d] is not None, -(ids[d] or 0))  # a null doc_id is the last of equals
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == top:
                        bar[q] = max(bar[q], heap[0][0])
        found = [(q, -doc if known else None, score) for q, heap in enumerate(heaps) for score, known, doc in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], ["q", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(docs: DataFrame, queries: list, top: int, width: int, seed_share: int) -> DataFrame | None:
    """Results of queries [(item_id, terms)] as (q, rank, doc_id, score), with q the place in the list."""
    spark = docs.sparkSession
    names = sorted({t for _, terms in queries for t in terms})
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    of_doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text())
    index = materialize(of_doc.mapInArrow(_index(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "impact-index")
    n_docs, length = index.agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not names:
        return None
    df = np.zeros(len(names), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
        df[r["term"]] = r["count"]
    scorer = Scorer([np.array([vocabulary.value[t] for t in terms], np.int64) for _, terms in queries], df, n_docs, length, width)
    schema = "q int, doc_id long, score long"
    least = np.zeros(len(queries), np.int64)
    seeds = index.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seed_share)) == 0)
    for r in _ranked(seeds.mapInArrow(_best(scorer, least, top), schema), top).where(F.col("rank") == top).collect():  # a row a query
        least[r["q"]] = r["score"]
    return _ranked(index.mapInArrow(_best(scorer, least, top), schema), top).select("q", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, block_terms: int = BLOCK_TERMS, seed_share: int = SEED_SHARE) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of every item by score, then by doc_id, a null one last.

    1. One pass over the whole texts counts each document's terms, and keeps those that the queries ask for. 2. Counts
       over all documents give each term its weight and each document its impacts. 3. A document's impacts fold into a
       sketch, the maximum of each of width coordinates that terms hash to; a query's bound is the sum of its terms'
       coordinates, for all queries at once a product of matrices. 4. In descending order of bounds, documents are scored
       exactly until no bound reaches the threshold: the lowest of the top scores so far, or what a first pass over one in
       seed_share documents shows to be reached. Every document that could be in the result is scored.

    A null text or one without terms matches nothing and counts for nothing; items without terms have no rows, nor have
    documents without a score above zero. Rows that repeat a doc_id are documents of their own, and rows that repeat an
    item_id queries of their own. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    asked = materialize(items.select("item_id", _text()).mapInArrow(_distinct_terms, f"item_id {kind}, terms array<binary>"), "queries")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in range(blocks):
        queries = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).collect()]
        found = _search_block(docs, queries, top, width, seed_share) if queries else None
        if found is not None:
            ids = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(queries)], f"q int, item_id {kind}")
            out = out.unionByName(found.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"))
    return out
