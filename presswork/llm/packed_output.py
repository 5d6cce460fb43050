"""Token-id output: best-fit-decreasing packing with a segment tree over free room, written as id matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .tokens import CAPACITY, encode_texts, vocabulary, vocabulary_size

#: A task packs so many ids at once; it bounds its memory. Each buffer may leave a few sequences part full.
BUFFER_IDS = 4 << 20
SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """A segment tree over free room 0..capacity that holds open sequences and finds the least room that suffices."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += change
            node >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def pop_at_least(self, room: int) -> tuple[int, int] | None:
        """(room, sequence) of the tightest fit, or None."""
        node, count = self.size + room, self.count
        while not count[node]:
            while node & 1:  # a right child: go up until there is a right sibling
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # wrapped to the next level: nothing to the right
                return None
        while node < self.size:
            node *= 2
            if not count[node]:
                node += 1
        best = node - self.size
        self._add(best, -1)
        return best, self.open[best].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into lengths."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.pop_at_least(lengths[i])
        if found is None:
            found = capacity, len(out)
            out.append([])
        room, sequence = found
        out[sequence].append(i)
        if room > lengths[i]:
            tree.push(room - lengths[i], sequence)
    return out


def packed_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, pad_id: int = 0, kind: str | None = None, buffer_ids: int = BUFFER_IDS) -> DataFrame:
    """One row per sequence, a row of the id matrix: sequence_id, n_tokens, doc_ids, pieces (the number of each piece in
    its document), cu_seqlens (0, then the running sum of lengths), ids (capacity ids of numpy type kind, padded with
    pad_id) and positions (each piece restarts at 0; padding is 0). kind is <u2 or, where the vocabulary or the capacity
    needs it, <u4; an id that does not fit into a kind given raises.

    Every task packs its own documents in buffers, so nothing shuffles. A document of more than capacity ids is cut
    into pieces without loss. Null and empty texts are their end id alone; null doc_ids and repeated rows are packed
    as any other; an empty table gives an empty one. Other columns are not read. Write the table before use.
    """
    path = path or vocabulary()
    kind = kind or ("<u2" if max(vocabulary_size(path), pad_id + 1, capacity) <= 1 << 16 else "<u4")
    largest = np.iinfo(kind).max

    def flush(held: list[tuple], first: int) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(x[2]) for x in held], capacity)
        rows: dict[str, list] = {k: [] for k in ("sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions")}
        for k, members in enumerate(packed):
            ids, positions, ends = np.full(capacity, pad_id, kind), np.zeros(capacity, kind), [0]
            for i in members:
                own = held[i][2]
                ids[ends[-1] : ends[-1] + len(own)] = own
                positions[ends[-1] : ends[-1] + len(own)] = np.arange(len(own))
                ends.append(ends[-1] + len(own))
            for name, value in zip(rows, (first + k, ends[-1], [held[i][0] for i in members], [held[i][1] for i in members], ends, ids.tobytes(), positions.tobytes()), strict=True):
                rows[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, made = 0, TaskContext.get().partitionId() << 36
        for b in batches:
            docs_of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for doc, ids in zip(docs_of[at : at + 256], encode_texts(texts[at : at + 256], path), strict=True):
                    if ids.max() > largest:
                        raise ValueError(f"id {ids.max()} does not fit into {kind}")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        held.append((doc, k, ids[start : start + capacity].astype(kind)))
                    size += len(ids)
                if size >= buffer_ids:
                    out = flush(held, made)
                    held, size, made = [], 0, made + out.num_rows
                    for i in range(0, out.num_rows, 256):
                        yield out.slice(i, 256)
        if held:
            yield flush(held, made)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, SCHEMA)


def written_sequences(docs: DataFrame, **options) -> DataFrame:
    """packed_sequences, written to the shared folder and read back."""
    return materialize(packed_sequences(docs, **options), "packed")
