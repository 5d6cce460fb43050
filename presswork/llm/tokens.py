"""Token ids of whole texts by a public tokenizer, word by word through a bounded cache."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

CAPACITY = 2048
END_ID = 0
#: A worker keeps the ids of at most so many words.
CACHED_WORDS = 800_000
_LOADED: dict[str, tuple] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(path: str) -> tuple:
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _check_words(tokenizer, path)
        _LOADED[path] = tokenizer, {}
    return _LOADED[path]


def _check_words(tokenizer, path: str) -> None:
    """encode_texts goes word by word, which only holds for tokenizers that drop white space and do not join across it."""
    for text in ("ab cd", " The  end.\n\tof it, don't", "x\x0by\x0cz 12 345\r\n"):
        apart = [i for w in text.split() for i in tokenizer.encode(w, add_special_tokens=False).ids]
        if tokenizer.encode(text, add_special_tokens=False).ids != apart:
            raise ValueError(f"{path} does not encode word by word")


def vocabulary_size(path: str) -> int:
    return _loaded(path)[0].get_vocab_size()


def encode_texts(texts: list[str], path: str, end_id: int = END_ID) -> list[np.ndarray]:
    """The ids of each text, then end_id, as uint32.

    For tokenizers that drop white space and never join across it: then a text's ids are those of its words in turn.
    """
    tokenizer, cache = _loaded(path)
    split = [t.encode().split() for t in texts]
    new = list(set().union(*split).difference(cache)) if split else []
    for i in range(0, len(new), 4096):
        some = new[i : i + 4096]
        for word, e in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            cache[word] = np.array(e.ids, "<u4").tobytes()
    end = np.array([end_id], "<u4").tobytes()
    out = [np.frombuffer(b"".join(map(cache.__getitem__, words)) + end, "<u4") for words in split]
    if len(cache) > CACHED_WORDS:
        for word in new:
            del cache[word]
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, batch: int = 256) -> DataFrame:
    """One row per piece of a row of docs: doc_id, piece, start, length, ids_crc32, part, nth, and ids if asked for.

    A text of more than capacity ids is cut into pieces of capacity ids, the last one shorter; a null or empty text
    is its end id alone. nth numbers the pieces of a length within part, a task; write the table before use.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(texts), batch):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")}
                for doc, ids in zip(ids_of[at : at + batch], encode_texts(texts[at : at + batch], path), strict=True):
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity].tobytes()
                        n = len(own) // 4
                        for name, value in (("doc_id", doc), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(own)), ("part", part), ("nth", int(seen[n])), ("ids", own)):
                            rows[name].append(value)
                        seen[n] += 1
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "nth": pa.int64(), "ids": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(rows[k], v) for k, v in kinds.items() if with_ids or k != "ids"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(cut, schema)
