"""Quality rules: base text rules, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialize, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Buckets of the hashed unigrams and bigrams.
BUCKETS = 1 << 16
#: At most so many ids of trusted documents, some 64 MB, are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 21
#: A document is rejected if its score is below that of this share of the trusted documents ...
TRUSTED_SHARE = 0.001
#: ... less this margin, in nats for each n-gram.
MARGIN = 0.05
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A worker keeps the hashes of at most so many words, some 25 MB.
MOST_IDS = 1 << 17


class WordIds(dict):
    """64-bit hashes of words; holds at most so many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_IDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_IDS = WordIds()
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_IDS.__getitem__, words), np.uint64, len(words))


def ngram_buckets(h: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all words and pairs of neighbouring words."""
    both = np.concatenate([h, (h[:-1] * _SPREAD) ^ (h[1:] >> np.uint64(7))]) if len(h) else h
    return ((both * _SPREAD) >> np.uint64(40)).astype(np.int64) % buckets


def repeated_words(h: np.ndarray) -> int:
    """The words in windows of three words that are found twice or more in the text."""
    if len(h) < 4:
        return 0
    three = (h[:-2] * _SPREAD) ^ ((h[1:-1] << np.uint64(21)) | (h[1:-1] >> np.uint64(43))) * np.uint64(0xD1B54A32D192ED03) ^ (h[2:] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1))
    order = np.argsort(three, kind="stable")
    same = three[order][1:] == three[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(three), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    words = np.zeros(len(h), bool)
    words[:-2] |= twice
    words[1:-1] |= twice
    words[2:] |= twice
    return int(words.sum())


def base_rules(text: str, h: np.ndarray) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    n, repeated = len(h), repeated_words(h)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids of all good, non-toxic labels: the trusted target."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return materialize(good, "trusted")


def _to_join(ids: DataFrame, most: int) -> DataFrame:
    """ids, a written table, with the hint to broadcast them if they are few, else to shuffle."""
    return F.broadcast(ids) if ids.count() <= most else ids.hint("merge")


def ngram_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most_broadcast: int = BROADCAST_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over all documents, and over the trusted ones. At most buckets rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = ngram_buckets(word_hashes(text), buckets)
                some = np.bincount(one, minlength=buckets) if len(one) > buckets // 8 else None
                for to in (raw, target)[: 1 + good]:
                    if some is None:
                        np.add.at(to, one, 1)
                    else:
                        to += some
        used = np.flatnonzero(raw)
        for i in range(0, len(used), 8192):
            u = used[i : i + 8192]
            yield pa.RecordBatch.from_pydict({"bucket": u, "raw": raw[u], "target": target[u]})

    known = _to_join(trusted.select("doc_id", F.lit(True).alias("good")), most_broadcast)
    read = docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id", "left")
    read = read.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    out = read.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in out.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


#: Pseudo-counts of every bucket.
PRIOR = 10.0


def log_ratio(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log P(bucket | trusted) / P(bucket | raw). Both counts, the raw ones scaled to the size of the trusted text, are
    smoothed by prior n-grams a bucket, so a bucket that says little about the difference counts little."""
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + prior) / (expected + prior))


def score(h: np.ndarray, ratio: np.ndarray) -> float:
    """The mean log ratio of a text's n-grams; 0 without words."""
    at = ngram_buckets(h, len(ratio))
    return float(ratio[at].mean()) if len(at) else 0.0


def left_out(h: np.ndarray, raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> float:
    """The score of a trusted document as if it were not among them, so the threshold holds for unseen ones."""
    at, n = np.unique(ngram_buckets(h, len(raw)), return_counts=True)
    expected = raw[at] * (target.sum() / raw.sum())
    return float(np.log((target[at] - n + prior) / (expected + prior)) @ n / n.sum())


class QualityModel:
    """The fitted log ratios and the score below which a document is rejected."""

    def __init__(self, ratio: np.ndarray, threshold: float):
        self.ratio, self.threshold = ratio, threshold

    def verdict(self, text: str) -> tuple:
        h = word_hashes(text)
        base, s = base_rules(text, h), score(h, self.ratio)
        return *base, s, not base[-1] and s >= self.threshold


def low_quantile(scores: DataFrame, share: float) -> float | None:
    """The exact percentile of the column score, between neighbours as percentile has it; only the rows up to it leave
    the tasks."""
    n = scores.count()
    at = share * (n - 1)
    low = [r[0] for r in scores.orderBy("score").limit(int(at) + 2).collect()] if n else []
    return low[int(at)] + (at - int(at)) * (low[min(int(at) + 1, n - 1)] - low[int(at)]) if n else None


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_broadcast: int = BROADCAST_IDS) -> QualityModel:
    """Fit on all documents and all trusted ones; the threshold is a low quantile of the trusted documents' scores, each
    scored without itself. Without any trusted document every score passes."""
    trusted = trusted_ids(labels)
    raw, target = ngram_counts(docs, trusted, buckets, most_broadcast)
    if not target.sum():
        return QualityModel(np.zeros(buckets), -np.inf)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [word_hashes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"score": [left_out(x, raw, target) for x in h if len(x) >= LEAST_WORDS]}, schema=pa.schema([("score", pa.float64())]))

    own = docs.select("doc_id", text_or_empty().alias("text")).join(_to_join(trusted, most_broadcast), "doc_id", "left_semi").select("text")
    low = low_quantile(materialize(own.mapInArrow(scores, "score double"), "scores"), TRUSTED_SHARE)
    return QualityModel(log_ratio(raw, target), -np.inf if low is None else low - MARGIN)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score, kept. Null and empty texts have no words and fail the base rules. Every row is judged by itself, so ties,
    repeated rows, null doc_ids and further columns do not matter; an empty table gives an empty one."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    kinds = (pa.int64(),) * 5 + (pa.bool_(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(model.verdict, b.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | {n: pa.array(v, k) for n, v, k in zip(names, found, kinds, strict=True)})

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs that the rules and the model keep, with all their columns, whatever their names.

    Null and empty texts have no words and go. Every row is judged by itself, so ties, repeated rows and null doc_ids
    do not matter; an empty table gives an empty one.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.verdict(t or "")[-1] for t in b.column(at).to_pylist()], pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow does not take names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
