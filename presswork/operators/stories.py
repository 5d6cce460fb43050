"""Grouping articles into stories by vector similarity, and dropping stories already covered."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .skew import package_on_workers, shared_folder, star_components, written
from .vectors import banded_pairs, best_matches, exact_pairs

ATTACH, ASK = 0.65, 0.5


def greedy_stories(articles: DataFrame, attach: float = ATTACH) -> DataFrame:
    """articles(run_id, pos, topic, embedding) -> (run_id, pos, story, story_topic), in order of pos within a run.

    An article joins the most similar story, the earliest of equals, if that is similar enough, and else opens one.
    The order matters by definition, so each run is one group; a run holds about a thousand articles. Use story_pairs
    and story_components, or assign_to_stories, for sets without such a bound.
    """

    def of_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        vectors = np.stack(pdf["embedding"].to_numpy()).astype(float)
        centres, sizes, story, topics = np.zeros_like(vectors), [], [], []
        for vector, topic in zip(vectors, pdf["topic"], strict=True):
            sims = centres[: len(sizes)] @ vector
            best = int(sims.argmax()) if len(sims) else -1
            if best < 0 or sims[best] < attach:
                best = len(sizes)
                sizes.append(0)
                topics.append(topic)
            sizes[best] += 1
            centres[best] += (vector - centres[best]) / sizes[best]
            story.append(best)
        return pd.DataFrame({"run_id": pdf["run_id"], "pos": pdf["pos"], "story": np.array(story, "int64"), "story_topic": [topics[s] for s in story]})

    kind = articles.schema["run_id"].dataType.simpleString()
    x = articles.where("embedding is not null").select("run_id", "pos", "topic", "embedding")
    return x.groupBy("run_id").applyInPandas(of_run, f"run_id {kind}, pos long, story long, story_topic string")


def story_pairs(vectors: DataFrame, least: float, block: str = "topic", recall: float | None = None) -> DataFrame:
    """(a, b, sim) of all pairs of a block with at least that similarity: every one, or with recall about that share of
    those right at the threshold, and more of the others, for blocks whose rows are too many to compare them all."""
    if recall is None:
        return exact_pairs(vectors, least, block)
    return banded_pairs(vectors, least, block, recall)


def story_components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, story) of every node, with story the smallest id connected by pairs."""
    found = written(star_components(pairs.select("a", "b")))
    x = nodes.select("id").join(found.hint("merge"), "id", "left")
    return x.select("id", F.coalesce("component", "id").alias("story"))


def story_centroid(vectors: DataFrame, stories: DataFrame) -> DataFrame:
    """The mean vector of each story, not made unit length again: (story, centroid)."""
    x = vectors.join(stories.select("id", "story").hint("merge"), "id").select("story", F.posexplode("embedding").alias("dim", "x"))
    x = x.groupBy("story", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return x.groupBy("story").agg(F.transform(ordered, lambda s: s["x"]).alias("centroid"))


def assign_to_stories(articles: DataFrame, centroids: DataFrame, least: float = ATTACH, block: str = "topic") -> DataFrame:
    """The best story of each article's block if it is similar enough, the smallest story of equals; others have null.
    story_state.advance makes stories of those."""
    best = best_matches(articles.select("id", block, F.col("embedding").alias("vector")), centroids.select(F.col("story").alias("id"), block, F.col("centroid").alias("vector")), block, least)
    best = best.select("id", F.col("other").alias("story"), "sim")
    return articles.select("id", block).join(best.hint("merge"), "id", "left").select("id", block, "story", "sim")


def best_existing_card(clusters: DataFrame, cards: DataFrame, least: float | None = None) -> DataFrame:
    """Of each cluster the most similar existing card of its topic, the smallest id of equals; none if no such card, or
    none of at least that similarity."""
    a = clusters.select(F.col("cluster_pos").alias("id"), "topic", F.col("embedding").alias("vector"))
    best = best_matches(a, cards.select("id", "topic", F.col("embedding").alias("vector")), "topic", least)
    best = best.select(F.col("id").alias("cluster_pos"), F.col("other").alias("card_id"), "sim")
    return clusters.select("cluster_pos", "topic").join(best.hint("merge"), "cluster_pos").select("cluster_pos", "topic", "card_id", "sim")


def duplicate_candidates(clusters: DataFrame, cards: DataFrame, least: float = ASK) -> DataFrame:
    """The best card of each cluster where it is similar enough to ask for a judgement."""
    return best_existing_card(clusters, cards, least)


def drop_covered(clusters: DataFrame, candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Clusters that no judgement calls the same story as their candidate; an absent judgement keeps the cluster."""
    c = candidates.select("cluster_pos", "card_id").join(judged.select("cluster_pos", "card_id", "same").hint("merge"), ["cluster_pos", "card_id"])
    gone = c.where("same").select("cluster_pos").distinct()
    return clusters.join(gone.hint("merge"), "cluster_pos", "left_anti")


def filter_already_covered(clusters: DataFrame, cards: DataFrame, judged: DataFrame, least: float = ASK) -> DataFrame:
    return drop_covered(clusters, duplicate_candidates(clusters, cards, least), judged)


def word_slot(word: Column, dims: int) -> Column:
    """The dimension of a word: the first 32 bits of its MD5, modulo dims."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dims


class Slots(dict):
    """word_slot of words; holds at most so many."""

    def __init__(self, dims: int, most: int = 1 << 17):
        self.dims, self.most = dims, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = slot = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16) % self.dims
        return slot


def _slot_counts(dims: int):
    """The number of a text's words in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(dims)
        for b in batches:
            n, words = b.num_rows, b["words"].flatten().to_pylist()
            at = np.repeat(np.arange(n), np.diff(b["words"].offsets.to_numpy()))
            found = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
            tf = np.bincount(at * dims + found, minlength=n * dims)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dims, pa.int32()), pa.array(tf, pa.int64()))
            yield pa.RecordBatch.from_arrays([b["pos"], b["topic"], lists], ["pos", "topic", "tf"])

    return run


def embed_articles(articles: DataFrame, dims: int = 64) -> DataFrame:
    """(pos, topic, embedding): unit vectors of hashed words of the whole text, weighted by the inverse document
    frequency log((n + 1) / (df + 1)) of their dimension; inputs with vectors need none of it. A text without words, or
    with words of no weight alone, has the null vector."""
    whole = F.lower(F.concat("title", F.lit(". "), "snippet"))
    words = F.coalesce(F.filter(F.split(whole, r"[\s]+"), lambda w: w != ""), F.array().cast("array<string>"))
    kinds = {f.name: f.dataType.simpleString() for f in articles.select("pos", "topic").schema.fields}
    package_on_workers(articles.sparkSession)
    counts = articles.select("pos", "topic", words.alias("words")).mapInArrow(_slot_counts(dims), f"pos {kinds['pos']}, topic {kinds['topic']}, tf array<long>")
    counts = written(counts)
    held = counts.select(F.posexplode("tf").alias("dim", "tf")).groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("tf") > 0).alias("df"))
    idf = [0.0] * dims  # a row a dimension
    for r in held.select("dim", F.log((F.col("n") + 1) / (F.col("df") + F.lit(1))).alias("idf")).collect():
        idf[r["dim"]] = r["idf"]
    x = counts.withColumn("v", F.zip_with("tf", F.lit(idf), lambda n, w: n * w))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, y: t + y * y))
    x = x.withColumn("norm", norm)
    return x.select("pos", "topic", F.transform("v", lambda y: F.when(F.col("norm") > 0, y / F.col("norm")).otherwise(0.0).cast("float")).alias("embedding"))


def map_batches(rows: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a user hook(pandas.DataFrame) -> pandas.DataFrame once a batch_id.

    Rows of a batch are brought together by the batch id; a hook that raises gives no rows for its batch. The functions
    below, and triage.align_verdicts for the judge, fill in what that means.
    """

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(t: pa.Table) -> pa.Table:
        try:
            return pa.Table.from_pandas(hook(t.to_pandas()), schema=arrow, preserve_index=False)
        except Exception as e:  # a failing batch must not fail the others
            print(f"hook failed on batch {t['batch_id'][0]}: {e}", file=sys.stderr)
            return arrow.empty_table()

    return rows.groupBy("batch_id").applyInArrow(run, schema)


EMBED_BATCH, TOLERANCE = 64, 1e-3


def embed_with(texts: DataFrame, hook: Callable[[list[str]], list], batch: int = EMBED_BATCH) -> DataFrame:
    """texts(id, text) -> (id, embedding) by a hook that maps at most batch texts to unit vectors.

    Nothing shuffles. A hook that raises, gives another number of vectors, or one that is not of unit length fails the
    job: an article without its vector would silently leave its story.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                some = b.slice(at, batch)
                vectors = [np.asarray(v, "float32") for v in hook(some.column(1).to_pylist())]
                if len(vectors) != some.num_rows:
                    raise ValueError(f"the embedder gave {len(vectors)} vectors for {some.num_rows} texts")
                if any(abs(float(np.linalg.norm(v)) - 1) > TOLERANCE for v in vectors):
                    raise ValueError("the embedder gave a vector that is not of unit length")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))], ["id", "embedding"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def same_story_with(candidates: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """candidates(batch_id, cluster_pos, card_id, ...) -> (cluster_pos, card_id, same) by a hook; fail-open: a batch
    that fails, or a pair without an answer, is not the same story, so its cluster stays."""
    asked = written(candidates)
    answers = map_batches(asked, hook, "cluster_pos bigint, card_id bigint, same boolean")
    answers = written(answers).groupBy("cluster_pos", "card_id").agg(F.bool_and("same").alias("same"))
    x = asked.select("cluster_pos", "card_id").join(answers.hint("merge"), ["cluster_pos", "card_id"], "left")
    return x.withColumn("same", F.coalesce("same", F.lit(False)))


def written_with(cards: DataFrame, hook: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """cards(batch_id, card_key, source_text) -> (card_key, title, summary, labels, stop_reason) by a hook; a card whose
    batch fails, or that has no summary, is dropped."""
    out = map_batches(cards, hook, "card_key bigint, title string, summary string, labels array<string>, stop_reason string")
    return out.where("trim(summary) <> ''")
