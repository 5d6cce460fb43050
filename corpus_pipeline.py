"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns the pieces and their
places. run() writes every stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from presswork.llm import quality
from presswork.llm.common import materialize, prepare, table
from presswork.llm.exact_dedup import drop_copies
from presswork.llm.jaccard_join import drop_near_copies
from presswork.llm.mixing import mixed
from presswork.llm.packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go.

    Null and empty texts go. Every row is judged by itself: repeated rows and null doc_ids stay or go by their text. An
    empty table gives an empty one; further columns of any name are kept.
    """
    prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest text, then the smallest doc_id (a null one last), of
    identical rows any one. An empty table gives an empty one; further columns of any name are kept."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join stays, that of the smallest doc_id, a null one last; of rows
    that repeat a doc_id each stays or goes by its own text, and of identical rows one stays. Texts without words are
    linked with nothing. An empty table gives an empty one; further columns of any name are kept."""
    prepare(spark)
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay as often as their rates say, twice at most; the rates bring the domains to their target weights. The
    classifier is fitted on all labelled documents, also those that earlier stages dropped. Rows with equal doc_id and
    text have equal rates; empty texts bear on no total and stay as the rate of a text without features says; an empty
    table gives an empty one; without labels all domains are equally likely. Further columns of any name are kept."""
    return mixed(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, cut and packed into sequences: a row per piece with its place. Every row is a document of its own,
    also one with a null doc_id or a copy that mixing made; an empty table gives no pieces. Other columns are not read."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents of sf_dir that come through the stages, as the last one gives them. Every stage's rows
    are written to the shared folder and read back, so a lost executor costs its tasks of one stage alone."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: Fitted models and token ids are beyond SQL. tests/llm compares run() with a version of every stage by brute force, which
#: takes over the two fitted models as they are.
ORACLE_SQL = None
