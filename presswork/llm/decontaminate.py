"""Benchmark decontamination: a prefix-filtered join of item windows with the shingles of documents. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, marked_bits, materialize, shared_bits, text_or_empty

#: Words of a window, and of the shingles that stand for it in the join.
WINDOW, SHINGLE = 10, 5
#: Up to so many distinct shingles of items are broadcast (some 100 bytes each); more go by a bitmap of bounded size.
MOST_BROADCAST = 1 << 19
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = ["r1", "r2"]


def words_of(text: Column) -> Column:
    """The words of a text in order: letters, digits and all beyond ASCII, with only A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words) of every window of every item; an item of fewer words is one window, one without words none."""
    x = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty()).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (window - 1)))
    return x.where(F.size("all") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, n, k, off, shingle) of distinct windows, given by their words joined with blanks: the shingles of k words,
    all of the window's where it has fewer than shingle, at their offsets."""
    x = windows.withColumn("words", F.split("window", " ")).withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(shingle)))
    x = x.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))))
    return x.select("window", "n", "k", "off", F.array_join(F.slice("words", F.col("off") + 1, F.col("k")), " ").alias("shingle"))


def _near(docs: DataFrame, shingles: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """Of every row of docs one marker (shingle null), and a row for each position whose shingle may be one of an item's.

    Documents are read once, and no text shuffles: words explode next to the ones that follow, and their hash meets the
    items' hashes in a broadcast table, or in a bitmap of bounded size where there are very many.
    """
    text = text_or_empty()
    row = [F.xxhash64("doc_id", text).alias("r1"), F.xxhash64(F.lit(7), text, "doc_id").alias("r2")]
    x = docs.select("doc_id", *row, words_of(text).alias("words"))
    ahead = F.arrays_zip(*(F.slice("words", i + 1, F.size("words")).alias(f"w{i}") for i in range(max(sizes, default=1))))
    x = x.select("doc_id", *_ROW, F.size("words").cast("long").alias("n_words"), F.posexplode_outer(ahead).alias("pos", "w"))
    words = [F.col("w").getField(f) for f in x.schema["w"].dataType.names]
    x = x.withColumn("of", F.explode(F.array(*(F.lit(k) for k in sizes or [1]))) if len(sizes) > 1 else F.lit((sizes or [1])[0]))
    by_size = lambda made: F.coalesce(*(F.when((F.col("of") == k) & words[k - 1].isNotNull(), made(k)) for k in sizes or [1]))
    x = x.withColumn("h", by_size(lambda k: F.xxhash64(*words[:k])))
    first = (F.coalesce("pos", F.lit(0)) == 0) & (F.col("of") == (sizes or [1])[0])
    hashes = shingles.select(_hash_of("shingle").alias("h")).distinct()
    if hashes.count() <= most:
        x = x.join(F.broadcast(hashes.withColumn("maybe", F.lit(True))), "h", "left")
    else:
        x = marked_bits(x, "h", shared_bits(hashes, "h"))
    maybe = F.coalesce("maybe", F.lit(False))
    kept = x.where(first | maybe).select("doc_id", *_ROW, "n_words", "pos", first.alias("first"), F.when(maybe, by_size(lambda k: F.concat_ws(" ", *words[:k]))).alias("shingle"))
    return materialize(kept, "near-shingles")


def _hash_of(shingle: str) -> Column:
    """The hash that a shingle's words have in documents, whose number is that of the shingle."""
    words = F.split(shingle, " ")
    return F.coalesce(*(F.when(F.size(words) == k, F.xxhash64(*(F.get(words, F.lit(i)) for i in range(k)))) for k in range(1, SHINGLE + 1)))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items,
    items_sha256 and contaminated.

    1. Windows of items give shingles of five words; one pass over the documents keeps the positions where one of them
       may stand. 2. Shingles are ordered by how often documents hold them. All of a window's must be there, so its
       prefix is the rarest one alone, and a window with one that no document holds goes. 3. Positions of prefixes give
       candidates, bounded by the document's length. 4. A candidate stands if its first and its last shingle, which
       cover it, stand at their places, by their words and not by hashes.

    A null text or one without words has no words and no hits. Items with a null id count as one with an empty id, and
    items that repeat an id as one; items without words have no windows. Rows that repeat a doc_id, or a whole row, are
    rows of their own. Empty tables give no rows, or rows without hits. Other columns are not read.
    """
    of_items = materialize(item_windows(items, window).select(F.array_join("words", " ").alias("window"), "item").distinct(), "item-windows")
    shingles = materialize(window_shingles(of_items.select("window").distinct()), "item-shingles")
    sizes = sorted(r["k"] for r in shingles.select("k").distinct().collect())  # at most SHINGLE of them
    near = _near(docs, shingles, sizes, most_broadcast)

    found = near.where("shingle is not null").select(*_ROW, "n_words", "pos", "shingle").distinct()
    counts = found.groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = shingles.join(counts.hint("merge"), "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    least = F.min_by(F.struct("off", "shingle", "df"), F.struct("df", "off")).alias("p")
    ends = [F.min_by("shingle", "off").alias("head"), F.max_by("shingle", "off").alias("tail"), F.max("off").alias("tail_off")]
    prefixes = ranked.groupBy("window").agg(F.first("n").alias("n"), least, *ends).where("p.df > 0")
    prefixes = materialize(prefixes.select("window", "n", F.col("p.off").alias("off"), F.col("p.shingle").alias("shingle"), "head", "tail", "tail_off", F.col("p.df").alias("df")), "prefixes")

    start = F.col("pos") - F.col("off")
    candidates = join_groups(found, prefixes, "shingle", "df").withColumn("start", start).where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    candidates = candidates.select(*_ROW, "window", "n", "start", "head", "tail", (F.col("start") + F.col("tail_off")).alias("tail_pos"))
    there = found.select(*_ROW, "pos", "shingle")
    for end, at in (("head", "start"), ("tail", "tail_pos")):
        placed = there.withColumnsRenamed({"pos": at, "shingle": end}).hint("merge")
        candidates = candidates.join(placed, [*_ROW, at, end], "left_semi")
    occurs = materialize(candidates.select(*_ROW, "window", "n", "start"), "occurrences")

    before = Window.partitionBy(*_ROW).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = occurs.groupBy(*_ROW, "start").agg((F.col("start") + F.max("n")).alias("end"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy(*_ROW).agg(F.sum("fresh").alias("n_hit"))
    held = occurs.select(*_ROW, "window").distinct()
    sizes_of = materialize(of_items.join(held.groupBy("window").agg(F.count("*").alias("rows")).hint("merge"), "window"), "held-windows")
    named = join_groups(held, sizes_of, "window", "rows").groupBy(*_ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found_in = materialize(hit.join(named.hint("merge"), _ROW), "hits")

    rows = near.where("first").groupBy("doc_id", *_ROW, "n_words").agg(F.count("*").alias("times"))
    out = rows.join(found_in.hint("merge"), _ROW, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
