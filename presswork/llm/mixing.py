"""Mixing sources to target weights by soft membership: posteriors of a classifier fitted on a labelled table, and
document rates by distributed projected-gradient least squares. Native.

Classifier. A text's features are its distinct words, the heads and tails of them, and its shape (length, share of
distinct words, share of capitals), hashed into buckets. Only the buckets that tell the labelled domains apart (by a
log-likelihood ratio test) have a weight, so a long text collects no noise from its many rare words. The weights are those
of a multinomial logistic regression on the presence of these buckets.

Rates. r minimises 1/2 (S(r) - t)' M^-1 (S(r) - t) + ridge/2 sum tokens (r - 1)^2 over 0 <= r <= most_rate, where S(r)
are the expected tokens of the domains, t the targets and M the domains' second moments. So a document changes no more
than the targets ask for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, field, materialize, row_struct, text_or_empty

DOMAINS = ("good", "junk", "toxic")
#: Share of the mixed tokens that each domain is expected to have. Memberships are soft: also a set without any toxic text is
#: expected to hold a little of it, and a target of 0 would take away good texts of which the classifier is merely unsure.
TARGETS = {"good": 0.96, "junk": 0.02, "toxic": 0.02}
#: A row goes into the mix at most so many times.
MOST_RATE = 2.0
#: The classifier is fitted on at most so many labelled documents, those of the lowest hashes of doc_id.
LABELLED_ROWS = 4000
BUCKETS = 1 << 16
#: The least G statistic (twice the log-likelihood ratio) of a bucket with a weight, and the most such buckets.
SIGNIFICANT, KEPT = 15.0, 1024
#: Of the rates, against change.
RIDGE = 0.02
#: Rows whose posteriors are within the same steps of this size share the rounds that fit the rates.
GRAIN = 1e-3
#: Rounds at most; the change of any domain's share of the tokens that ends them.
STEPS, TOLERANCE = 40, 2e-4


def domain_of(labels: DataFrame) -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("junk")


def with_buckets(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, tokens (words between [\\x20\\x09-\\x0D]; none in an empty text), shape and words (both for buckets_of)."""
    text = F.btrim(text_or_empty(), F.lit(WHITE))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    names = [f"k{i}" for i in range(len(keep))]
    x = docs.select(*(c.alias(n) for c, n in zip(keep, names, strict=True)), F.split(F.lower(text), "[ \t\n\x0b\x0c\r]+").alias("all"), (10 * capitals / F.greatest(F.lit(1), F.length(text))).cast("int").alias("capitals"))
    x = x.select(*names, "capitals", F.when(F.get("all", F.lit(0)) == "", 0).otherwise(F.size("all")).alias("tokens"), F.array_distinct("all").alias("words"))
    shape = F.array(
        F.concat(F.lit("~length "), F.length(F.bin("tokens")).cast("string")),
        F.concat(F.lit("~distinct "), (10 * F.size("words") / F.greatest(F.lit(1), F.col("tokens"))).cast("int").cast("string")),
        F.concat(F.lit("~capitals "), F.col("capitals").cast("string")),
    )
    return x.select(*(F.col(n).alias(out) for n, out in zip(names, docs.select(*keep).columns, strict=True)), F.col("tokens").cast("long").alias("tokens"), shape.alias("shape"), "words")


def _bucket(feature: Column) -> Column:
    return F.xxhash64(feature).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def buckets_of() -> Column:
    """The buckets of a row of with_buckets: of every word, its first four and last two characters, and the shape."""

    def of_word(w: Column) -> Column:
        return F.array(_bucket(w), _bucket(F.concat(F.lit("^"), F.substring(w, 1, 4))), _bucket(F.concat(F.lit("$"), F.substring(w, -2, 2))))

    return F.concat(F.flatten(F.transform("words", of_word)), F.transform("shape", _bucket))


@dataclass
class Model:
    """Log odds against the first domain: of a text without any weighted bucket, and what each such bucket adds."""

    bias: np.ndarray  # [domain]
    slots: np.ndarray  # [bucket], 0: no weight
    weights: np.ndarray  # [domain, slot], slot 0 unused


def telling_buckets(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """slots[bucket] from counts[domain, bucket], the documents with a bucket, and rows[domain], all documents: 1, 2, ...
    for the KEPT most telling buckets, 0 for others."""
    total, n = counts.sum(0), max(1, rows.sum())
    best = np.zeros(counts.shape[1])
    for seen, of in zip(counts, rows, strict=True):
        g = np.zeros(counts.shape[1])
        for part, base in ((seen, of), (total - seen, n - of)):
            for some, share in ((part, total / n), (base - part, 1 - total / n)):
                g += 2 * some * np.log(np.where(some > 0, some / np.maximum(base * share, 1e-12), 1))
        best = np.maximum(best, g)
    found = np.flatnonzero(best >= SIGNIFICANT)
    found = found[np.argsort(-best[found], kind="stable")[:KEPT]]
    slots = np.zeros(counts.shape[1], int)
    slots[found] = np.arange(1, len(found) + 1)
    return slots


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 300, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(bias[domain], weights[feature, domain]) of a multinomial logistic regression by AdaGrad; x holds 0 and 1."""
    k = len(DOMAINS)
    x, gold = x.astype(np.float32), np.eye(k, dtype=np.float32)[y]
    across = np.ascontiguousarray(x.T)
    w, bias = np.zeros((x.shape[1], k), np.float32), np.log(np.bincount(y, minlength=k) + 1.0).astype(np.float32)
    squares, bias_squares = np.full_like(w, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(rounds):
        z = x @ w + bias
        p = np.exp(z - z.max(1, keepdims=True))
        off = p / p.sum(1, keepdims=True) - gold
        g, bias_g = across @ off + ridge * w, off.sum(0)
        squares += g * g
        bias_squares += bias_g * bias_g
        w -= rate * g / np.sqrt(squares)
        bias -= rate * bias_g / np.sqrt(bias_squares)
    return bias, w


def _constant(numbers: np.ndarray, kind: str) -> Column:
    """An array of numbers, folded to one constant of the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def log_odds(model: Model) -> list[Column]:
    """The log odds of the other domains against the first, over the column hits of weighted slots."""

    def of(d: int) -> Column:
        table = _constant(model.weights[d].round(4), "double")

        def add(total: Column, hit: Column) -> Column:
            return total + F.get(table, hit)

        return F.aggregate("hits", F.lit(float(model.bias[d])), add)

    return [of(d) for d in range(1, len(DOMAINS))]


def hits_of(buckets: Column, model: Model) -> Column:
    """The distinct slots with a weight that a row's buckets fall into."""
    table = _constant(model.slots, "int")
    return F.array_distinct(F.filter(F.transform(buckets, lambda b: F.get(table, b)), lambda s: s > 0))


def posteriors(odds: list[Column]) -> list[Column]:
    top = F.greatest(F.lit(0.0), *odds)
    parts = [F.exp(-top), *(F.exp(x - top) for x in odds)]
    whole = sum(parts[1:], parts[0])
    return [(p / whole).alias(f"p_{d}") for p, d in zip(parts, DOMAINS, strict=True)]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Written: doc_id, domain, held (a fifth of the rows), tokens, buckets. Of several labels of a doc_id the toxic one and the
    low quality count."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    known = materialize(known.select("doc_id", domain_of(known).alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    x = with_buckets(own, [F.col("doc_id"), F.col("domain")])
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    return materialize(x.select("doc_id", "domain", held.alias("held"), "tokens", F.array_distinct(buckets_of()).alias("buckets")), "labelled-buckets")


def fit_known(known: DataFrame) -> Model:
    """Fit on rows of labelled(). To the driver come a row a bucket, and the few weighted buckets of each labelled row;
    neither grows with the corpus. Without labels no bucket tells anything, and the domains are equally likely."""
    counts = np.zeros((len(DOMAINS), BUCKETS))
    part = [F.count_if(F.col("domain") == d) for d in DOMAINS]
    for at, *n in known.select("domain", F.explode("buckets").alias("at")).groupBy("at").agg(*part).collect():
        counts[:, at] = n
    slots = telling_buckets(counts, np.array(known.agg(*part).first(), float))
    model = Model(np.zeros(len(DOMAINS)), slots, np.zeros((len(DOMAINS), slots.max() + 1)))
    found = known.select("domain", hits_of(F.col("buckets"), model).alias("hits")).collect()
    x = np.zeros((len(found), slots.max() + 1), bool)
    for i, r in enumerate(found):
        x[i, r["hits"]] = True
    y = np.array([DOMAINS.index(r["domain"]) for r in found], int)
    bias, weights = regression(x[:, 1:], y)
    model.bias = (bias - bias[0]).astype(float)
    model.weights[:, 1:] = (weights - weights[:, :1]).T
    return model


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    return fit_known(labelled(docs, labels, rows))


def held_out(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """(domain, predicted, n): a held-out fifth of the labelled rows by label and by the most likely domain, according to
    a model fitted on the others."""
    known = labelled(docs, labels, rows)
    model = fit_known(known.where("not held"))
    x = known.where("held").select("domain", hits_of(F.col("buckets"), model).alias("hits"))
    x = x.select("domain", *(o.alias(f"odds{i}") for i, o in enumerate(log_odds(model))))
    odds = [F.lit(0.0), *(F.col(f"odds{i}") for i in range(len(DOMAINS) - 1))]
    best = F.array_max(F.array(*(F.struct(o.alias("odds"), F.lit(d).alias("d")) for o, d in zip(odds, DOMAINS, strict=True))))["d"]
    return x.select("domain", best.alias("predicted")).groupBy("domain", "predicted").agg(F.count("*").alias("n"))


def with_memberships(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """keep, and tokens and p_<domain> of every row; the posteriors sum to 1."""
    x = with_buckets(docs, keep)
    names = [c for c in x.columns if c not in ("shape", "words")]
    x = x.select(*names, hits_of(buckets_of(), model).alias("hits"))
    x = x.select(*names, *(o.alias(f"odds{i}") for i, o in enumerate(log_odds(model))))
    odds = [F.col(f"odds{i}") for i in range(len(DOMAINS) - 1)]
    return x.select(*names, *posteriors(odds))


def rate_of(steps: list[list[float]], most_rate: float = MOST_RATE, ahead: bool = False) -> Column:
    """The rate of a row after these steps (of fit_rates), from 1, within 0 and most_rate; with ahead, the extrapolated
    rate at which the next gradient is taken."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    p = [F.col(f"p_{d}") for d in DOMAINS]

    def step(state: Column, s: Column) -> Column:
        down = sum((p[k] * s[k + 2] for k in range(1, len(DOMAINS))), p[0] * s[2])
        r = F.least(F.lit(float(most_rate)), F.greatest(F.lit(0.0), state["y"] * s[1] + (1 - s[1]) - down))
        return F.struct(r.alias("r"), (r + s[0] * (r - state["r"])).alias("y"))

    return F.aggregate(moves, start, step)["y" if ahead else "r"]


def fit_rates(members: DataFrame, targets: dict[str, float], budget: float | None = None, ridge: float = RIDGE, most_rate: float = MOST_RATE) -> list[list[float]]:
    """The projected gradient steps towards expected tokens of targets x budget; see the module's docstring for the
    objective. A step is (momentum, share of the rate that stays, one number a domain): every row moves its rate by its
    posteriors times these numbers, and is cut to 0 and most_rate.

    The metric of the residual is the inverse of the domains' second moments, so the step 1 / (1 + ridge) suits all
    domains, whatever their sizes; the momentum is Nesterov's for that objective. budget is the tokens of the mix;
    unless given, such that the domain with the largest target keeps what it has. Targets out of reach (a domain too
    scarce for most_rate) are met as nearly as least squares can. Rows whose posteriors agree to GRAIN are one row of the
    rounds, with the sum of their tokens, so a round reads a table whose size does not grow with the rows; only sums by
    domain reach the driver.
    """
    share = np.array([targets[d] for d in DOMAINS])
    k, p = len(DOMAINS), [F.col(f"p_{d}") for d in DOMAINS]
    tokens = F.col("tokens").cast("double")
    first = members.agg(F.sum(tokens), *(F.sum(tokens * x) for x in p), *(F.sum(tokens * x * y) for x in p for y in p)).first()
    total = first[0]
    if not total:
        return []
    now, moments = np.array(first[1 : k + 1]), np.array(first[k + 1 :]).reshape(k, k)
    most = int(share.argmax())
    goal = share * (now[most] / share[most] if budget is None else budget)
    metric = np.linalg.pinv(moments, rcond=1e-9, hermitian=True)
    slow = np.sqrt(ridge / (1 + ridge))
    momentum = (1 - slow) / (1 + slow)
    grain = [F.round(x / GRAIN).cast("int").alias(f"g{i}") for i, x in enumerate(p[1:])]
    means = [(F.sum(tokens * x) / F.sum(tokens)).alias(f"p_{d}") for x, d in zip(p, DOMAINS, strict=True)]
    members = materialize(members.where("tokens > 0").groupBy(*grain).agg(F.sum("tokens").alias("tokens"), *means), "alike-members")
    steps: list[list[float]] = []
    still = 0
    while len(steps) < STEPS and still < 2:
        steps.append([float(momentum), 1 / (1 + ridge), *(float(x) for x in metric @ (now - goal) / (1 + ridge))])
        before = now
        rated = members.select("tokens", *p, rate_of(steps, most_rate, ahead=True).alias("rate"))
        now = np.array(rated.agg(*(F.sum(F.col("rate") * tokens * x) for x in p)).first())
        still = still + 1 if np.abs(now - before).max() <= TOLERANCE * total else 0
    return steps


def copies_of(rate: Column) -> Column:
    """The rate rounded up or down by a hash of the row, so that copies are rate on average."""
    u = F.pmod(F.xxhash64("doc_id", "tokens", F.lit("mix")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + u).cast("int")


def expected_shares(rated: DataFrame) -> DataFrame:
    """(domain, share, mixed): of the result of mixing_rates the share of each domain in the expected tokens, as they were
    and as the rates mix them, to be held against the targets."""
    x = rated.agg(*(F.sum(F.col("tokens") * F.col(f"p_{d}") * r).alias(f"{d}{i}") for d in DOMAINS for i, r in enumerate((F.lit(1.0), F.col("rate")))))
    whole = [sum((F.col(f"{d}{i}") for d in DOMAINS[1:]), F.col(f"{DOMAINS[0]}{i}")) for i in (0, 1)]
    return x.select(F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), (F.col(f"{d}0") / whole[0]).alias("share"), (F.col(f"{d}1") / whole[1]).alias("mixed")) for d in DOMAINS))).alias("s")).select("s.*")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most_rate: float = MOST_RATE) -> DataFrame:
    """One row per row of docs: doc_id, tokens, p_good, p_junk, p_toxic, rate, copies. targets are the shares of the
    domains in the expected tokens of the mix; see TARGETS and expected_shares.

    copies, at most most_rate rounded up, is how often the row goes into the mix. Null and empty texts have no tokens
    and do not bear on the totals; their posteriors are those of a text without features. Repeated rows count each,
    and have equal rates; a null doc_id is as any other; labels of unknown or null doc_ids are not used. An empty table
    gives an empty one; without labels all domains are equally likely. Other columns are not read.
    """
    model = fit_classifier(docs, labels)
    members = materialize(with_memberships(docs, model, [F.col("doc_id")]), "members")
    rate = rate_of(fit_rates(members, targets or TARGETS, most_rate=most_rate), most_rate=most_rate)
    return members.select("*", rate.alias("rate")).withColumn("copies", copies_of(F.col("rate")))


def mixed(docs: DataFrame, labels: DataFrame, labelled_docs: DataFrame | None = None, targets: dict[str, float] | None = None, most_rate: float = MOST_RATE) -> DataFrame:
    """The rows of docs as often as their rates say, with the columns of docs.

    labelled_docs holds the texts that labels speak of, docs unless given. No row shuffles. Rows are written with their
    posteriors, so these are computed once; the rounds read only the columns of numbers. Nulls, empty texts, repeats,
    empty tables and columns of any name are as in mixing_rates.
    """
    model = fit_classifier(docs if labelled_docs is None else labelled_docs, labels)
    members = materialize(with_memberships(docs, model, [F.col("doc_id"), row_struct(docs).alias("row")]), "members")
    rate = rate_of(fit_rates(members, targets or TARGETS, most_rate=most_rate), most_rate=most_rate)
    rows = members.withColumn("copies", copies_of(rate)).where("copies > 0")
    rows = rows.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row"))
    return rows.select(*(field("row", c) for c in docs.columns))
