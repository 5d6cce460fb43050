"""Exact dedup, line dedup and the n-gram Jaccard join against brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest

from presswork.llm import exact_dedup as exact
from presswork.llm import jaccard_join as jaccard
from presswork.llm import line_dedup as line
from presswork.llm.common import connected_components, join_groups, materialize

from .docs import SCHEMA, documents, empty, rows

WHITE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_exact(data):
    groups = collections.defaultdict(list)
    for doc, text, *_ in data:
        groups[WHITE.sub("", text or "")].append((doc, text or ""))
    out = {}
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))[0]
        for doc, _ in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("carry", [False, True])
def test_exact(spark, clashing, carry):
    got = exact.exact_dedup(documents(spark, clashing), carry).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == brute_exact(rows())
    assert len(got) == len(rows())


@pytest.mark.parametrize("bits", [1, 64])
def test_exact_when_the_filter_is_full(spark, bits):
    """A filter far too small lets single rows through, and changes nothing else."""
    got = exact.exact_dedup(documents(spark), bits_per_row=bits, most_bits=1 << 15).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {d: v[0] for d, v in brute_exact(rows()).items()}


def test_exact_null_and_repeated_ids(spark):
    data = [(None, "a b", None, None, None), (5, "ab", None, None, None), (5, "ab", None, None, None), (2, "a b", None, None, None), (None, "zz", None, None, None), (-(2**63), "q", None, None, None), (7, " q", None, None, None)]
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact.exact_dedup(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == sorted([("None", "2", 4, False), ("5", "2", 4, False), ("5", "2", 4, False), ("2", "2", 4, True), ("None", "None", 1, True), (str(-(2**63)), "7", 2, False), ("7", "7", 2, True)])


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark, clashing=True)
    out = exact.drop_copies(docs)
    assert out.schema == docs.schema
    assert {r["doc_id"] for r in out.collect()} == {v[0] for v in brute_exact(rows()).values()}


def test_drop_copies_keeps_one_of_repeated_rows(spark):
    data = [(5, "same", "c"), (5, "same", "c"), (None, "x y", "c"), (None, "xy", "c"), (None, "x y", "c"), (7, "k l", "c"), (7, "k  l", "c"), (7, "kl", "d"), (9, "kl", "e"), (None, None, "f"), (8, "", "g"), (8, " ", "g")]
    docs = spark.createDataFrame(data, "doc_id long, text string, `a.b` string").repartition(3)
    got = collections.Counter((r["doc_id"], r["text"]) for r in exact.drop_copies(docs).collect())
    assert got == {(5, "same"): 1, (None, "x y"): 1, (7, "k  l"): 1, (8, " "): 1}
    twice = spark.createDataFrame([(1, "a", "b"), (None, "c", "d")] * 3, docs.schema)
    assert sorted(str(r["doc_id"]) for r in exact.drop_copies(twice).collect()) == ["1", "None"]


def key_of(text):
    return text.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(data):
    holders = collections.defaultdict(set)
    for doc, text, *_ in data:
        for x in (text or "").split("\n"):
            holders[key_of(x)].add(float("inf") if doc is None else doc)
    out = {}
    for doc, text, *_ in data:
        lines, me = (text or "").split("\n"), float("inf") if doc is None else doc
        kept = [x for x in lines if len(key_of(x)) < 10 or len(holders[key_of(x)]) < 2 or min(holders[key_of(x)]) == me]
        out[doc] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("per_shard", [100_000, 200, 5])
def test_lines(spark, per_shard):
    """One shard; several; and several with heavy lines apart."""
    got = line.line_dedup(documents(spark, clashing=True), probes_per_shard=per_shard).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in got} == brute_lines(rows())
    assert all(r["kept_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() for r in got)


def test_lines_null_and_repeated_ids(spark):
    long = "a line long enough"
    data = [(None, long, None, None, None), (None, long + "\nshort", None, None, None), (4, f"{long}\n{long.upper()} ", None, None, None), (9, "only here 123", None, None, None), (9, "only here 123", None, None, None)]
    got = collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line.line_dedup(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == {(None, 1, 1, ""): 1, (None, 2, 1, "short"): 1, (4, 2, 0, f"{long}\n{long.upper()} "): 1, (9, 1, 0, "only here 123"): 2}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    made = line.PerfectHash.build(a, b)
    made = line.PerfectHash.load(*made.dump())
    assert sorted(made.index(a, b)) == list(range(n))
    assert n < 1000 or len(made.bits) < 5 * n
    other = made.index(a ^ np.uint64(1), b)
    assert ((other >= -1) & (other < max(n, 1))).all()


def shingles(text):
    found = [w for w in WHITE.split((text or "").translate(LOWER)) if w]
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)}


def brute_components(data):
    sets = [shingles(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, *_) in enumerate(data):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return collections.Counter((doc, len(sets[i]), least.get(top(i)) if sets[i] else doc) for i, (doc, *_) in enumerate(data))


@pytest.mark.parametrize("clashing, per_bucket", [(False, 2048), (True, 20)])
def test_jaccard(spark, clashing, per_bucket):
    got = jaccard.jaccard_components(documents(spark, clashing), per_bucket).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows())


def test_jaccard_bridges_and_null_ids(spark, monkeypatch):
    """A chain where the ends do not link, seen through blocks of two and a row without doc_id in the middle."""
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    base = [f"v{i}" for i in range(104)]
    chain = [" ".join(base[:k] + [f"new{i}" for i in range(k, 104)] if k < 104 else base) for k in (104, 94, 85, 76, 67, 58)]
    data = [(None if i == 2 else 10 - i, t, None, None, None) for i, t in enumerate(chain)] + [(None, "", None, None, None), (None, "alone here", None, None, None), (3, chain[0], None, None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(data)


def test_prefix_tree_is_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > p], rng.integers(0, 2**63, int(p * 100), dtype=np.uint64)])) for p in rng.random(80) * 0.25]
    sets += [np.zeros(0, np.uint64), base[:1], base, base]
    tree = jaccard.PrefixTree(sets)
    for x in sets:
        wanted = (rng.random(len(sets)) < 0.7).tolist()
        expected = {i for i, y in enumerate(sets) if len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert set(tree.linked(x)) == expected
        assert set(tree.linked(x, wanted)) == {i for i in expected if wanted[i]}


def test_linked_sets_keep_a_common_signature():
    """The claim that the join rests on, for sets of all sizes: see signatures()."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(8):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = int(rng.integers(0, len(x) // 4 + 1))
            cut = int(rng.integers(0, most + 1))
            y = np.unique(np.concatenate([x[rng.permutation(len(x))[cut:]], rng.integers(0, 2**64, most - cut, dtype=np.uint64)]))
            if not len(y) or 100 * len(np.intersect1d(x, y)) < 80 * len(np.union1d(x, y)):
                continue
            a, b = ({how % 64: (set(s.tolist()), how // 64) for s, how in jaccard.signatures(z)} for z in (x, y))
            both = set(a) & set(b)
            assert any(len(a[v][0] & b[v][0]) >= max(1, min(a[v][1], b[v][1])) for v in both)


def test_drop_near_copies(spark):
    docs = documents(spark, clashing=True)
    out = jaccard.drop_near_copies(docs)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, _, c in brute_components(rows()) if d == c)


def test_drop_near_copies_null_and_repeated_ids(spark):
    """Each component keeps one row, whatever else has its doc_id or lacks one too."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    groups = [
        [(1, a), (None, near(a))],
        [(None, "clean and alone")],
        [(3, b), (7, near(b))],
        [(7, c)],
        [(None, d), (None, near(d)), (None, d)],
        [(9, e), (9, e), (9, near(e)), (9, e.upper())],
        [(12, f), (11, near(f)), (11, "  " + f)],
        *([(doc, "")] for doc in (None, None, 9, 3)),
    ]
    docs = spark.createDataFrame([(doc, t, f"g{i}", None, None) for i, g in enumerate(groups) for doc, t in g], SCHEMA).repartition(3)
    out = jaccard.drop_near_copies(docs)
    assert out.schema == docs.schema
    kept = out.collect()
    got = {r["lang"]: (r["doc_id"], r["text"]) for r in kept}
    assert len(kept) == len(groups)
    assert all(got[f"g{i}"] in g for i, g in enumerate(groups))
    assert [got[f"g{i}"][0] for i in range(7)] == [1, None, 3, 7, None, 9, 11]


def test_drop_near_copies_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    data = [(3, text, "c")] * 3 + [(None, text + " end", "c")] * 2 + [(None, "one two three four five six seven", "n")] * 2 + [(6, "quite another text than all of the others", "m")] * 2
    out = jaccard.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string, `a.b` string").repartition(3))
    assert sorted((str(r["doc_id"]), r["a.b"]) for r in out.collect()) == [("3", "c"), ("6", "m"), ("None", "n")]


def test_empty_tables(spark):
    assert exact.exact_dedup(empty(spark)).count() == 0
    assert line.line_dedup(empty(spark)).count() == 0
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_components_and_hot_groups(spark):
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 for i in range(31)}
    left = spark.range(5000).selectExpr("id", "if(id < 4000, 0, id) as k")
    groups = materialize(left.groupBy("k").count().withColumnRenamed("count", "n"), "g")
    assert join_groups(left, groups, "k", "n").count() == 5000


@pytest.mark.parametrize("block", [8, 256])
def test_jaccard_family_of_half_similar_texts(spark, monkeypatch, block):
    """A family where some texts link with many, some with one another only, and some with nothing but share signatures;
    seen through small blocks it gives the components of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in range(150)]
    data = []
    for i in range(40):
        share = rng.choice([0.005, 0.02, 0.04, 0.05, 0.08])
        data.append((int(i), " ".join(w if rng.random() > share else f"n{rng.integers(10**6)}" for w in base), None, None, None))
    data += [(100 + i, data[i][1] + " tail", None, None, None) for i in range(0, 40, 9)]
    got = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    expected = brute_components(data)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert 5 < len({c for _, _, c in expected}) < 40
