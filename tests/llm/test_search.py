"""Ranked search, conversation repair and decontamination against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from presswork.llm import conversations as conv
from presswork.llm import ranked_search as ranked
from presswork.llm.decontaminate import decontaminate

from .docs import documents, empty, rows

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id long, text string, n long, window string, q int, terms string"


def low(text):
    return (text or "").translate(LOWER)


def items_table(spark, data):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in data], ITEM).repartition(3)


# ---- ranked search
def brute_search(data, items, top):
    docs = [(d, Counter(low(x) for x in TERM.findall(t or ""))) for d, t, *_ in data]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_docs, length = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        terms = {low(x) for x in TERM.findall(text or "")}
        found = []
        for d, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:top])]
    return Counter(out)


def queries(data):
    rng = random.Random(3)
    some = [(None if t is None else " ".join(rng.sample(t.split(), min(6, len(t.split()))))) for _, t, *_ in data]
    return [*((i, t) for i, t in enumerate(some)), (900, None), (901, " .,"), (902, "NoSuchTerm"), (903, "w1 W1 w2"), (903, "w3"), (None, "w4 w5"), (904, " ".join(f"w{i}" for i in range(400)))]


@pytest.mark.parametrize("top, width, block, share", [(5, 1024, 1 << 18, 4), (3, 1, 50, 1), (50, 64, 1 << 18, 16)])
def test_search(spark, top, width, block, share):
    """Sketches of one coordinate bound badly, and small blocks split the queries: the result is the same."""
    data = [*rows(), (None, "w4 w5 w6", "", "", 0), (None, "w4 w5 w6", "", "", 0), (5, "w4 w5 w6", "", "", 0), (5, "w4 w5 w6", "", "", 0)]
    docs = spark.createDataFrame([(*r, "x", 2) for r in data], "doc_id long, text string, lang string, source string, n_chars long, terms string, n int").repartition(5)
    items = queries(data)
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked.search(docs, items_table(spark, items), top, width, block, share).collect())
    assert got == brute_search(data, items, top)


def test_search_empty(spark):
    assert ranked.search(empty(spark), items_table(spark, [(1, "a")])).count() == 0
    assert ranked.search(documents(spark), items_table(spark, [(1, "a")]).where("false")).count() == 0
    assert ranked.search(documents(spark), items_table(spark, [(1, " -")])).count() == 0


def test_bounds_hold(spark):
    """No sketch bounds a document below its score."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    terms = [np.sort(rng.choice(300, 40, replace=False)).astype("int32") for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"n": pa.array(rng.integers(40, 900, 50)), "terms": pa.array([t.tolist() for t in terms], pa.list_(pa.int32())), "tfs": pa.array([rng.integers(1, 9, 40).tolist() for _ in terms], pa.list_(pa.int32()))})
    asked = [np.sort(rng.choice(300, 12, replace=False)).astype("int64") for _ in range(20)]
    scorer = ranked.Scorer(asked, rng.integers(1, 50, 300), 50, 9000, 16)
    scorer.load(batch)
    for q in range(20):
        assert (scorer.bounds[:, q] >= scorer.exact(np.arange(50), q)).all()


# ---- conversation repair
def solid(text):
    return text.rstrip(" \t\n\x0b\x0c\r")


def brute_repair(rows_of):
    """All cheapest edits by search over every sequence of edits, for short conversations."""
    seen, flagged = set(), []
    for turn, role, text in rows_of:
        s = solid(text)
        fault = "blank" if not s else "duplicate" if (role, text) in seen else "truncated" if s[-1] not in ".!?" else ""
        seen.add((role, text))
        flagged.append((turn, role, text, fault))
    turns = [t for t, *_ in rows_of if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(flagged)]
    best = {(0, ""): (0, "", ())}  # (row, roles so far as a state) -> cheapest; states by the initials' grammar

    def step(state, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, c))

    todo = [(0, "", 0, "", ())]
    while todo:
        todo.sort()
        cost, audit, at, state, made = todo.pop(0)
        if at == len(flagged) and state in ("", "a"):
            break
        if best.get((at, state, "done"), (cost, audit)) < (cost, audit):
            continue
        best[at, state, "done"] = (cost, audit)
        for role in ("user", "assistant"):
            if step(state, role[0]):
                todo.append((cost + 2, audit + "I", at, step(state, role[0]), (*made, f"{role}:")))
        if at < len(flagged):
            _, role, text, fault = flagged[at]
            todo.append((cost + 3, audit + "D", at + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for new, edit, price in ((role, "K", 0), ("user", "R", 2), ("assistant", "R", 2)):
                    if step(state, new[:1]):
                        todo.append((cost + price + more, audit + edit, at + 1, step(state, new[:1]), (*made, f"{new}:{text}")))
    count = Counter(f[3] for f in flagged)
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


def expected(data):
    groups = {}
    for c, turn, role, text, *_ in data:
        groups.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {c: brute_repair(sorted(g, key=order)) for c, g in groups.items()}


TURNS = "conv_id long, turn long, role string, text string, conv string, head boolean, digest string, place int"


def turns_table(spark, data):
    return spark.createDataFrame([(*r, "x", True, "y", 3) for r in data], TURNS).repartition(4)


def made_turns(seed, n=120):
    rng = random.Random(seed)
    data = []
    for c in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \n\t", None, f"Text {rng.randrange(99)}.", "same?", "é. "])
            for _ in range(1 + (rng.random() < 0.15)):
                data.append((c if c else None, rng.choice([turn, turn, turn * 3, None]), role, text))
    return data


REPORTED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair(spark):
    data = made_turns(1)
    got = {r["conv_id"]: tuple(r[c] for c in REPORTED) for r in conv.repair(turns_table(spark, data), digest=True).collect()}
    assert got == expected(data)


def test_repaired_rows(spark):
    """The repaired rows are those of the digest, and their initials follow the grammar."""
    data = made_turns(2, 60)
    out = {}
    for r in conv.repair(turns_table(spark, data)).collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for c, want in expected(data).items():
        found = sorted(out.get(c, []))
        assert [f[0] for f in found] == list(range(len(found)))
        assert re.fullmatch("(s?(ua)+)?", "".join(f[1][:1] for f in found))
        assert hashlib.sha256("\n".join(f"{f[1]}:{f[2]}" for f in found).encode()).hexdigest() == want[-1]


def test_repair_of_a_very_long_conversation(spark):
    """One conversation holds nearly all rows; its signature comes in pieces from several tasks and batches."""
    n = 6000
    data = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(n) if t % 1000 != 999] + [(8, 1, "user", "a")]
    got = {r["conv_id"]: r for r in conv.repair(turns_table(spark, data), digest=True).collect()}
    assert got[8]["audit"] == "D" and got[8]["cost"] == 3 and got[7]["gaps"] == 5  # the last turn is missing too
    assert got[7]["illegal"] == 5 and got[7]["cost"] == 2 * 6 and got[7]["audit"].count("I") == 6
    made = "".join(f[1][:1] for f in sorted((r["place"], r["role"]) for r in conv.repair(turns_table(spark, data)).where("conv_id = 7").collect()))
    assert made == "ua" * (n // 2)


def test_damage_and_lost_conversations(spark):
    ids = [(c, t) for c in [*range(40), None] for t in [*range(4), None]]
    data = [(c, t, "user" if (t or 0) % 2 == 0 else "assistant", f"Row {t}. Really? yes") for c, t in ids]
    told = lambda v: " " if v is None else str(v)
    want = []
    for c, t, role, text in data:
        k = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        if k:
            want += [(c, t, "user" if k == 4 else role, "" if k == 1 else text.replace(".", "").replace("?", "") if k == 2 else text)] * (1 + (k == 3))
    table = turns_table(spark, data)
    hurt = conv.damaged(table)
    assert Counter(tuple(r) for r in hurt.collect()) == Counter(want)
    got = {r["conv_id"]: tuple(r[c] for c in REPORTED) for r in conv.repair(hurt.where("conv_id <> 5"), table.select("conv_id"), digest=True).collect()}
    assert got == expected([w for w in want if w[0] not in (5, None)]) | dict.fromkeys((5, None), (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_repair_empty(spark):
    assert conv.repair(turns_table(spark, made_turns(1, 2)).where("false"), digest=True).count() == 0


def test_suffixes_are_worked_once():
    """The decisions of the automaton are made once for each symbol and outlook, however many words there are."""
    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    words = sorted(set(words), key=lambda w: w[::-1])
    out = list(conv._plan(iter([pa.RecordBatch.from_pydict({"plain": words[:1000]}), pa.RecordBatch.from_pydict({"plain": words[1000:]})])))
    assert sum(b.num_rows for b in out) == len(words)
    plans = conv.Plans()
    for w in words:
        outlook = plans.end[1]
        for symbol in reversed(w):
            outlook = plans.before(symbol, outlook)[1]
    assert len(plans.known) < 400


# ---- decontamination
def brute_hits(data, items):
    wins = set()
    for item, text in items:
        ws = WORD.findall(low(text))
        for s in range(max(1, len(ws) - 9)) if ws else ():
            wins.add(("" if item is None else str(item), tuple(ws[s : s + 10])))
    of_window = {}
    for item, w in wins:
        of_window.setdefault(w, set()).add(item)
    sizes = {len(w) for w in of_window}
    out = []
    for doc, text, *_ in data:
        ws = WORD.findall(low(text))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                w = tuple(ws[s : s + n])
                if w in of_window:
                    hit |= set(range(s, s + n))
                    found |= of_window[w]
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def leaked():
    rng = random.Random(11)
    texts = [t for _, t, *_ in rows() if t and len(t.split()) > 12]
    items = [(k, " ".join(t.split()[a : a + rng.choice([1, 2, 4, 5, 7, 10, 11, 30])])) for k, t in enumerate(rng.sample(texts, 25)) for a in [rng.randrange(max(1, len(t.split()) - 30))]]
    phrase = "in the very same words of an item that is said twice".split()
    items += [(100, " ".join(phrase)), (100, "Other words, with THIS id!"), (101, " ".join([*phrase, "and", "more"])), (None, "é é é"), (102, None), (103, " ,. "), (104, "zq " * 12), (105, "w1 w2 w3 w4 w5 w6 w7 w8 no such")]
    data = [*rows(), (2000, " ".join(phrase[:10]), "", "", 0), (2001, f"x. {' '.join(phrase).upper()}, y", "", "", 0), (2002, "zq " * 40, "", "", 0), (2003, "zq " * 9, "", "", 0), (None, "É é é é é", "", "", 0), (2004, " ".join(phrase[:9]), "", "", 0)]
    return data + data[-6:-4] + data[-2:-1], items


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontaminate(spark, most):
    """Items of all lengths; with the shingles broadcast, and by a bitmap."""
    data, items = leaked()
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in data], "doc_id long, text string, lang string, source string, n_chars long, window string, r1 int, pos int").repartition(5)
    out = decontaminate(docs, items_table(spark, items), most_broadcast=most)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect())
    assert got == brute_hits(data, items)


def test_decontaminate_empty(spark):
    assert decontaminate(empty(spark), items_table(spark, [(1, "a b")])).count() == 0
    none = decontaminate(documents(spark), items_table(spark, [(1, "a")]).where("false")).collect()
    assert len(none) == len(rows()) and not any(r["contaminated"] for r in none)
