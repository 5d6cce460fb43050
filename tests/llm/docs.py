"""Fixtures of the corpus operators: documents with every kind of trouble."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with further columns whose names the operators use inside.
CLASHING = SCHEMA + ", row string, keep_id long, kept boolean, block long, k long, id long, n long, tokens long, rate double, copies int, at string, `a.b` string, hits string, words string, part int, length long, gone long, component_id long, _cell long"


def words(rng: random.Random, n: int, of: int = 400) -> list[str]:
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def texts(seed: int = 7) -> list[str | None]:
    """Near copies at all similarities, exact copies but for white space, shared lines, and odd texts."""
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t", "one", "one two three four", "ONE two  three\nfour", "a b c d e", "A b c d e f"]
    for n in (3, 12, 30, 80, 200, 400):
        base = words(rng, n)
        out.append(" ".join(base))
        for rate in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            other = [w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in base]
            out.append(" ".join(other[rng.randrange(2) :]))
        out.append("  ".join(base) + "\n")
        out.append(" ".join(base).upper())
        out.append(" ".join(base + words(rng, n // 6)))
    passage = words(rng, 60)
    out += [" ".join(words(rng, rng.randrange(20, 90)) + passage + words(rng, rng.randrange(20, 90))) for _ in range(25)]
    shared = ["This line is in many documents", "  THIS LINE is in many documents\t", "short", "- - - - - - - -"]
    out += ["\n".join([*(rng.choice(shared) for _ in range(4)), " ".join(words(rng, 15)), "the same twice", "the same twice"]) for _ in range(15)]
    out += ["mail a.b@c.example.org or +1 (663) 555-6869, card 4111 1111 1111 1111 at 10.2.3.4", "x @ y 999.1.1.1 4111111111111112", "é" * 9 + " 12", "é" * 10 + "\n" + "é" * 10]
    out.append(" ".join(words(rng, 30000, 5000)))
    out.append("z" * 200_000)
    return out


def rows(seed: int = 7) -> list[tuple]:
    found = [(i * 3 % 1009, t, "en", "hot" if i % 3 else "s", None if t is None else len(t)) for i, t in enumerate(texts(seed))]
    random.Random(seed).shuffle(found)
    return found


def documents(spark, clashing: bool = False):
    data = rows()
    if clashing:
        return spark.createDataFrame([(*r, "x", 1, True, 1, 2, 3, 4, 5, 0.5, 6, "y", "dot", "h", "w", 7, 8, 9, 10, 11) for r in data], CLASHING).repartition(5)
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
