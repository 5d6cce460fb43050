"""Conversation structure repair: cheapest edits over the suffix-shared automaton of role and fault signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import WHITE, join_groups, materialize

ROLES, FAULTS = "suao", ("none", "blank", "duplicate", "truncated")
#: A row's symbol: role initial s, u, a or another, times its fault, from A on.
SYMBOLS = "".join(chr(65 + i) for i in range(16))
#: What the edits depend on: x must go; else the role, in upper case where the row is truncated.
PLAIN = "".join("x" if f in (1, 2) else ROLES[r].upper() if f == 3 else ROLES[r] for r in range(4) for f in range(4))
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_ENDLESS = 1 << 40
#: States: nothing yet, after the system row, an assistant is due, a user may follow or the end.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)
_PLACE = ["conv", "turn", "role", "digest"]  # ascending order puts nulls first


class Plans:
    """Cost-to-go and best first edits of every state, once for each symbol and outlook.

    An outlook is what a node of the automaton means to those before it: its states' costs less the least of them, and
    the order of their best audits. Nodes of equal outlook are merged, so a symbol before any of them is worked once; two
    audits are compared by their first edits and then by that order, never in full.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.end = self._settle([(0, "", 0), (_ENDLESS, "", 1), (_ENDLESS, "", 2), (0, "", 3)], (0, 0, 0, 0))

    @staticmethod
    def _settle(base: list[tuple], order: tuple) -> tuple:
        """(least cost, outlook, first edits and the state after them of each state), with insertions before the row."""
        rank = lambda x: (x[0], x[1], order[x[2]])
        insert = lambda x: (x[0] + INSERT, "I" + x[1], x[2])
        two, three = min(base[2], insert(base[3]), key=rank), min(base[3], insert(base[2]), key=rank)
        best = [min(base[0], insert(two), key=rank), min(base[1], insert(two), key=rank), two, three]
        least = min(b[0] for b in best)
        audits = sorted({(b[1], order[b[2]]) for b in best})
        outlook = tuple(min(b[0] - least, _ENDLESS) for b in best), tuple(audits.index((b[1], order[b[2]])) for b in best)
        return least, outlook, tuple((b[1], b[2]) for b in best)

    def before(self, symbol: str, outlook: tuple) -> tuple:
        if (symbol, outlook) not in self.known:
            costs, order = outlook
            role, more = symbol.lower(), TRUNCATED * symbol.isupper()
            base = []
            for q in range(4):
                found = [(costs[q] + DELETE, "D", q)]
                if role != "x":
                    found.append((costs[_NEXT[q]] + REROLE + more, "R", _NEXT[q]))
                    if role in _KEEP[q]:
                        found.append((costs[_KEEP[q][role]] + more, "K", _KEEP[q][role]))
                base.append(min(found, key=lambda x: (x[0], x[1], order[x[2]])))
            self.known[symbol, outlook] = self._settle(base, order)
        return self.known[symbol, outlook]


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures, sorted from their ends, with cost and audit. The nodes of the suffix that a signature shares with the
    one before stay on the path, so each suffix of the task is worked once and memory is that of one signature."""
    plans, last = Plans(), ""
    path = [plans.end]  # path[k] stands for the last k symbols
    total = [plans.end[0]]
    for b in batches:
        costs, audits = [], []
        for plain in b.column(0).to_pylist():
            ends = plain[::-1]
            shared = 0
            while shared < min(len(ends), len(last)) and ends[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :], total[shared + 1 :]
            for symbol in ends[shared:]:
                path.append(plans.before(symbol, path[-1][1]))
                total.append(total[-1] + path[-1][0])
            state, edits = 0, []
            for node in reversed(path):
                edit, state = node[2][state]
                edits.append(edit)
            costs.append(total[-1] + path[-1][1][0][0])
            audits.append("".join(edits))
            last = ends
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], ["plain", "cost", "audit"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows(conv, kind, fault, first, n) as pieces of signatures, one for each conversation and batch."""
    part, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        if not b.num_rows:
            continue
        kind, fault, n = (b[c].to_numpy() for c in ("kind", "fault", "n"))
        first = b["first"].to_numpy(zero_copy_only=False)
        again = kind * 4 + np.where(fault == 1, 1, 2)
        codes = np.repeat(again, n)
        at = np.concatenate([[0], np.cumsum(n)])
        codes[at[:-1]] = np.where(first, kind * 4 + fault, again)
        letters = (codes + 65).astype(np.uint8).tobytes().decode()
        conv = b["conv"].to_numpy(zero_copy_only=False)
        heads = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]])
        some = [letters[at[i] : at[k]] for i, k in zip(heads[:-1], heads[1:], strict=True)]
        order = pa.array(range(seq, seq + len(some)), pa.int64())
        seq += len(some)
        yield pa.RecordBatch.from_arrays([pa.array(conv[heads[:-1]], pa.string()), pa.array([part] * len(some), pa.int32()), order, pa.array(some, pa.string())], ["conv", "part", "seq", "piece"])


def _rows(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with a key of the conversation, and nulls of role and text as one blank."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select(conv.alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), *text).withColumn("digest", F.unhex(F.md5("text")))


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps) of every conversation with rows. No text shuffles: rows go by their digests, equal ones as
    one with a count; a global sort spreads even one conversation over tasks, which give pieces of its signature."""
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(solid == "", 1).when(~F.right(solid, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    kind = F.coalesce(*(F.when(F.substring("role", 1, 1) == r, i) for i, r in enumerate("sua")), F.lit(3))
    narrow = rows.select("conv", "turn", "role", "digest", kind.alias("kind"), fault.alias("fault"))
    narrow = materialize(narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n")), "turns")

    same = F.md5(F.concat_ws("\0", "conv", "role", F.hex("digest"))).alias("same")
    seen = narrow.where("fault <> 1").groupBy(same).agg(F.min(F.struct("turn"))["turn"].alias("first_turn"), F.count("*").alias("turns"))
    seen = materialize(seen.where("turns > 1"), "seen-texts")
    known = join_groups(narrow.withColumn("same", same), seen, "same", "turns", "left")
    first = F.col("turns").isNull() | F.col("turn").eqNullSafe(F.col("first_turn"))
    ready = materialize(known.select("conv", "turn", "role", "digest", "kind", "fault", "n", first.alias("first")), "marked-turns")
    ordered = ready.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    pieces = ordered.select("conv", "kind", "fault", "n", "first").mapInArrow(_encode, "conv string, part int, seq long, piece string")
    in_order = F.array_sort(F.collect_list(F.struct("part", "seq", "piece")))
    whole = pieces.groupBy("conv").agg(F.array_join(F.transform(in_order, lambda p: p["piece"]), "").alias("signature"))
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = narrow.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).alias("gaps"))
    return whole.join(gaps.hint("merge"), "conv")


def plans(conversations: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation; see repair."""
    found = materialize(_signatures(_rows(conversations)).withColumn("plain", F.translate("signature", SYMBOLS, PLAIN)), "signatures")
    kinds = materialize(found.groupBy("plain").agg(F.count("*").alias("convs")), "automaton-words")
    ends = F.reverse("plain")
    best = kinds.repartitionByRange(ends).sortWithinPartitions(ends).select("plain").mapInArrow(_plan, "plain string, cost long, audit string")
    best = materialize(best.join(kinds.hint("merge"), "plain"), "plans")
    x = join_groups(found, best, "plain", "convs")
    count = lambda of: (F.length("signature") - F.length(F.translate("signature", "".join(SYMBOLS[4 * r + of] for r in range(4)), ""))).cast("long")
    roles = F.translate("signature", SYMBOLS, "".join(r * 4 for r in ROLES))
    legal = sum((F.length(roles) - F.length(F.replace(roles, F.lit(p), F.lit("")))) / 2 for p in ("su", "ua", "au"))
    illegal = (F.greatest(F.length("signature") - 1, F.lit(0)) - legal).cast("long")
    return x.select("conv", "gaps", count(1).alias("blank"), count(2).alias("duplicate"), count(3).alias("truncated"), illegal.alias("illegal"), "cost", "audit")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Edited:
    """The rows of one conversation, edited as they come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place, self.system = audit, 0, 0, 0

    def due(self) -> str:
        return ("user", "assistant")[(self.place - self.system) % 2]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield self.due(), ""
            self.at, self.place = self.at + 1, self.place + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "K" and not self.place and role[:1] == "s":
            self.system = 1
        yield (self.due() if edit == "R" else role), text
        self.place += 1


def _apply(schema: pa.Schema, digest: bool):
    """Conversations in order, each behind its head row, as repaired rows or as one row with the digest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, edited, sha, made = None, None, None, []

        def take(pairs) -> None:
            for role, text in pairs:
                if digest:
                    sha.update((("\n" if edited.place else "") + f"{role}:{text}").encode())
                else:
                    made.append({"conv_id": head["conv_id"], "place": edited.place, "role": role, "text": text})

        def close() -> None:
            if head is not None:
                take(edited.inserted())
                if digest:
                    made.append(head | {"repaired_sha256": sha.hexdigest()})

        for b in batches:
            for r in b.to_pylist():
                if r["head"]:
                    close()
                    head, edited, sha = {k: r[k] for k in ("conv_id", "audit", *REPORT)}, _Edited(r["audit"]), hashlib.sha256()
                else:
                    take(edited.row(r["role"], r["text"]))
            if made:
                yield pa.RecordBatch.from_pylist(made, schema)
                made.clear()
        close()
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return run


def repair(conversations: DataFrame, ids: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """The repaired rows (conv_id, place, role, text) of conversations(conv_id, turn, role, text); or with digest=True a row
    for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows go by turn, a null turn first; rows of equal turn by role, then by the MD5 of their text. Rows that repeat are
    rows of their own, each a duplicate of the first. Null roles and texts count as one blank; a null conv_id is one
    conversation. ids(conv_id) names further conversations to report, which have no rows: zeros, and nothing to repair.
    An empty table gives no rows. Other columns are not read.

    1. A row is its role's initial and its first fault; a conversation is the word of its rows. 2. Distinct words, sorted
       from their ends, form an automaton whose nodes are the suffixes that they share; cost-to-go and best audit of each
       grammar state are worked once a node (Plans). 3. The audits go back to the conversations, and their rows follow
       behind them in order through one task, as the digest of a conversation is a chain; what a task holds is a
       batch of rows and an audit, however long the conversation.
    """
    rows = _rows(conversations)
    planned = materialize(plans(conversations), "conversation-plans")
    known = rows.select("conv", "conv_id").distinct()
    if ids is not None:
        conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
        known = known.unionByName(ids.select(conv.alias("conv"), F.col("conv_id").cast(rows.schema["conv_id"].dataType).alias("conv_id"))).distinct()
    heads = known.join(planned.hint("merge"), "conv", "left")
    heads = heads.select("conv", "conv_id", F.lit(True).alias("head"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in REPORT), F.coalesce("audit", F.lit("")).alias("audit"))
    both = heads.unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", F.desc("head"), *_PLACE[1:])
    kept = both.select("conv_id", "head", "role", "text", "audit", *REPORT)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, " + (", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string" if digest else "place long, role string, text string")
    return kept.mapInArrow(_apply(to_arrow_schema(StructType.fromDDL(out)), digest), out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn` modulo 20, nulls as one blank:
    0 drops the row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes its role user."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    k = F.crc32(F.concat(told[0], F.lit(":"), told[1])) % 20
    x = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return x.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
