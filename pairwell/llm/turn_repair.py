"""Repair of conversations by a grammar-compressed dynamic program.

A conversation's rows become letters, one for each role class and fault. The letters of many conversations are
compressed together by Re-Pair: the most frequent pair of neighbouring symbols becomes a rule, again and again.
Each rule has one min-plus transfer matrix over the four states of the role pattern (s?(ua)+)?: the cheapest
edits that lead from one state to another, with a rope that spells them. A rule's matrix is the product of its two
symbols' matrices, so rules are evaluated bottom-up, once for all conversations that share them.

Ties go to the least audit in ASCII order. Two audits of the same rows to different states end in a row's
letter and hold as many such letters, so neither begins the other; the order of the left parts then decides, and
a matrix keeps only the rank of each entry in its row, never compares strings.

A conversation's letters are written in pieces by a range sort, which splits anywhere; only they (a byte a row, as
the audit itself) meet in one place. Texts stream past their conversation's audit in row order to be hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import cut, text_key, written

KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: States of the pattern: nothing yet, after s, after u, after a. What an inserted or rewritten row leads to, and its role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Letters of rows: 4 times the class of the role (s, u, a, other) plus the fault.
LETTERS = "ABCDEFGHIJKLMNOP"
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETED = 8  # the symbol of all rows that must go; others are 2 * class + truncated
#: Rules of a grammar, and letters of one piece of a conversation.
RULES, PIECE = 1024, 1 << 14
WHITE = " \t\n\x0b\x0c\r"


class Rope:
    """An audit as a tree: a string, or two ropes."""

    __slots__ = ("left", "right")

    def __init__(self, left: Any, right: Any):
        self.left, self.right = left, right

    def spell(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += [x.right, x.left]
        return "".join(out)


class Matrix:
    """Of each pair of states the least cost (None: no way), its rope, and its rank by audit among those from the same state."""

    __slots__ = ("cost", "rank", "rope")

    def __init__(self) -> None:
        self.cost: list[list[int | None]] = [[None] * 4 for _ in range(4)]
        self.rope: list[list[Any]] = [[None] * 4 for _ in range(4)]
        self.rank = [[0] * 4 for _ in range(4)]

    def times(self, other: Matrix) -> Matrix:
        out = Matrix()
        for i in range(4):
            ways: list[tuple[int, int, int]] = []  # rank of the left part, of the right part, end
            for j in range(4):
                best = None
                for m in range(4):
                    a, b = self.cost[i][m], other.cost[m][j]
                    if a is not None and b is not None and (best is None or (a + b, self.rank[i][m]) < best[:2]):
                        best = (a + b, self.rank[i][m], m)
                if best is not None:
                    m = best[2]
                    out.cost[i][j], out.rope[i][j] = best[0], Rope(self.rope[i][m], other.rope[m][j])
                    ways.append((best[1], other.rank[m][j], j))
            for k, (_, _, j) in enumerate(sorted(ways)):
                out.rank[i][j] = k
        return out


def row_matrix(symbol: int) -> Matrix:
    """What one row can do, insertions before it included."""
    out = Matrix()
    kind, truncated = divmod(symbol, 2)
    for i in range(4):
        best: dict[int, tuple[int, str]] = {}
        state, prefix = i, ""
        for _ in range(3):  # more insertions than two only repeat a state
            ends = [(state, DELETE, COST[DELETE])]
            if symbol != DELETED:
                ends.append((NEXT[state], REROLE, COST[REROLE] + truncated))
                kept = SYSTEM if kind == 0 and state == START else kind + 1 if kind in (1, 2) and NEXT[state] == kind + 1 else None
                if kept is not None:
                    ends.append((kept, KEEP, COST[KEEP] + truncated))
            for j, edit, cost in ends:
                way = (cost + COST[INSERT] * len(prefix), prefix + edit)
                best[j] = min(best.get(j, way), way)
            state, prefix = NEXT[state], prefix + INSERT
        for k, (text, j) in enumerate(sorted((text, j) for j, (_, text) in best.items())):
            out.cost[i][j], out.rope[i][j], out.rank[i][j] = best[j][0], text, k
    return out


ROWS = [row_matrix(s) for s in range(DELETED + 1)]
#: Insertions that end a conversation from each state.
CLOSING = ("", INSERT * 2, INSERT, "")


def pair_up(sequences: list[np.ndarray], limit: int = RULES) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair: rules (pairs of symbols; rule r is symbol DELETED + 1 + r) and the sequences rewritten by them.

    It ends when no pair occurs twice, or after limit rules.
    """
    rules: list[tuple[int, int]] = []
    width = DELETED + 1 + limit
    flat = np.concatenate([np.append(s, -1) for s in sequences]) if sequences else np.zeros(0, np.int64)
    while len(rules) < limit and len(flat) > 1:
        left, right = flat[:-1], flat[1:]
        inside = (left >= 0) & (right >= 0)
        codes, counts = np.unique((left * width + right)[inside], return_counts=True)
        same = codes // width == codes % width
        order = np.argsort(np.where(same, counts // 2, counts), kind="stable")[::-1]
        if not len(order) or (counts[order[0]] // 2 if same[order[0]] else counts[order[0]]) < 2:
            break
        x, y = divmod(int(codes[order[0]]), width)
        hit = inside & (left == x) & (right == y)
        if x == y:  # every second of a run
            at = np.arange(len(hit))
            begun = np.maximum.accumulate(np.where(hit, -1, at)) if len(hit) else at
            hit &= (at - begun) % 2 == 1
        at = np.flatnonzero(hit)
        flat = flat.copy()
        flat[at] = DELETED + 1 + len(rules)
        flat = np.delete(flat, at + 1)
        rules.append((x, y))
    ends = np.flatnonzero(flat < 0)
    return rules, [flat[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)] if len(ends) else []


def audits(sequences: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and audit of each sequence of symbols."""
    rules, short = pair_up(sequences)
    matrices = list(ROWS)
    for x, y in rules:
        matrices.append(matrices[x].times(matrices[y]))
    out = []
    for sequence in short:
        ways = [(0, 0, START, "")]  # cost, rank, state, rope
        for s in sequence.tolist():
            m, best = matrices[s], {}
            for cost, rank, i, rope in ways:
                for j in range(4):
                    if m.cost[i][j] is not None:
                        key = (cost + m.cost[i][j], rank, m.rank[i][j])
                        if j not in best or key < best[j][0]:
                            best[j] = (key, rope, m.rope[i][j])
            order = sorted(best, key=lambda j: best[j][0][1:])
            ways = [(best[j][0][0], k, j, Rope(best[j][1], best[j][2])) for k, j in enumerate(order)]
        cost, _, state, rope = min((c + COST[INSERT] * len(CLOSING[i]), rank, i, rope) for c, rank, i, rope in ways)
        out.append((cost, (rope if isinstance(rope, str) else rope.spell()) + CLOSING[state]))
    return out


def symbols(letters: np.ndarray) -> np.ndarray:
    """The symbols of letters (numbers from 0): what the program tells apart."""
    kind, fault = letters >> 2, letters & 3
    return np.where(fault >= BLANK, DELETED, 2 * kind + (fault == TRUNCATED))


def counts(letters: np.ndarray) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles do not follow each other."""
    kind, fault = letters >> 2, letters & 3
    follows = kind[:-1] * 4 + kind[1:]
    legal = np.isin(follows, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    return *(int((fault == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~legal).sum())


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, tkey and letters (the first row's, then its repetitions') of each distinct row of rows
    (conv_id, turn, role, text, times)."""
    bare = F.rtrim("text", F.lit(WHITE))
    last = F.right(bare, F.lit(1))
    own = F.when(bare == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    narrow = rows.select("conv_id", "turn", "role", text_key().alias("tkey"), own.alias("fault"), "times")
    each = cut(narrow.groupBy("conv_id", "turn", "role", "tkey").agg(F.sum("times").alias("times"), F.first("fault").alias("fault")))
    turn = F.struct(F.col("turn").isNotNull(), "turn")
    again = each.groupBy("conv_id", "role", "tkey").agg(F.min(turn).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = cut(again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("tkey").alias("k"), "first"))
    both = each.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("tkey") == F.col("k")), "left")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)

    def letter(fault: Column) -> Column:
        return F.substr(F.lit(LETTERS), kind * 4 + fault + 1, F.lit(1))

    repeated = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    first = F.when(F.col("first").isNotNull() & (turn != F.col("first")), repeated).otherwise(F.col("fault"))
    return both.select("conv_id", "turn", "role", "tkey", F.concat(letter(first), F.repeat(letter(repeated), (F.col("times") - 1).cast("int"))).alias("letters"))


ORDER = ["conv_id", "turn", "role", "tkey"]


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id and letters of every conversation, in row order; rows as of faulted()."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        ids: list = []
        pieces: list[list[str]] = []
        size = 0
        for batch in batches:
            for c, text in zip(batch.column("conv_id").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                if not ids or c != ids[-1] or size >= PIECE:
                    ids.append(c)
                    pieces.append([])
                    size = 0
                pieces[-1].append(text)
                size += len(text)
            yield out(ids[:-1], pieces[:-1], at, kind_of)
            at += len(ids[:-1])
            ids, pieces = ids[-1:], pieces[-1:]
        if ids:
            yield out(ids, pieces, at, kind_of)

    def out(ids: list, pieces: list[list[str]], at: int, kind_of: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, kind_of), pa.array(range(at, at + len(ids)), pa.int64()), pa.array(["".join(p) for p in pieces], pa.string())], names=["conv_id", "at", "piece"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind_of = to_arrow_type(rows.schema["conv_id"].dataType)
    pieces = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, f"conv_id {kind}, at long, piece string")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return whole.select("conv_id", F.array_join(F.col("p.piece"), "").alias("letters"))


FOUND = ["blank", "duplicate", "truncated", "illegal", "cost"]


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost (longs) and audit of every conversation of rows (conv_id, turn, role, text, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("letters").to_pylist()
            distinct = list(dict.fromkeys(texts))
            letters = [np.frombuffer(t.encode(), np.uint8).astype(np.int64) - ord(LETTERS[0]) for t in distinct]
            made = {t: (*counts(x), *a) for t, x, a in zip(distinct, letters, audits([symbols(x) for x in letters]), strict=True)}
            table = list(zip(*(made[t] for t in texts), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.int64()) for c in table[:5]), pa.array(table[5], pa.string())], names=["conv_id", *FOUND, "audit"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return written(sequences(faulted(rows)).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in FOUND)}, audit string"))


class Replay:
    """The rows that an audit leaves of a conversation, one after another."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            self.state = NEXT[self.state]
            yield ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            system = edit == KEEP and self.state == START and role.startswith("s")
            self.state = SYSTEM if system else NEXT[self.state]
            yield role if edit == KEEP else ROLE[self.state], text


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found (of repaired) with repaired_sha256: of the conversation's repaired role:text, newline-joined.

    Rows stream in order past the audit that stands before them, so a task holds an audit and a batch.
    """
    own = ["conv_id", *FOUND, "audit"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank = [F.lit(None).cast("long").alias(c) for c in FOUND]
    heads = found.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("tkey"), F.col("audit").alias("text"), F.lit(0).alias("times"), *FOUND)
    bodies = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", text_key().alias("tkey"), "text", "times", *blank)
    order = ["conv_id", "part", "turn", "role", "tkey"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, digest, some = None, Replay(""), hashlib.sha256(), False

        def take(more: Iterator[tuple[str, str]]) -> None:
            nonlocal some
            for role, text in more:
                digest.update(f"{chr(10) * some}{role}:{text}".encode())
                some = True

        def done() -> pa.RecordBatch:
            take(replay.inserted())
            return head.append_column("repaired_sha256", pa.array([digest.hexdigest()]))

        for batch in batches:
            parts, roles, texts, times = (batch.column(c).to_pylist() for c in ("part", "role", "text", "times"))
            for i, part in enumerate(parts):
                if part == 0:
                    if head is not None:
                        yield done()
                    head = batch.slice(i, 1).select(["conv_id", *FOUND, "text"]).rename_columns(own)
                    replay, digest, some = Replay(texts[i]), hashlib.sha256(), False
                else:
                    for _ in range(times[i]):
                        take(replay.row(roles[i], texts[i]))
        if head is not None:
            yield done()

    stream = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*order)
    return stream.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in FOUND)}, audit string, repaired_sha256 string")


def repair(turns: DataFrame, times: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conv_id of turns.

    Rows are taken by turn (nulls first), of one turn by role and digest of the text. times says how often a row
    stands there, one after another; at 0 only its conv_id counts. A null text or role is one space: such a text is blank, such
    a role cannot be kept, nor can an empty one. A null conv_id is a conversation of its own. Repeated rows are
    duplicates of the first; of faults blank comes before duplicate, before truncated. A conversation without rows has
    zeros, an empty audit and the digest of nothing. Texts and conversations of any length stream. An empty table
    gives an empty result. Further columns are not used.
    """
    space = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(1) if times is None else times).cast("long").alias("times"))
    there = F.when(F.col("times") > 0, F.col("turn"))
    # distinct turns by two plain aggregates, so that a conversation with many rows is counted in parts
    each = rows.groupBy("conv_id", there.alias("turn")).agg(F.lit(1).alias("one"))
    spans = each.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    rows = rows.filter("times > 0")
    found = digests(rows, repaired(rows)).withColumnRenamed("conv_id", "c")
    both = spans.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = F.lit(0).cast("long")
    return both.select("conv_id", "gaps", *(F.coalesce(c, zero).alias(c) for c in FOUND), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
