"""Repair of conversations: the cheapest edits that make the roles alternate, found by bidirectional Dijkstra searches.

A node of the lattice is (rows done, role state); Keep, Rerole, Delete and Insert are its edges. A forward heap and a reverse heap meet, all
crossings of equal cost are finished, and the least audit of them is taken. An audit fixes its path, so of two cheapest ways to a node
neither audit begins the other, and the least audit of each half gives the least of the whole.

No conversation has to fit a task: Spark sorts all rows by conversation and turn, cut into chunks of at most `CHUNK` rows. A conversation
of one chunk is searched whole. Otherwise each chunk is searched between all pairs of states, and a search over the chunks' ends joins
them; that step holds 16 audits of a chunk, never texts. Rows that are equal within a turn are one step with a number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratescale.llm.common import written
from ratescale.operators.scale import attach_group_stats

BLANKS = " \t\n\x0b\x0c\r"
RULES = 20  # kinds of damage are read from this many remainders
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
CHUNK_BITS = 11
CHUNK = 1 << CHUNK_BITS

Node = tuple[int, int]
Edge = tuple[int, int, str]  # state, cost, audit
# states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; a conversation ends in 0 or 3
ENDS = (0, 3)
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
WANTED = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
LEGAL = ("su", "ua", "au")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def conversation_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, conv_id, turn, role, text): `conv` is never null; a null role or text is one space; other columns stay out."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("conv")
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spoken(role).alias("role"), spoken(text).alias("text"), key)
    return plain.select("conv", "conv_id", "turn", "role", "text")


def damage(rows: DataFrame) -> DataFrame:
    """Rows of `conversation_rows` with planted faults, by crc32 of `conv_id:turn` (null: one space)."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % RULES
    text = F.when(F.col("_rule") == 1, "").when(F.col("_rule") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_rule") == 4, "user").otherwise(F.col("role"))
    ruled = rows.withColumn("_rule", rule).filter("_rule <> 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_rule") == 3, 2).otherwise(1))))
    return ruled.select("conv", "conv_id", "turn", role.alias("role"), text.alias("text"))


def _mark() -> Column:
    return F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


def steps(rows: DataFrame) -> DataFrame:
    """(id, conv, turn, code, copies, mark) in the order of the conversations; no texts.

    Rows of a turn come in the order of `mark`, a digest of role and text, nulls of `turn` first. `code` is the role's letter (s, u, a or x)
    and the first fault's: b blank, d duplicate, t truncated or a dot.
    """
    ended = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    fault = F.when(ended == "", "b").when(F.substring(ended, -1, 1).isin(".", "!", "?"), ".").otherwise("t")
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    merged = rows.select("conv", "turn", _mark().alias("mark"), code.alias("code")).groupBy("conv", "turn", "mark").agg(
        F.first("code").alias("code"), F.count(F.lit(1)).alias("copies")
    )
    known = attach_group_stats(merged, ["conv", "mark"], {"first": F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))})
    again = ~F.col("turn").eqNullSafe(F.col("first.turn")) & ~F.col("code").endswith("b")
    known = known.select("conv", "turn", "mark", "copies", F.when(again, F.concat(F.substring("code", 1, 1), F.lit("d"))).otherwise(F.col("code")).alias("code"))
    order = ["conv", F.col("turn").asc_nulls_first(), "mark"]
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select(F.monotonically_increasing_id().alias("id"), "conv", "turn", "code", "copies", "mark")


class Lattice:
    """Edges of a conversation's rows, or of its chunks, in both directions."""

    def __init__(self, levels: list[list[list[Edge]]], inserts: bool):
        """`levels[i][q]`: edges from state q over row or chunk i."""
        self.levels, self.inserts = levels, inserts

    def ahead(self, node: Node) -> Iterator[tuple[Node, int, str]]:
        i, q = node
        if i < len(self.levels):
            for to, cost, audit in self.levels[i][q]:
                yield (i + 1, to), cost, audit
        if self.inserts:
            yield (i, WANTED[q][1]), INSERT, "I"

    def back(self, node: Node) -> Iterator[tuple[Node, int, str]]:
        i, q = node
        for p in range(4):
            if i:
                for to, cost, audit in self.levels[i - 1][p]:
                    if to == q:
                        yield (i - 1, p), cost, audit
            if self.inserts and WANTED[p][1] == q:
                yield (i, p), INSERT, "I"

    def cheapest(self, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
        """Least cost from the state before all rows to one of the states after them, and the least audit of that cost."""
        n = len(self.levels)
        # ties go by the rows done, as edges without cost always do a row: what is taken from a heap is final
        heaps: tuple[list, list] = ([(0, 0, "", (0, start))], [(0, 0, "", (n, q)) for q in ends])
        settled: tuple[dict[Node, tuple[int, str]], dict[Node, tuple[int, str]]] = ({}, {})
        best: tuple[int, str] | None = None

        def settle(side: int) -> None:
            nonlocal best
            cost, _, audit, node = heappop(heaps[side])
            if node in settled[side]:
                return
            settled[side][node] = (cost, audit)
            meets = [(node, 0, "")] + [*(self.back if side else self.ahead)(node)]
            for other, more, label in meets:
                if other in settled[1 - side]:
                    rest, tail = settled[1 - side][other]
                    total = cost + more + rest
                    if best is None or total <= best[0]:
                        whole = tail + label + audit if side else audit + label + tail
                        best = min(best, (total, whole)) if best else (total, whole)
                if other not in settled[side] and other != node:
                    done = n - other[0] if side else other[0]
                    heappush(heaps[side], (cost + more, done, label + audit if side else audit + label, other))

        settle(0)
        for _ in ends:
            settle(1)
        while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
            settle(0 if heaps[0][0][0] <= heaps[1][0][0] else 1)
        for side in (0, 1):  # one side has seen all it can reach
            while best is None and heaps[side] and not heaps[1 - side]:
                settle(side)
        return best


def row_edges(code: str, copies: int) -> list[list[Edge]]:
    """Edges of one row and its equal neighbours; all but the first of these have to go, right after it: an insert comes later, as D < I."""
    rest, gone = DELETE * (copies - 1), "D" * (copies - 1)
    role, fault = code
    out: list[list[Edge]] = []
    for q in range(4):
        edges = [(q, DELETE + rest, "D" + gone)]
        if fault in ".t":
            late = TRUNCATED if fault == "t" else 0
            if (role, q) in KEEP:
                edges.append((KEEP[role, q], late + rest, "K" + gone))
            edges.append((WANTED[q][1], REROLE + late + rest, "R" + gone))
        out.append(edges)
    return out


def walk(items: list[dict], state: int, audit: str) -> tuple[list[tuple[str | None, str | None]], int, str]:
    """The repaired lines (mark, role) of an audit's rows: no mark for an insert, no role for a kept one; the state and the audit left."""
    lines: list[tuple[str | None, str | None]] = []
    at = 0
    for item in items:
        while audit[at] == "I":
            role, state = WANTED[state]
            lines.append((None, role))
            at += 1
        if audit[at] == "K":
            lines.append((item["mark"], None))
            state = KEEP[item["code"][0], state]
        elif audit[at] == "R":
            role, state = WANTED[state]
            lines.append((item["mark"], role))
        at += item["copies"]
    return lines, state, audit[at:]


def illegal(items: list[dict]) -> int:
    """Neighbouring role letters that may not follow each other."""
    roles = [item["code"][0] for item in items]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])) + sum(item["copies"] - 1 for item in items)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches each chunk: whole conversations from the start to an end, other chunks between all pairs of states."""
    for batch in batches:
        rows = []
        for conv, chunk, parts, items in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "parts", "items"))):
            lattice = Lattice([row_edges(i["code"], i["copies"]) for i in items], True)
            if parts == 1:
                pairs = [(0, ENDS)]
            else:
                pairs = [(p, (q,)) for p in range(4) for q in range(4)]
            ways = [{"start": p, "end": q[0], "cost": w[0], "audit": w[1]} for p, q in pairs if (w := lattice.cheapest(p, q))]
            rows.append((conv, chunk, parts, illegal(items), items[0]["code"][0], items[-1]["code"][0], ways))
        yield pa.RecordBatch.from_pylist([dict(zip(SOLVED.names, r)) for r in rows], schema=SOLVED)


SOLVED = pa.schema([
    ("conv", pa.string()), ("chunk", pa.int64()), ("parts", pa.int64()), ("illegal", pa.int64()), ("opens", pa.string()), ("closes", pa.string()),
    ("ways", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
SOLVED_SQL = "conv string, chunk long, parts long, illegal long, opens string, closes string, ways array<struct<start int, end int, cost long, audit string>>"


def join_chunks(ways: list[list[dict]]) -> list[tuple[int, int, str]]:
    """(state before, cost, audit) of each chunk of a conversation, from the ways through its chunks."""
    levels = [[[(w["end"], w["cost"], w["audit"]) for w in some if w["start"] == q] for q in range(4)] for some in ways]
    _, audit = Lattice(levels, False).cheapest(0, ENDS)
    state, out = 0, []
    for i, level in enumerate(levels):
        fits = [e for e in level[state] if audit.startswith(e[2])]
        if i < len(levels) - 1:
            to, cost, piece = min(fits, key=lambda e: len(e[2]))  # inserts on the border open the next chunk
        else:
            to, cost, piece = next(e for e in fits if e[0] in ENDS and e[2] == audit)
        out.append((state, cost, piece))
        state, audit = to, audit[len(piece):]
    return out


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("chunk")
    start, cost, audit = zip(*join_chunks([list(w) for w in group["ways"]]))
    return pd.DataFrame({"conv": group["conv"], "chunk": group["chunk"], "start": start, "cost": cost, "audit": audit})


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, chunks, places, marks, roles = [], [], [], [], []
        for conv, chunk, start, audit, items in zip(*(batch.column(c).to_pylist() for c in ("conv", "chunk", "start", "audit", "items"))):
            lines, state, left = walk(items, start, audit)
            for _ in left:  # inserts after the last row
                role, state = WANTED[state]
                lines.append((None, role))
            convs += [conv] * len(lines)
            chunks += [chunk] * len(lines)
            places += range(len(lines))
            marks += [m for m, _ in lines]
            roles += [r for _, r in lines]
        columns = [pa.array(c, t) for c, t in ((convs, pa.string()), (chunks, pa.int64()), (places, pa.int64()), (marks, pa.string()), (roles, pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["conv", "chunk", "place", "mark", "new_role"])


class Repair:
    """The repair of all conversations of rows of `conversation_rows`; `report` and `lines` share the searches."""

    def __init__(self, rows: DataFrame, chunk_bits: int = CHUNK_BITS):
        self.rows = rows
        self.steps = written(steps(rows), "conversation-steps")
        chunk = F.shiftright("id", chunk_bits).alias("chunk")
        items = F.array_sort(F.collect_list(F.struct("id", "code", "copies", "mark"))).alias("items")
        self.chunks = self.steps.groupBy("conv", chunk).agg(items)
        counted = self.chunks.withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("conv")))
        self.solved = written(counted.mapInArrow(_solved, SOLVED_SQL), "conversation-ways")
        way = F.col("ways")[0]
        alone = self.solved.filter("parts = 1").select("conv", "chunk", way["start"].alias("start"), way["cost"].alias("cost"), way["audit"].alias("audit"))
        split = self.solved.filter("parts > 1").select("conv", "chunk", "ways").groupBy("conv").applyInPandas(_joined, "conv string, chunk long, start int, cost long, audit string")
        self.pieces = alone.unionByName(split)

    def report(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of the conversations that have rows."""
        fault, copies = F.substring("code", 2, 1), F.col("copies")
        total = lambda c: F.sum(c).cast("long")
        faults = self.steps.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
            total(F.when(fault == "b", copies).otherwise(0)).alias("blank"),
            total(F.when(fault == "b", 0).when(fault == "d", copies).otherwise(copies - 1)).alias("duplicate"),
            total(F.when(fault == "t", 1).otherwise(0)).alias("truncated"),
        )
        before = F.lag("closes").over(W.partitionBy("conv").orderBy("chunk"))
        borders = self.solved.withColumn("border", F.concat(before, "opens"))
        wrong = borders.groupBy("conv").agg(total(F.col("illegal") + F.when(F.col("border").isNull() | F.col("border").isin(*LEGAL), 0).otherwise(1)).alias("illegal"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "")
        edits = self.pieces.groupBy("conv").agg(total("cost").alias("cost"), whole.alias("audit"))
        return faults.join(wrong, "conv").join(edits, "conv")

    def lines(self) -> DataFrame:
        """(conv, chunk, place, role, text): the repaired conversations; chunk and place give the order."""
        planned = self.pieces.join(self.chunks, ["conv", "chunk"]).select("conv", "chunk", "start", "audit", "items")
        planned = planned.mapInArrow(_lines, "conv string, chunk long, place long, mark string, new_role string")
        said = self.rows.groupBy("conv", _mark().alias("mark")).agg(F.first("role").alias("old_role"), F.first("text").alias("text"))
        kept = planned.filter(F.col("mark").isNotNull()).join(said, ["conv", "mark"])
        kept = kept.select("conv", "chunk", "place", F.coalesce("new_role", "old_role").alias("role"), "text")
        return kept.unionByName(planned.filter(F.col("mark").isNull()).select("conv", "chunk", "place", F.col("new_role").alias("role"), F.lit("").alias("text")))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        convs, digests = [], []
        for conv, role, text in zip(*(batch.column(c) for c in ("conv", "role", "text"))):
            if conv.as_py() == now:
                digest.update(b"\n")
            else:
                if now is not None:
                    convs.append(now)
                    digests.append(digest.hexdigest())
                now, digest = conv.as_py(), hashlib.sha256()
            digest.update(f"{role.as_py()}:{text.as_py()}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(digests, pa.string())], names=["conv", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["conv", "repaired_sha256"])


def digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of `role:text` lines joined by newlines; the lines stream by, however long a conversation is."""
    order = ["conv", "chunk", "place"]
    return lines.repartition("conv").sortWithinPartitions(*order).select("conv", "role", "text").mapInArrow(_digested, "conv string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows (conv_id, chunk, place, role, text), in the order of chunk and place.

    Null roles and texts are one space, null turns come first, rows of a null conversation are one conversation, rows of a turn go by a digest of
    role and text, repeated rows are duplicates, and other columns stay out. Conversations that lose all rows have none; an empty table stays empty.
    """
    plain = conversation_rows(rows, conv, turn, role, text)
    ids = plain.groupBy("conv").agg(F.first("conv_id").alias(conv))
    return Repair(plain).lines().join(ids, "conv").select(conv, "chunk", "place", F.col("role").alias(role), F.col("text").alias(text))


def repair_report(rows: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None, chunk_bits: int = CHUNK_BITS, conv: str = "conv_id") -> DataFrame:
    """Faults, cost, audit and the repaired lines' digest of each conversation; `change` may damage the rows first.

    A row for each `conv_id` of `rows`, null included. Without rows after the change: zeros, an empty audit and the digest of an empty text.
    """
    plain = conversation_rows(rows, conv)
    work = Repair(change(plain) if change else plain, chunk_bits)
    ids = plain.groupBy("conv").agg(F.first("conv_id").alias(conv))
    out = ids.join(work.report(), "conv", "left").join(digests(work.lines()), "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(conv, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
