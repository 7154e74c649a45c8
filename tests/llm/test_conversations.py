"""Repaired conversations against a search over all audits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ratescale.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, mark string, chunk string"
EMPTY = hashlib.sha256(b"").hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def mark(row):
    return hashlib.md5(f"{len(row[2])}:{row[2]}{row[3]}".encode()).hexdigest()


def plain_report(rows):
    """All states after each row with all their cheapest audits and lines; no pruning by audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, mark(r)))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    # (state) -> (cost, {(audit, lines)}); after each row up to three inserts may follow
    following = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}
    ways = {"": (0, {("", ())})}

    def add(to, state, cost, found):
        have = to.get(state)
        if have is None or cost < have[0]:
            to[state] = (cost, set(found))
        elif cost == have[0]:
            have[1].update(found)

    def inserted(ways):
        out = {}
        for state, (cost, found) in ways.items():
            for _ in range(4):
                add(out, state, cost, found)
                role = "assistant" if state == "u" else "user"
                state, cost = role[0], cost + 3
                found = {(a + "I", (*lines, f"{role}:")) for a, lines in found}
        return out

    ways = inserted(ways)
    for (_, _, role, text), fault in zip(rows, faults):
        out = {}
        for state, (cost, found) in ways.items():
            add(out, state, cost + 4, {(a + "D", lines) for a, lines in found})
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                if (role[:1], state) in following:
                    add(out, role[:1], cost + late, {(a + "K", (*lines, f"{role}:{text}")) for a, lines in found})
                for new in ("user", "assistant"):
                    if (new[0], state) in following:
                        add(out, new[0], cost + 3 + late, {(a + "R", (*lines, f"{new}:{text}")) for a, lines in found})
        ways = inserted(out)
    least = min(c for s, (c, _) in ways.items() if s in ("", "a"))
    audit, lines = min(w for s, (c, found) in ways.items() if s in ("", "a") and c == least for w in found)
    return (
        gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        least, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_reports(rows, change):
    after = plain_damage(rows) if change else [(c, t, *(" " if x is None else x for x in (r, s))) for c, t, r, s in rows]
    groups = {conv: [r for r in after if r[0] == conv] for conv in {r[0] for r in rows}}
    return sorted(((conv, *(plain_report(some) if some else (0, 0, 0, 0, 0, 0, "", EMPTY))) for conv, some in groups.items()), key=str)


def result(df):
    return sorted(((r["conv_id"], *[r[c] for c in conversations.COUNTS], r["audit"], r["repaired_sha256"]) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def random_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant", "usher"]
    texts = ["Yes.", "No!", "Why?", "well", "so . ", " \n", "", None, "a ", "x ", "Yes.", "and?\t"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 3, None, 1]), rng.choice(roles), rng.choice([*texts, f"Text {turn}.", f"Text {turn}"])))
    return rows


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_conversations(spark, data)) == plain_reports(rows, True)


@pytest.mark.parametrize("chunk_bits", [0, 1, 2, 11])
@pytest.mark.parametrize("change", [None, conversations.damage])
def test_random_conversations(spark, chunk_bits, change):
    """With small chunks conversations are put together from several."""
    rows = random_rows(7, 120, 9)
    assert result(conversations.repair_report(frame(spark, rows), change, chunk_bits)) == plain_reports(rows, change)


def test_no_rows(spark):
    rows = frame(spark, random_rows(1, 2, 3))
    assert result(conversations.repair_report(rows.limit(0))) == [] and conversations.repair(rows.limit(0)).count() == 0
    gone = conversations.repair_report(rows, lambda r: r.limit(0))
    assert {r[1:] for r in result(gone)} == {(0, 0, 0, 0, 0, 0, "", EMPTY)}


def test_long_conversation_and_long_text(spark):
    """One conversation of 9,000 rows over many chunks, a row repeated 4,000 times, a text of a million letters."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(9_000)] + [(2, 0, "user", "Hi.")] * 4_000 + [(2, 1, "assistant", "b" * 1_000_000 + "!")]
    got = result(conversations.repair_report(frame(spark, rows), chunk_bits=9))
    lines = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:9_000])
    assert got[0] == (1, 0, 0, 0, 0, 0, 0, "K" * 9_000, hashlib.sha256(lines.encode()).hexdigest())
    assert got[1] == (2, 0, 0, 3_999, 0, 3_999, 4 * 3_999, "K" + "D" * 3_999 + "K", hashlib.sha256(f"user:Hi.\nassistant:{'b' * 1_000_000}!".encode()).hexdigest())


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "One."), (1, 1, "user", "Two."), (1, 2, "assistant", "Three.")]
    out = conversations.repair(frame(spark, rows)).orderBy("chunk", "place")
    assert out.columns == ["conv_id", "chunk", "place", "role", "text"]
    assert [(r["role"], r["text"]) for r in out.collect()] == [("user", "One."), ("assistant", ""), ("user", "Two."), ("assistant", "Three.")]
    roles = conversations.repair(frame(spark, random_rows(3, 200, 8))).withColumn("conv", F.coalesce("conv_id", F.lit(-1))).orderBy("conv", "chunk", "place").collect()
    spoken = {}
    for r in roles:
        spoken[r["conv"]] = spoken.get(r["conv"], "") + r["role"][0]
    assert all(re.fullmatch("(s?(ua)+)?", s) for s in spoken.values())
