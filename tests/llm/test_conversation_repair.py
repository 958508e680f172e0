"""Conversation repair against a search over all edit sequences and a plain dynamic programme."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from framegauge.llm import conversation_repair as cr
from framegauge.llm.queries import damaged_conversations, op13_conversation_repair

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Least (cost, audit, repaired rows) by trying every edit from every prefix, level by level."""
    states = {0: (0, "", ())}
    last = {"": 0, "s": 1, "u": 2, "a": 3}
    after = {0: "su", 1: "u", 2: "a", 3: "u"}

    def offer(table, q, value):
        if q not in table or value[:2] < table[q][:2]:
            table[q] = value

    def inserted(table):
        for _ in range(4):
            for q, (cost, audit, made) in list(table.items()):
                for s in after[q].replace("s", ""):
                    offer(table, last[s], (cost + 5, audit + "I", (*made, (cr.ROLES[s], ""))))
        return table

    states = inserted(states)
    for (turn, role, text), fault in zip(rows, faults(rows)):
        new = {}
        for q, (cost, audit, made) in states.items():
            offer(new, q, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            for s in after[q]:
                if role[:1] == s:
                    offer(new, last[s], (cost + more, audit + "K", (*made, (role, text))))
                if s != "s":
                    offer(new, last[s], (cost + more + 1, audit + "R", (*made, (cr.ROLES[s], text))))
        states = inserted(new)
    return min(states[q] for q in (0, 3) if q in states)


def every_edit(rows):
    """All edit sequences with at most two insertions in a row."""
    marks = faults(rows)

    def go(i, audit, cost, symbols, inserts):
        if i == len(rows) and PATTERN.fullmatch(symbols):
            yield cost, audit
        if inserts < 2:
            for s in "ua":
                yield from go(i, audit + "I", cost + 5, symbols + s, inserts + 1)
        if i < len(rows):
            yield from go(i + 1, audit + "D", cost + 2, symbols, 0)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                yield from go(i + 1, audit + "K", cost + more, symbols + rows[i][1][:1], 0)
                for s in "ua":
                    yield from go(i + 1, audit + "R", cost + more + 1, symbols + s, 0)

    return min(go(0, "", 0, "", 0))


def expected(rows):
    """Summary and digest of ordered (turn, role, text) rows, nulls replaced."""
    marks = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, made = plain_repair(rows)
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": marks.count("blank"),
            "duplicate": marks.count("duplicate"), "truncated": marks.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()}


def in_order(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    repaired = cr.repair_conversations(df, **options)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in cr.conversation_digests(repaired.rows).collect()}
    got = {r["conv_id"]: r.asDict() for r in repaired.summary.collect()}
    for conv, row in got.items():
        row["repaired_sha256"] = digests.get(conv, hashlib.sha256(b"").hexdigest())
        del row["conv_id"]
    return got, repaired.rows


def check(spark, rows, **options):
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(row)
    got, repaired = run(spark, rows, **options)
    assert got == {conv: expected(in_order(own)) for conv, own in by_conv.items()}
    return repaired


def test_agenda_against_every_edit():
    choice = random.Random(3)
    for _ in range(60):
        rows = [(i, choice.choice(["system", "user", "assistant", "tool"]), choice.choice(["Hi.", "Well", " ", "Yes!", "No?"]))
                for i in range(choice.randint(0, 3))]
        turns = []
        for row, fault in zip(rows, faults(rows)):
            turns.append(cr.Turns(row[1][:1], 1, fault == "blank", fault == "duplicate", fault == "truncated"))
        assert cr.repair_rows(turns) == every_edit(rows) == plain_repair(rows)[:2]


def test_repair_against_plain_search(spark):
    choice = random.Random(5)
    rows = [(c, choice.choice([None, *range(6)]), choice.choice(["system", "user", "user", "assistant", "assistant", None, "", "other"]),
             choice.choice(["Good day.", "what", "Why?", "", "\n\t ", None, f"text {choice.randint(0, 9)}!", "no end "]))
            for c in [None, *range(40)] for _ in range(choice.randint(1, 9))]
    rows += choice.choices(rows, k=60)
    repaired = check(spark, rows)
    places = defaultdict(list)
    for r in repaired.collect():
        places[r["conv_id"]].append(r["place"])
        assert r["edit"] != "I" or r["turn"] is None and r["text"] == ""
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("chunk_rows", [1, 7])
def test_long_conversation_over_chunks_and_tasks(spark, chunk_rows):
    choice = random.Random(8)
    rows = [(1, i // 2, choice.choice(["user", "assistant", "system"]), choice.choice(["a.", "b!", "c", "", f"{i}."])) for i in range(300)]
    rows += [(2, 5, "user", "Same.")] * 90 + [(3, i, "user", "x" * 50_000 + ".") for i in range(4)]
    check(spark, rows, chunk_rows=chunk_rows)


def test_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    repaired = cr.repair_conversations(empty)
    assert repaired.summary.count() == 0 and cr.conversation_digests(repaired.rows).count() == 0
    odd = spark.createDataFrame([("x", 1, "user", "Hi.", 3, "b")], "`conv.id` string, turn int, role string, text string, digest int, conv_id string")
    repaired = cr.repair_conversations(odd, conv_id="conv.id")
    assert [(r["conv.id"], r["audit"], r["cost"]) for r in repaired.summary.collect()] == [("x", "D", 2)]
    assert repaired.rows.count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by_conv = defaultdict(list)
    for r in rows:
        fate = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        by_conv[r["conv_id"]] += [(r["turn"], "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    got = {r["conv_id"]: r.asDict() for r in op13_conversation_repair(spark, SF).collect()}
    assert got == {c: {"conv_id": c, **expected(in_order(own))} for c, own in by_conv.items()}


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    fate = zlib.crc32(b" : ") % 20
    got = damaged_conversations(df).collect()
    assert len(got) == (0 if fate == 0 else 2 if fate == 3 else 1)
