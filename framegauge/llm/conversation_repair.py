"""Repair of broken conversations by Knuth's lightest-derivation search.

A conversation is a sequence of rows; its roles shall read ``(s?(ua)+)?`` by their
initials (system, user, assistant).  An item (i, state) says that the first i rows
are dealt with and the roles written so far left the pattern in that state.  Keeping,
re-labelling, deleting a row and inserting one are deductions from item to item.
Their weights are pairs (cost, audit), the audit being the initials of the edits so
far; a deduction never makes a pair smaller (it is superior), so items popped from
the agenda in ascending order are final and the goal is final when it is popped.

Two audits of one item that cost the same are never beginnings of each other: an
edit more would be an insertion, which costs.  So whatever follows keeps their order,
and the search also works over pieces: rows are sorted by range, a long conversation
is cut into chunks over several tasks, each chunk is solved for every state it can be
entered in, and a second search of the same kind goes over chunks instead of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framegauge.functions.columns import quoted
from framegauge.llm.native import NO_SPACE
from framegauge.session import checkpointed

# Costs of the edits.
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
# States: nothing written, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
# Rows of a conversation that are solved at once.
CHUNK_ROWS = 1024
ROW_BATCH = 2048

Move = tuple[int, str, Hashable]


class Turns(NamedTuple):
    """``copies`` equal rows that follow each other."""

    initial: str
    copies: int
    blank: bool
    seen: bool
    truncated: bool


class Repaired(NamedTuple):
    """``summary``: a row per conversation; ``rows``: the rows of the repaired conversations."""

    summary: DataFrame
    rows: DataFrame


def lightest(moves: Callable[[Hashable], Iterable[Move]], start: Hashable, goal: Callable[[Hashable], bool] | None = None) -> tuple[dict, Hashable]:
    """Final (cost, audit, item before, last edits) of the items reachable from ``start``.

    Stops at the first item that is a ``goal``, and returns it.
    """
    final: dict = {}
    agenda = [(0, "", 0, start, None, "")]
    pushed = 0
    while agenda:
        cost, audit, _, item, origin, last = heappop(agenda)
        if item in final:
            continue
        final[item] = (cost, audit, origin, last)
        if goal is not None and goal(item):
            return final, item
        for price, letters, reached in moves(item):
            if reached not in final:
                pushed += 1
                heappush(agenda, (cost + price, audit + letters, pushed, reached, item, letters))
    return final, None


def row_moves(rows: list[Turns]) -> Callable[[tuple[int, int]], Iterator[Move]]:
    """The deductions from an item (rows done, state)."""

    def moves(item):
        i, state = item
        for symbol, reached in STEPS[state].items():
            if symbol in ROLES:
                yield INSERT, "I", (i, reached)
        if i == len(rows):
            return
        row = rows[i]
        yield DELETE * row.copies, "D" * row.copies, (i + 1, state)
        if row.blank or row.seen:
            return
        # Copies of this row have been seen by then; deleting them at once is the least audit.
        more, rest = DELETE * (row.copies - 1) + UNFINISHED * row.truncated, "D" * (row.copies - 1)
        for symbol, reached in STEPS[state].items():
            if symbol == row.initial:
                yield more, "K" + rest, (i + 1, reached)
            if symbol in ROLES:
                yield REROLE + more, "R" + rest, (i + 1, reached)

    return moves


def repair_rows(rows: list[Turns]) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    final, end = lightest(row_moves(rows), (0, START), lambda item: item[0] == len(rows) and item[1] in ACCEPTING)
    return final[end][:2]


def chunk_edges(rows: list[Turns], entries: Iterable[int]) -> list[dict]:
    """The lightest way through a chunk for every pair of entry and exit."""
    edges = []
    for entry in entries:
        final, _ = lightest(row_moves(rows), (0, entry))
        edges += [{"entry": entry, "exit": state, "cost": value[0], "letters": value[1]}
                  for (i, state), value in final.items() if i == len(rows)]
    return edges


def edit_plan(initials: str, state: int, letters: str) -> tuple[int, list[tuple[int, str, str]]]:
    """The state after ``letters`` and (row or -1, new role or '', edit) of every row that they write."""
    made, row = [], 0
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        symbol = initials[row] if letter == "K" else next(s for s in STEPS[state] if s in ROLES)
        made.append((-1 if letter == "I" else row, "" if letter == "K" else ROLES[symbol], letter))
        state = STEPS[state][symbol]
        row += letter != "I"
    return state, made


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == ROW_BATCH:
            yield pa.RecordBatch.from_pylist(waiting, schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


_EDGES = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))
_CHUNK = pa.struct([
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("low", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("initials", pa.string()), ("edges", _EDGES)])
_CHUNK_DDL = ("struct<first_turn:bigint,last_turn:bigint,low:bigint,n_turns:bigint,blank:bigint,duplicate:bigint,truncated:bigint,"
              "illegal:bigint,initials:string,edges:array<struct<entry:int,exit:int,cost:bigint,letters:string>>>")


_TOTAL_DDL = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"


def _summary(turns: list, rows: list[Turns], entries: Iterable[int]) -> dict:
    """Counts and ways of one chunk; one initial a row, a space for none."""
    known = [t for t in turns if t is not None]
    initials = "".join(r.initial * r.copies for r in rows)
    later = [r.copies - (not r.seen) for r in rows]
    return {
        "first_turn": turns[0], "last_turn": turns[-1], "low": known[0] if known else None, "n_turns": len(set(known)),
        "blank": sum(r.copies for r in rows if r.blank),
        "duplicate": sum(n for r, n in zip(rows, later) if not r.blank),
        "truncated": sum(r.truncated for r in rows if not r.blank and not r.seen),
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
        "initials": initials, "edges": chunk_edges(rows, entries)}


def _chunked(batches, conv_type, most):
    """Rows in order, numbered within chunks; the last row of a chunk carries its summary."""
    schema = pa.schema([("conv_id", conv_type), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                        ("chunk", pa.int64()), ("place", pa.int32()), ("summary", _CHUNK)])

    def chunks():
        chunk = TaskContext.get().partitionId() << 32
        # The first conversation of a partition may have begun in the one before.
        first = True
        for _, conversation in groupby(_records(batches), key=itemgetter(0)):
            whole, part = not first, []
            first = False
            for record in conversation:
                part.append(record)
                if len(part) == most:
                    yield from solved(chunk, part, [START] if whole else range(4))
                    chunk, whole, part = chunk + 1, False, []
            if part:
                yield from solved(chunk, part, [START] if whole else range(4))
                chunk += 1

    def solved(chunk, part, entries):
        runs = [Turns(role[:1] or " ", n, blank, seen, truncated) for _, _, role, _, n, blank, truncated, seen in part]
        place = 0
        for record, run in zip(part, runs):
            yield {"conv_id": record[0], "turn": record[1], "role": record[2], "digest": record[3], "chunk": chunk, "place": place,
                   "summary": None if record is not part[-1] else _summary([r[1] for r in part], runs, entries)}
            place += run.copies

    return _batches(chunks(), schema)


def _joined(batches, conv_type):
    """Chunks of a conversation put together: a row per chunk with what it writes, the first one with the totals."""
    total = pa.struct([(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
    plan = pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string()), ("edit", pa.string())]))
    schema = pa.schema([("conv_id", conv_type), ("chunk", pa.int64()), ("written", pa.int64()), ("plan", plan), ("total", total)])

    def rows():
        for conv_id, chunks in groupby(_records(batches), key=itemgetter(0)):
            _, numbers, parts = zip(*chunks)
            ways = [{entry: [e for e in part["edges"] if e["entry"] == entry] for entry in range(4)} for part in parts]

            def moves(item):
                k, state = item
                return [] if k == len(parts) else [(e["cost"], e["letters"], (k + 1, e["exit"])) for e in ways[k][state]]

            final, end = lightest(moves, (0, START), lambda item: item[0] == len(parts) and item[1] in ACCEPTING)
            cost, audit, *_ = final[end]
            taken = []
            while final[end][2] is not None:
                taken.append(final[end][3])
                end = final[end][2]
            known = [p for p in parts if p["n_turns"]]
            distinct = sum(p["n_turns"] for p in parts) - sum(a["last_turn"] == b["low"] for a, b in zip(known, known[1:]))
            totals = {name: sum(p[name] for p in parts) for name in ("blank", "duplicate", "truncated", "illegal")}
            totals["illegal"] += sum(a["initials"][-1] + b["initials"][0] not in LEGAL_PAIRS for a, b in zip(parts, parts[1:]))
            totals |= {"gaps": known[-1]["last_turn"] - known[0]["low"] + 1 - distinct if known else 0, "cost": cost, "audit": audit}
            state, written = START, 0
            for number, part, letters in zip(numbers, parts, reversed(taken)):
                state, made = edit_plan(part["initials"], state, letters)
                yield {"conv_id": conv_id, "chunk": number, "written": written, "total": totals,
                       "plan": [{"place": p, "role": r, "edit": e} for p, r, e in made]}
                written += len(made)
                totals = None

    return _batches(rows(), schema)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         chunk_rows: int = CHUNK_ROWS) -> Repaired:
    """The cheapest repair of every conversation, and what was wrong with it.

    Faults: a row without a non-space character is blank; else one whose role and text
    were there before is a duplicate; else one that does not end in ``.``, ``!`` or ``?``
    is truncated.  Of equally cheap repairs the one with the least audit is taken.

    ``summary``: conv_id, gaps (turns that lack between the first and the last), blank,
    duplicate, truncated, illegal (neighbouring roles that must not follow each other),
    cost and audit.  ``rows``: conv_id, place (from 0), turn (null for inserted rows),
    role, text, edit (K kept, R given another role, I inserted).

    Rows are taken by turn, null first; of equal turns by role and SHA-256 of the text,
    which also stands for the text in telling duplicates.  Null roles and texts count as
    one space; a null conv_id is a conversation like any other.  Other columns play no
    part.  Conversations of any length: ``chunk_rows`` different rows are solved at a time;
    a conversation's edits are held together, but never its texts.  An empty table gives empty frames.
    """
    conv_type = rows.select(quoted(conv_id).alias("conv_id")).schema["conv_id"].dataType.simpleString()
    plain = rows.select(quoted(conv_id).alias("conv_id"), quoted(turn).cast("bigint").alias("turn"),
                        F.coalesce(quoted(role), F.lit(" ")).alias("role"), F.coalesce(quoted(text), F.lit(" ")).alias("text"))
    plain = plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    key = ["conv_id", "turn", "role", "digest"]
    end = F.expr(r"substr(rtrim(' \t\n\u000b\f\r', text), -1)")
    # Equal rows of a turn are one row with a count before anything is sorted.
    runs = plain.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("text").rlike(NO_SPACE)).alias("blank"),
                                   F.bool_or(~end.isin(".", "!", "?")).alias("truncated"))
    first = runs.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct("turn"))["turn"].alias("t"))
    told = runs.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    told = told.select(*key, "n", "blank", "truncated", (~F.col("turn").eqNullSafe(F.col("t"))).alias("seen"))
    arrow = to_arrow_type(told.schema["conv_id"].dataType)
    ordered = told.repartitionByRange(*key).sortWithinPartitions(*key)
    placed = checkpointed(ordered.mapInArrow(
        lambda batches: _chunked(batches, arrow, chunk_rows),
        f"conv_id {conv_type}, turn bigint, role string, digest binary, chunk bigint, place int, summary {_CHUNK_DDL}"))
    chunks = placed.where("summary is not null").select("conv_id", "chunk", "summary")
    joined = checkpointed(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(
        lambda batches: _joined(batches, arrow),
        f"conv_id {conv_type}, chunk bigint, written bigint, plan array<struct<place:int,role:string,edit:string>>, total {_TOTAL_DDL}"))
    summary = joined.where("total is not null").select("conv_id", "total.*")
    # What is written, then the rows kept with it, then their texts: each row is looked up by its key.
    plan = joined.select("chunk", "written", F.posexplode("plan").alias("k", "p")).select(
        "chunk", (F.col("written") + F.col("k")).alias("at"), F.col("p.place").alias("place"), F.col("p.role").alias("new_role"), F.col("p.edit").alias("edit"))
    source = placed.drop("summary").withColumnsRenamed({"conv_id": "c", "turn": "t", "role": "r", "digest": "d"})
    named = plan.where("place >= 0").join(source, ["chunk", "place"])
    texts = plain.groupBy(*key).agg(F.first("text").alias("text"))
    kept = named.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
                      & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    new_role = F.coalesce(F.nullif("new_role", F.lit("")), "role")
    kept = kept.select("conv_id", F.col("at").alias("place"), "turn", new_role.alias("role"), "text", "edit")
    owners = chunks.select("conv_id", "chunk")
    added = plan.where("place < 0").join(owners, "chunk").select(
        "conv_id", F.col("at").alias("place"), F.lit(None).cast("bigint").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return Repaired(summary.withColumnRenamed("conv_id", conv_id), kept.unionByName(added).withColumnRenamed("conv_id", conv_id))


def conversation_digests(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines, in order of ``place``.

    The hash has to see a conversation's rows one after the other; they stream through
    it in sorted order and are never held together.
    """
    kind = rows.schema[conv_id].dataType.simpleString()
    arrow = to_arrow_type(rows.schema[conv_id].dataType)

    def run(batches):
        schema = pa.schema([("conv_id", arrow), ("repaired_sha256", pa.string())])

        def digests():
            for owner, lines in groupby(_records(batches), key=itemgetter(0)):
                state, gap = hashlib.sha256(), ""
                for _, _, role, text in lines:
                    state.update(f"{gap}{role}:{text}".encode())
                    gap = "\n"
                yield {"conv_id": owner, "repaired_sha256": state.hexdigest()}

        return _batches(digests(), schema)

    narrow = rows.select(quoted(conv_id).alias("conv_id"), "place", "role", "text")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(
        run, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", conv_id)
