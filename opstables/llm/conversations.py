"""Repair of conversations: the cheapest edits that make the roles alternate, and what was wrong before.

Faults need no text in order: rows are counted and compared by hashes.  Then the turns, ordered by range partitions,
become strings of symbols, cut into pieces; a piece's repair is a matrix (grammar.py), and a conversation's pieces are
multiplied in order.  So neither the rows nor the edits of one conversation need one task's memory.  Repaired texts stream through the task
of their conversation in order (a hash over all of them leaves no other way).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opstables.llm import grammar
from opstables.llm.common import SPACES, fits_broadcast, stored

#: Turns of a piece.
PIECE_TURNS = 65_536
#: Letters of pieces whose matrices a task remembers.
REMEMBERED = 2_000_000
#: Rows that a batch hands on.
_ROWS = 2048
_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal", "distinct_turns")
_PIECES = ", ".join(f"{c} long" for c in ("place", *_COUNTS, "min_turn", "max_turn")) + ", first string, last string, costs array<long>, audits array<string>"
_AUDITS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


def _shown(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations, damaged by the crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out its . ! and ?, 3 repeats it, 4 makes its role user.  Nulls count as one space.
    """
    h = F.crc32(F.concat_ws(":", _shown("conv_id"), _shown("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(_shown("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(_shown("text"), ".!?", "")).otherwise(_shown("text")).alias("text"), h.alias("h"),
    )
    return rows.withColumn("_copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).where("h <> 0").drop("h", "_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", _shown("role").alias("role"), F.md5(_shown("text")).alias("h"), _shown("text").alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, h, n, fault, seen: the distinct rows (h: hash of the text), how often each stands there, and its fault.

    fault: blank, truncated or null.  seen: its role and text stand at an earlier turn; of n equal rows, all but the first are duplicates as well.
    """
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    counted = stored(_keyed(rows).withColumn("fault", fault).groupBy("conv_id", "turn", "role", "h", "fault").agg(F.count("*").alias("n")), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))  # nulls first
    again = counted.groupBy("conv_id", "role", "h").agg(F.min(at).alias("first"), F.count("*").alias("places")).where("places > 1")
    again = stored(again.select(F.col("conv_id").alias("a_conv"), F.col("role").alias("a_role"), F.col("h").alias("a_h"), "first"), "turns-again")
    small = fits_broadcast(again.count(), 120)
    same = F.col("conv_id").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) & (F.col("h") == F.col("a_h"))
    both = counted.join(F.broadcast(again) if small else again, same, "left")
    return both.select("conv_id", "turn", "role", "h", "n", "fault", (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(at)).alias("seen"))


class _Piece:
    def __init__(self, conv: Any, place: int) -> None:
        self.conv, self.place, self.symbols = conv, place, ""
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.min_turn: int | None = None
        self.max_turn: int | None = None
        self.first, self.last = "", ""

    def add(self, turn: int | None, initial: str, fault: str | None, n: int) -> None:
        """n equal rows."""
        c = self.counts
        if turn is not None:
            c["distinct_turns"] += turn != self.max_turn
            self.min_turn, self.max_turn = turn if self.min_turn is None else self.min_turn, turn
        c["turns"] += n
        c["illegal"] += n - 1 + bool(self.last and self.last + initial not in _LEGAL)
        if fault:
            c[fault] += n
        self.first, self.last = self.first or initial, initial
        self.symbols += ("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial) * n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Piece]]:
    """The pieces of sorted rows, some at a time."""
    piece: _Piece | None = None
    place = TaskContext.get().partitionId() << 32
    for batch in batches:
        done = []
        for conv, turn, role, n, fault, seen in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault", "seen")), strict=True):
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            first = 0 if seen and fault != "blank" else 1  # the first of equal rows is no duplicate
            runs = [(n, fault)] if fault == "blank" else [(first, fault), (n - first, "duplicate")]
            for left, kind in runs:
                while left:
                    if piece is None or piece.conv != conv or len(piece.symbols) >= PIECE_TURNS:
                        done += [piece] if piece else []
                        place += 1
                        piece = _Piece(conv, place)
                    some = min(left, PIECE_TURNS - len(piece.symbols))
                    piece.add(turn, initial, kind, some)
                    left -= some
        yield done
    if piece:
        yield [piece]


def _solved(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pieces with their matrices; equal pieces and equal rules are solved once for the task."""
    rules, known, letters = grammar.Grammar(), {}, 0
    for pieces in _pieces(batches):
        new = sorted({p.symbols for p in pieces} - known.keys())
        if letters > REMEMBERED or len(rules) > grammar.MOST_RULES:
            rules, known, letters = grammar.Grammar(), {}, 0
            new = sorted({p.symbols for p in pieces})
        letters += sum(map(len, new))
        for symbols, m in zip(new, rules.matrices(new), strict=True):
            known[symbols] = [x and x[0] for x in m], [x and grammar.text_of(x[1]) for x in m]
        for k in range(0, len(pieces), _ROWS):
            some = pieces[k : k + _ROWS]
            columns = [[p.conv for p in some], [p.place for p in some], *([p.counts[c] for p in some] for c in _COUNTS), [p.min_turn for p in some], [p.max_turn for p in some]]
            columns += [[p.first for p in some], [p.last for p in some], *([known[p.symbols][i] for p in some] for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each conversation's sums and audit, from its pieces in order."""
    total: dict[str, Any] | None = None
    held: list[dict[str, Any]] = []

    def ended(t: dict[str, Any]) -> dict[str, Any]:
        cost, audit = grammar.finish(t["ways"])
        gaps = 0 if t["min_turn"] is None else min(t["max_turn"] - t["min_turn"] + 1 - t["distinct_turns"], 2**63 - 1)
        return {k: t[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit}

    for batch in batches:
        for p in batch.to_pylist():
            if total is None or total["conv_id"] != p["conv_id"]:
                held += [ended(total)] if total else []
                total = {"conv_id": p["conv_id"], **dict.fromkeys(_COUNTS, 0), "min_turn": None, "max_turn": None, "last": "", "ways": grammar.UNCHANGED[:4]}
            total["illegal"] += bool(total["last"] and total["last"] + p["first"] not in _LEGAL)
            if p["min_turn"] is not None:
                total["distinct_turns"] -= total["max_turn"] == p["min_turn"]
                total["min_turn"], total["max_turn"] = p["min_turn"] if total["min_turn"] is None else total["min_turn"], p["max_turn"]
            for c in _COUNTS:
                total[c] += p[c]
            total["last"] = p["last"]
            m = [None if c is None else (c, grammar.leaf(a)) for c, a in zip(p["costs"], p["audits"], strict=True)]
            total["ways"] = grammar.times(total["ways"] + [None] * 12, m)[:4]
            if len(held) >= _ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
    yield pa.RecordBatch.from_pylist(held + ([ended(total)] if total else []), schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation of rows (conv_id, turn, role, text).

    Turns are in order, nulls first; rows of one turn by role and hash of the text.  A row's first fault counts: blank (only white space),
    duplicate (role and text stand earlier), truncated (its last character that isn't white space is none of . ! ?).  gaps: turns missing
    between the least and the largest.  illegal: neighbours whose initials aren't su, ua or au.  audit: the cheapest edits by their
    initials, one for each row and insert in order, that leave roles (s?(ua)+)?; of several the ASCII-least.

    Nulls count as one space, in role and text; a null conv_id is a conversation.  Roles that begin with none of s, u, a can't be kept.
    Repeated rows are duplicates.  Texts are read whole; an empty table gives no rows.  Other columns aren't read.
    """
    found = faults(rows)
    conv = StructType([found.schema["conv_id"]])
    pieces, whole = (StructType(conv.fields + StructType.fromDDL(more).fields) for more in (_PIECES, _AUDITS))
    solved_as, whole_as = to_arrow_schema(pieces), to_arrow_schema(whole)
    ordered = stored(found, "faults").repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h")
    solved = stored(ordered.mapInArrow(lambda it: _solved(it, solved_as), pieces), "pieces")
    return solved.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(lambda it: _whole(it, whole_as), whole)


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, audit), each conversation's audit first, as repaired."""
    conv: Any = None
    audit, at, place, state = "", 0, 0, grammar.NOTHING
    out: list[dict[str, Any]] = []

    def put(role: str, text: str, kept: bool = False) -> None:
        nonlocal place, state
        if not kept:
            role = "assistant" if state == grammar.USER else "user"
        state = {"s": grammar.SYSTEM, "u": grammar.USER, "a": grammar.ASSISTANT}[role[0]]
        out.append({"conv_id": conv, "place": place, "role": role, "text": text})
        place += 1

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("", "")
            at += 1

    for batch in batches:
        for row_conv, role, text, row_audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit")), strict=True):
            if row_audit is not None:
                inserts()
                conv, audit, at, place, state = row_conv, row_audit, 0, 0, grammar.NOTHING
                continue
            inserts()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(role, text, edit == "K")
        yield pa.RecordBatch.from_pylist(out, schema=schema)
        out = []
    inserts()
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the rows with their conversation's audit (conv_id, audit) applied.

    Each conversation's rows stand in one partition, in order.  A conversation of which nothing stays has none.
    """
    turns = _keyed(rows).withColumn("audit", F.lit(None).cast("string"))
    first = audit.select("conv_id", *(F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "h", "text")), F.coalesce("audit", F.lit("")).alias("audit"))
    both = turns.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "h")
    schema = StructType([turns.schema["conv_id"]] + StructType.fromDDL("place long, role string, text string").fields)
    as_arrow = to_arrow_schema(schema)
    return both.mapInArrow(lambda it: _edited(it, as_arrow), schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    conv, hasher = None, None
    for batch in batches:
        done = []
        for row_conv, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if place == 0:
                done += [(conv, hasher.hexdigest())] if hasher else []
                conv, hasher = row_conv, hashlib.sha256()
            hasher.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema=schema)
    if hasher:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (conv, hasher.hexdigest()), strict=True))], schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the hash of the lines `role:text` of repaired()."""
    schema = StructType([turns.schema["conv_id"]] + StructType.fromDDL("repaired_sha256 string").fields)
    as_arrow = to_arrow_schema(schema)
    return turns.mapInArrow(lambda it: _digests(it, as_arrow), schema)
