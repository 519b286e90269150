"""Repair of conversations whose rows were dropped, emptied, cut or repeated, by the cheapest edits.

The roles of a repaired conversation read ``(s?(ua)+)?``, an automaton of four states. From the last row back, each
state has a least cost to finish; only the differences between the four costs matter, they are bounded, and so few
different vectors of them exist. Tables (Four-Russians) hold, for every vector and every block of ``BLOCK`` symbols,
the vector before the block and what it adds, so a conversation is read a block at a time by lookup. The edits are
then traced from the front: a block is expanded backward from the vector behind it, symbol by symbol, and at each row
the ASCII-least edit that keeps the least cost is taken, which gives the least of all cheapest edit strings.

On Spark: rows without texts are sorted by conversation and turn and read as a stream of one symbol each; a second
stream, of the texts with the edits before them, yields the digests. A task holds a byte for each row and edit of
one conversation and one batch of texts, and a conversation of any length is read in order, as its one digest asks.

Defined results: nulls are one space (a null key is the conversation of that key); the initial of an empty role is
empty, which no order allows; rows of one turn go by role and a digest of the text, equal rows side by side; an empty
table gives an empty table; a conversation all of whose rows were dropped has zeros; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from taktwerk.llm import common

BLOCK = 4
SPACES = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- symbols and the automaton

#: A symbol is 2 * (initial) + truncated, initials s, u, a, other; the last one is a row that must go.
INITIALS = "sua"
GONE = 8
SYMBOLS = 9
#: States: nothing yet, after s, after u, after a. The next state by initial, and by the role that is put in.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT_IN = tuple("a" if "a" in after else "u" for after in NEXT)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Least cost to finish after the last row.
END = (0, 2 * INSERT, INSERT, 0)


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to finish before a symbol, from those behind it."""
    edited = []
    for state in range(4):
        costs = [DELETE + after[state]]
        if symbol != GONE:
            extra, initial = TRUNCATED * (symbol & 1), (INITIALS + "-")[symbol >> 1]
            if initial in NEXT[state]:
                costs.append(KEEP + extra + after[NEXT[state][initial]])
            costs.append(REROLE + extra + after[NEXT[state][PUT_IN[state]]])
        edited.append(min(costs))
    for _ in range(2):  # an inserted row leads to state 2 or 3, and from one of them to the other
        edited = [min(c, INSERT + edited[NEXT[s][PUT_IN[s]]]) for s, c in enumerate(edited)]
    return tuple(edited)


def _edits(symbol: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest letters from a state up to and with a symbol, and the state behind it."""
    costs, letters = _before(symbol, after), ""
    while True:
        goal, put = costs[state], NEXT[state][PUT_IN[state]]
        if DELETE + after[state] == goal:
            return letters + "D", state
        if INSERT + costs[put] == goal:
            letters, state = letters + "I", put
            continue
        extra, initial = TRUNCATED * (symbol & 1), (INITIALS + "-")[symbol >> 1]
        if initial in NEXT[state] and KEEP + extra + after[NEXT[state][initial]] == goal:
            return letters + "K", NEXT[state][initial]
        return letters + "R", put


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]
    step: np.ndarray  # [vector, symbol] -> vector before it
    step_cost: np.ndarray
    block: list[list[int]]  # [vector][block code] -> vector before the block
    block_cost: list[list[int]]
    edits: list[tuple[str, int]]  # [(vector * SYMBOLS + symbol) * 4 + state]
    end: int


@functools.cache
def tables(size: int = BLOCK) -> Tables:
    """All normalised vectors that can occur, and the steps between them by symbol and by block of ``size`` symbols."""
    vectors, number = [END], {END: 0}
    step, cost = [], []
    for v in vectors:  # grows meanwhile
        step.append([])
        cost.append([])
        for symbol in range(SYMBOLS):
            before = _before(symbol, v)
            least = min(before)
            normal = tuple(c - least for c in before)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            step[-1].append(number[normal])
            cost[-1].append(least)
    one, one_cost = np.array(step), np.array(cost)
    at, total = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), int)
    for _ in range(size):  # a symbol more in front of the block: the highest digit of its code
        at, total = one[at].transpose(0, 2, 1).reshape(len(vectors), -1), (total[:, :, None] + one_cost[at]).transpose(0, 2, 1).reshape(len(vectors), -1)
    edits = [_edits(symbol, state, v) for v, symbol, state in itertools.product(vectors, range(SYMBOLS), range(4))]
    return Tables(vectors, one, one_cost, at.tolist(), total.tolist(), edits, 0)


def cheapest(symbols: bytes, size: int = BLOCK) -> tuple[int, str]:
    """Least cost and ASCII-least cheapest edits of a conversation given as symbols."""
    t = tables(size)
    head = len(symbols) % size
    digits = np.frombuffer(symbols, np.uint8, offset=head).reshape(-1, size).astype(np.int64)
    codes = (digits @ (SYMBOLS ** np.arange(size - 1, -1, -1))).tolist()
    vector, cost, behind = t.end, 0, bytearray() if len(t.vectors) < 256 else []
    for code in reversed(codes):
        behind.append(vector)
        cost += t.block_cost[vector][code]
        vector = t.block[vector][code]
    bounds, state, letters = [(0, head, vector)], 0, []
    for symbol in reversed(symbols[:head]):
        cost += int(t.step_cost[vector, symbol])
        vector = int(t.step[vector, symbol])
    cost += t.vectors[vector][0]
    bounds = itertools.chain(bounds, ((head + i * size, head + (i + 1) * size, v) for i, v in enumerate(reversed(behind))))
    for lo, hi, v in bounds:
        inner = []
        for symbol in reversed(symbols[lo:hi]):
            inner.append(v)
            v = int(t.step[v, symbol])
        for symbol, v in zip(symbols[lo:hi], reversed(inner)):
            some, state = t.edits[(v * SYMBOLS + symbol) * 4 + state]
            letters.append(some)
    letters.append("I" * (END[state] // INSERT))
    return cost, "".join(letters)


# ---------------------------------------------------------------- damage


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by the crc32 of ``conv_id:turn``; dropped rows are left out."""
    kind = F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")).cast("binary")) % 20
    df = conversations.select("conv_id", "turn", _spaced("role").alias("role"), _spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# ---------------------------------------------------------------- streams of sorted rows


def _runs(batches: Iterator[pa.RecordBatch], start: Callable, row: Callable, end: Callable, schema: pa.Schema, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Reads sorted rows, conversation by conversation: ``start(conv)`` makes a state, ``row(state, row)`` adds to it,
    ``end(conv, state)`` gives the row that goes out."""
    conv, state, out, size = None, None, [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns):
            if state is None or values[0] != conv:
                if state is not None:
                    out.append(end(conv, state))
                conv, state = values[0], start(values[0])
            row(state, values)
        if len(out) >= at_once:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if state is not None:
        out.append(end(conv, state))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


class _Seen:
    """What is known of a conversation while its rows go by."""

    def __init__(self) -> None:
        self.symbols, self.last, self.turn, self.turns, self.low, self.illegal = bytearray(), None, None, 0, None, 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}


ORDERS = {"su", "ua", "au"}


def _add(seen: _Seen, values: tuple) -> None:
    _, turn, initial, fault, repeat, copies = values
    if turn is not None and (seen.turns == 0 or turn != seen.turn):
        seen.low = turn if seen.turns == 0 else seen.low
        seen.turn, seen.turns = turn, seen.turns + 1
    plain = 2 * (INITIALS.index(initial) if initial in INITIALS and initial else 3)
    if fault == "blank":
        seen.symbols += bytes([GONE]) * copies
        seen.faults["blank"] += copies
    else:
        whole = 0 if repeat else 1
        if whole:
            seen.symbols.append(plain + (fault == "truncated"))
            seen.faults["truncated"] += fault == "truncated"
        seen.symbols += bytes([GONE]) * (copies - whole)
        seen.faults["duplicate"] += copies - whole
    seen.illegal += (seen.last is not None and seen.last + initial not in ORDERS) + (copies - 1) * (initial * 2 not in ORDERS)
    seen.last = initial


_FOUND = "conv_id {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def edits(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation of ``rows(conv_id, turn, role, text)``."""
    inner = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(inner == "", "blank").when(~F.substr(inner, F.lit(-1), F.lit(1)).isin(*".!?"), "truncated").otherwise("none")
    marked = rows.select("conv_id", "turn", "role", _digest().alias("digest"), fault.alias("fault"))
    same = marked.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("*").alias("copies"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    small = same.select("conv_id", "turn", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), "fault", seen.alias("repeat"), "copies", "role", "digest")
    small = small.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest").drop("role", "digest")

    def end(conv: object, seen: _Seen) -> dict:
        cost, audit = cheapest(bytes(seen.symbols))
        gaps = seen.turn - seen.low + 1 - seen.turns if seen.turns else 0
        return {"conv_id": conv, "gaps": gaps, **seen.faults, "illegal": seen.illegal, "cost": cost, "audit": audit}

    schema = _FOUND.format(dict(rows.dtypes)["conv_id"])
    arrow = _arrow(schema)
    return small.mapInArrow(lambda batches: _runs(batches, lambda _: _Seen(), _add, end, arrow), schema)


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema))


class _Written:
    """A conversation's digest while its repaired rows go by, and where in the edits it stands."""

    def __init__(self) -> None:
        self.audit, self.at, self.state, self.hash, self.lines = "", 0, 0, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.line(ROLES[PUT_IN[self.state]], "")
            self.state, self.at = NEXT[self.state][PUT_IN[self.state]], self.at + 1

    def row(self, values: tuple) -> None:
        _, audit, role, text = values
        if audit is not None:
            self.audit = audit
            return
        self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.line(role, text)
            self.state = NEXT[self.state][role[0]]
        elif edit == "R":
            self.line(ROLES[PUT_IN[self.state]], text)
            self.state = NEXT[self.state][PUT_IN[self.state]]


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from the rows and the ``audit`` of each conversation, which goes in front of its rows."""
    first = found.select("conv_id", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("digest"))
    rest = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "role", "text", F.lit(1).alias("kind"), "turn", _digest().alias("digest"))
    both = first.unionByName(rest).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("turn").asc_nulls_first(), "role", "digest").drop("kind", "turn", "digest")

    def end(conv: object, state: _Written) -> dict:
        state.inserted()
        return {"conv_id": conv, "repaired_sha256": state.hash.hexdigest()}

    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, repaired_sha256 string"
    arrow = _arrow(schema)
    return both.mapInArrow(lambda batches: _runs(batches, lambda _: _Written(), _Written.row, end, arrow), schema)


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``conversations``: the faults of ``rows``, the cheapest edits, the digest of what they make."""
    found = common.save(edits(rows), "conversation_edits")
    known = found.join(digests(rows, found).withColumnRenamed("conv_id", "conv_id_"), F.expr("conv_id <=> conv_id_")).drop("conv_id_")
    every = conversations.select(F.col("conv_id").alias("every_")).distinct()
    out = every.join(known, F.expr("every_ <=> conv_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select(F.col("every_").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
