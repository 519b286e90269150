"""Repaired conversations against a plain search over all edits, row by row."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from taktwerk.llm import conversation_repair as repair
from taktwerk.llm.queries import QUERIES

AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}  # what may follow what
WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """Cost and edits of rows (initial, must go, truncated): the least (cost, edits) over all scripts."""

    @functools.cache
    def best(i, last, put):
        found = [(0, "")] if i == len(rows) and last in ("", "a") else []
        if put < 3:
            found += [(3 + c, "I" + e) for role in "ua" if role in AFTER[last] for c, e in [best(i, role, put + 1)]]
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, e = best(i + 1, last, 0)
            found.append((4 + c, "D" + e))
            if not gone:
                roles = [(0, "K", initial)] + [(3, "R", r) for r in "ua"]
                found += [(base + 3 * cut + c, letter + e) for base, letter, r in roles if r in AFTER[last] for c, e in [best(i + 1, r, 0)]]
        return min(found, default=(10**9, ""))

    for i in range(len(rows), 0, -1):  # fills the cache, so that no recursion goes deep
        for last in AFTER:
            best(i, last, 0)
    return best(0, "", 0)


def plain_repair(rows):
    """The result of one conversation of rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        words = WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = plain(tuple(marked))
    lines, last, left = [], "", iter(rows)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(left)[1:]
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if last == "u" else "user"
        last = role[0]
        lines.append(f"{role}:{text}")
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **faults, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: plain_repair(kept) for conv, kept in out.items()}


def as_dict(df):
    rows = [r.asDict() for r in df.collect()]
    out = {r.pop("conv_id"): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_symbols_against_plain_search():
    rng = random.Random(2)
    mean = lambda s: ("sua-"[s >> 1] if s < 8 else "u", s == 8, bool(s & 1) and s < 8)
    cases = [s for n in range(4) for s in itertools.product(range(9), repeat=n)] + [tuple(rng.choices(range(9), k=rng.randint(4, 40))) for _ in range(1500)]
    for case in cases:
        assert repair.cheapest(bytes(case)) == plain(tuple(map(mean, case))), case


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_block_size_changes_nothing(size):
    rng = random.Random(size)
    for _ in range(200):
        case = bytes(rng.choices(range(9), k=rng.randint(0, 60)))
        assert repair.cheapest(case, size) == repair.cheapest(case)


def test_few_vectors():
    t = repair.tables()
    assert len(t.vectors) < 100 and max(map(max, t.vectors)) <= 12 and len(t.block[0]) == repair.SYMBOLS**repair.BLOCK


def test_query_against_plain(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op12_conversation_repair"](spark, sf)) == plain_damage(rows)


def edge_rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "and then", "", " \t\n", "Why?  \n", "x" * 200_000, "Ä.", "end. ", None, "Yes.", "a.b"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "s"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [1, 2, 3, 4, 5, None] for t in [None, None, 0, 1, 1, 2, 5, 6, 7, 9]]
    return rows + [(6, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(700)] + rows[:4] + [(7, 3, "user", "same.")] * 300


def test_edges(spark):
    rows = edge_rows()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, kind int, digest string, audit string").repartition(5)
    expected = plain_damage(rows)
    assert as_dict(repair.repaired(df, repair.damaged(df))) == expected
    assert {None, 7} <= set(expected)
    assert as_dict(repair.repaired(df.limit(0), repair.damaged(df.limit(0)))) == {}


def test_all_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    (row,) = as_dict(repair.repaired(df, repair.damaged(df))).values()
    assert row == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
