"""The audit of filters against applying them, order by order."""

import itertools
import re
from collections import Counter

from taktwerk.llm import filter_audit


def plain(docs, labels):
    docs = [(d, part or "", text or "") for d, part, text in docs]
    good, toxic = ({d for d, *flags in labels if flags[i] == 1 and d is not None} for i in (0, 1))
    first = {}
    for d, _, text in docs:
        if d is not None:
            first[text] = min(d, first.get(text, d))
    out = {}
    for part in {p for _, p, _ in docs}:
        rows = []
        for d, p, text in docs:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            if p == part:
                fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > first[text]}
                rows.append((d, {k for k, v in fails.items() if v}))
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in r[1] for r in rows) - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_intervals():
    """Each order removes each mask at exactly one step: that of the first letter in it."""
    for n in (1, 2, 3, 5):
        orders = list(itertools.permutations(range(n)))
        steps = {}
        for mask, step, start, end in filter_audit.removal_intervals(n):
            for rank in range(start, end):
                assert steps.setdefault((mask, rank), step) == step
        assert steps == {(mask, r): next(s for s, f in enumerate(o, 1) if mask >> f & 1) for mask in range(1, 1 << n) for r, o in enumerate(orders)}


def test_edges(spark, edges):
    words = " ".join(f"w{i}" for i in range(120))
    more = [(20, "LOUD " * 120, "en"), (21, words, "en"), (22, words, "xx"), (22, words, "xx"), (23, words + " #", None), (24, words, ""), (None, words, "en"), (-5, words + " TAIL", "de"), (30, "a b " * 80, "en"), (31, "a b " * 80, "en")]
    extra = spark.createDataFrame(more, "doc_id bigint, text string, lang string")
    docs = edges.unionByName(extra, allowMissingColumns=True)
    labels = [(1, 1, 0), (1, 0, 1), (20, 0, 1), (21, 1, None), (22, 1, 1), (None, 1, 1), (99, 1, 1), (6, None, 1)]
    expected = plain([(r.doc_id, r.lang, r.text) for r in docs.collect()], labels)
    table = spark.createDataFrame([(*x, "t") for x in labels], "doc_id bigint, quality int, toxic int, text string")
    got = as_dict(filter_audit.filter_audit(docs, table))
    assert got == expected
    assert len(got) == 600 * len({p for p, _, _ in expected})
    assert as_dict(filter_audit.filter_audit(docs, table.limit(0))) == plain([(r.doc_id, r.lang, r.text) for r in docs.collect()], [])


def test_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.filter_audit(nothing, labels).collect() == []
