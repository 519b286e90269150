"""Nearest neighbours against all pairs: recall, exact scores, ties, and rows that take no part."""

import math

import numpy as np
import pytest

from taktwerk.llm import nearest
from taktwerk.llm.queries import QUERIES


def score(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def plain(rows, divisor=20, k=20):
    """{(query id, its vector): [(vec_id, score)]} over all pairs, in double precision."""
    fine = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    fine = sorted(set(fine))
    out = {}
    for q, v in fine:
        if q % divisor == 0:
            others = [(-score(v, w), i) for i, w in fine if (i, w) != (q, v) and len(w) == len(v)]
            out[q, v] = [(i, -s) for s, i in sorted(others)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for found in out.values():
        assert sorted(f[0] for f in found) == list(range(1, len(found) + 1))
    return {q: [f[1:] for f in sorted(found)] for q, found in out.items()}


def recall(found, rows):
    expected = {q: v for (q, _), v in plain(rows).items()}
    assert set(found) == set(expected)
    hits = 0
    for q, best in expected.items():
        assert len(found[q]) == len(best)
        true = dict(best)
        hits += len({i for i, _ in found[q]} & set(true))
        assert all(s == true[i] for i, s in found[q] if i in true)
        assert found[q] == sorted(found[q], key=lambda f: (-f[1], f[0]))
    return hits / sum(map(len, expected.values()))


def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(by_query(QUERIES["op13_nearest"](spark, sf)), rows) >= 0.9


@pytest.mark.parametrize("norms", ["equal", "uneven"])
def test_recall_with_cells_and_blocks(spark, monkeypatch, norms):
    """Small blocks, so that the tree has cells, cells have several blocks, and leaves are pruned."""
    for name, value in (("BLOCK", 256), ("LEAF", 16), ("PACK", 32), ("QUERIES", 100)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16)) * 3
    v = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None] if norms == "equal" else 1
    rows = [(int(i), [float(x) for x in w]) for i, w in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7)
    assert recall(by_query(nearest.nearest(df)), rows) >= 0.9


def test_pruned(spark):
    """Far fewer pairs than all are verified where vectors lie in groups."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((50, 32))[rng.integers(0, 50, 5000)] * 4 + rng.standard_normal((5000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    order, starts = nearest.leaf_order(nearest.projected(v, 1.0))
    found, verified = nearest.search(order, v[order], starts, 1.0, np.arange(100), v[:100], np.full(100, -np.inf))
    assert verified < 0.2 * 100 * 5000
    true = np.argsort(-(v[:100] @ v.T) + 9 * np.eye(100, 5000), axis=1)[:, :20]
    assert np.mean([len(set(f[0]) & set(t)) / 20 for f, t in zip(found, true)]) > 0.9


def test_chi_square():
    assert nearest.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert nearest.chi_square_quantile(0.5, 2) == pytest.approx(2 * math.log(2), abs=1e-6)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.25, -1.0]
    rows = [(i, same) for i in range(0, 200)] + [(i, [1.0, 0.0, float(i % 3)]) for i in range(200, 260)] + [(20, same), (20, [2.0, 2.0, 2.0])]
    rows += [(None, same), (300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 0.0]), (360, [1.0, nan, 0.0]), (380, [inf, 1.0, 1.0]), (400, []), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (440, [1.0, 2.0, 3.0, 4.0]), (-20, [-1.0, 0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "vec_id bigint, embedding array<double>, dim int, key string, cell int").repartition(3)
    expected = plain(rows)
    found = {}
    for r in nearest.nearest(df).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in {q for q, _ in expected}:
        assert sorted(found.get(q, [])) == sorted(f for (i, _), best in expected.items() if i == q for f in best), q
    assert set(found) == {q for (q, _), best in expected.items() if best}
    assert found[420] == [(421, 4.0)] and 440 not in found
    assert nearest.nearest(df.limit(0)).collect() == []
