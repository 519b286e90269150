"""Nearest neighbours by inner product: stable projections, kd-trees, and a chi-square stopping test.

Vectors get one more coordinate that brings all to the largest norm M, and queries are scaled to M, so that the largest
inner product is the smallest Euclidean distance. ``PROJECTED`` Gaussian projections keep distances in law: a vector at
distance d has a squared projected distance of d**2 times a chi-square variable. A search that has looked at all
vectors within projected distance r, and whose k-th nearest so far is at distance d, stops once the chi-square
distribution gives r**2 / d**2 at least ``CONFIDENCE``: a nearer vector is then still unseen with less than the rest.

The index is a kd-tree over the projections. Its upper levels, the cells, are split by medians of a bounded sample
(``SAMPLE`` rows by smallest hash) and by the number of rows; every other row is then put into its cell, cells are cut
into blocks of bounded size by a hash, and each block gets the lower levels from its own rows. A query verifies the
sample in full, and its k-th distance there bounds the cells that it must visit; within a block, leaves are opened in the order of
their projected distance, and vectors verified shell by shell until the test holds. Nothing else caps candidates.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat id and vector are one; rows that share an id but not the vector are each a query and a
candidate, and a query leaves out only itself; a query meets vectors of its own length; with fewer than k candidates
all are returned; ties go to the smaller id, and of a vector with many copies the k + 1 smallest ids are searched,
which are all that can be returned; an empty table gives an empty table; other columns are not read. Scores are
sums in order of the coordinates in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taktwerk.llm import common

PROJECTED = 8
CONFIDENCE = 0.95
NEAREST = 20
#: Rows that choose the upper splits and give each query its first distance: one in SAMPLE_SHARE, up to SAMPLE.
SAMPLE, SAMPLE_SHARE = 4096, 16
#: Vectors of a block, and of a leaf of its tree; queries that meet a block at a time.
BLOCK, LEAF, PACK = 8192, 128, 256
#: Queries that one copy of a block serves.
QUERIES = 1 << 16
#: Levels of the tree that the sample may choose: cells keep 16 sample rows or more, and larger cells become more blocks.
MAX_LEVELS = 8
SHELLS = 4


# ---------------------------------------------------------------- the test


def chi_square(x: float, degrees: int) -> float:
    """The distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 10.0 * degrees + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


# ---------------------------------------------------------------- geometry


def directions(dim: int, m: int = PROJECTED) -> np.ndarray:
    """Gaussian directions for vectors of a length and their added coordinate, the same in every task."""
    return np.random.default_rng([7, dim, m]).standard_normal((dim + 1, m))


def projected(vectors: np.ndarray, norm: float, m: int = PROJECTED) -> np.ndarray:
    g = directions(vectors.shape[1], m)
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
    return vectors @ g[:-1] + rest[:, None] * g[-1]


def projected_queries(queries: np.ndarray, norm: float, m: int = PROJECTED) -> np.ndarray:
    return scaled(queries, norm) @ directions(queries.shape[1], m)[:-1]


def scaled(queries: np.ndarray, norm: float) -> np.ndarray:
    return queries * (norm / np.sqrt(np.einsum("ij,ij->i", queries, queries)))[:, None]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each the sum in order of the coordinates: equal vectors get equal scores anywhere."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def splits(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """(axis, value) of the inner nodes of a full kd-tree in breadth-first order; the axis of the largest spread is cut at its median."""
    nodes, out = [points], []
    for _ in range(levels):
        deeper = []
        for p in nodes:
            axis = int(np.argmax(p.max(0) - p.min(0))) if len(p) else 0
            value = float(np.median(p[:, axis])) if len(p) else 0.0
            out.append((axis, value))
            below = p[:, axis] <= value if len(p) else np.zeros(0, bool)
            deeper += [p[below], p[~below]]
        nodes = deeper
    return out


def cells_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """The leaf of a full tree that each point falls into."""
    at = np.zeros(len(points), np.int64)
    axes, values = np.array([a for a, _ in tree], np.int64), np.array([v for _, v in tree])
    while len(tree) and len(at) and at[0] < len(tree):
        at = 2 * at + 1 + (points[np.arange(len(points)), axes[at]] > values[at])
    return at - len(tree)


def cell_distances(queries: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """Squared distances from queries to the leaves' boxes of a full tree, in the projected space."""
    boxes = [(np.full(queries.shape[1], -np.inf), np.full(queries.shape[1], np.inf))]
    for at, (axis, value) in enumerate(tree):
        low, high = boxes[at]
        left, right = high.copy(), low.copy()
        left[axis], right[axis] = min(high[axis], value), max(low[axis], value)
        boxes += [(low, left), (right, high)]
    leaves = boxes[len(tree) :]
    return box_distances(queries, np.array([b[0] for b in leaves]), np.array([b[1] for b in leaves]))


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(queries), len(low)))
    for j in range(queries.shape[1]):
        q = queries[:, j, None]
        out += np.maximum(np.maximum(low[None, :, j] - q, q - high[None, :, j]), 0) ** 2
    return out


def leaf_order(points: np.ndarray, most: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """The order that puts a kd-tree's leaves side by side, and where they begin (with the end)."""
    order, starts = np.arange(len(points)), [0]
    stack = [(0, len(points))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= most:
            starts.append(hi)
            continue
        part = points[order[lo:hi]]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        middle = (hi - lo) // 2
        order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], middle)]
        stack += [(lo + middle, hi), (lo, lo + middle)]
    return order, starts


# ---------------------------------------------------------------- search in one block


def kth_largest(products: np.ndarray, k: int) -> np.ndarray:
    n = products.shape[1]
    return np.partition(products, n - k, axis=1)[:, n - k] if n >= k else np.full(len(products), -np.inf)


def best_of(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, products: np.ndarray, bounds: np.ndarray, norm: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of each query's k largest products that reach its bound, scored exactly; -inf is no product.

    Products come from matrix multiplication, whose last bits depend on the place, so what lies within their error of
    the bound is scored again before ties are resolved.
    """
    least = bounds - 1e-9 * norm * np.sqrt(np.einsum("ij,ij->i", queries, queries))
    out = []
    for q, row in enumerate(products):
        at = np.flatnonzero((row >= least[q]) & ~np.isneginf(row))
        scores = exact_scores(np.broadcast_to(queries[q], (len(at), queries.shape[1])), vectors[at])
        best = np.lexsort((ids[at], -scores))[:k]
        out.append((ids[at][best], scores[best]))
    return out


def search(ids: np.ndarray, vectors: np.ndarray, starts: list[int], norm: float, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int = NEAREST, confidence: float = CONFIDENCE) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query (ids, scores) of its k nearest in a block that may be among its nearest at all, and the number of pairs verified.

    ``bounds`` holds inner products that k vectors elsewhere reach already (-inf without). Leaves are opened in order
    of the distance to their boxes, and in shells of growing projected distance their vectors' products are taken.
    """
    quantile = chi_square_quantile(confidence, PROJECTED)
    ways = norm / np.sqrt(np.einsum("ij,ij->i", queries, queries))

    def within(products: np.ndarray) -> np.ndarray:
        """The squared projected distance at which the test holds, if the k-th nearest has these products."""
        known = ~np.isneginf(products)
        return np.where(known, quantile * np.maximum(2 * norm * norm - 2 * ways * np.where(known, products, 0), 0), np.inf)

    points, asked = projected(vectors, norm), projected_queries(queries, norm)
    leaves = list(zip(starts[:-1], starts[1:]))
    low, high = np.array([points[a:b].min(0) for a, b in leaves]), np.array([points[a:b].max(0) for a, b in leaves])
    distance = box_distances(asked, low, high)
    near = np.full((len(queries), len(vectors)), np.inf)  # projected distances, once a leaf is open
    products = np.full((len(queries), len(vectors)), -np.inf)  # of verified vectors
    opened = np.zeros(distance.shape, bool)
    by_id = np.argsort(ids, kind="stable")
    left, right = np.searchsorted(ids[by_id], query_ids, "left"), np.searchsorted(ids[by_id], query_ids, "right")
    own = np.zeros((len(queries), len(vectors)), bool)
    for q in np.flatnonzero(right > left):
        own[q, [i for i in by_id[left[q] : right[q]] if np.array_equal(vectors[i], queries[q])]] = True

    reach = within(bounds)
    kth, done, verified = bounds.copy(), np.zeros(len(queries)), 0
    active = np.ones(len(queries), bool)
    for shell in range(SHELLS + 1):
        if shell:
            far = np.where(np.isfinite(reach), reach * shell / SHELLS, np.inf)
        else:  # without a bound, the nearest leaf tells how far k vectors are
            far = np.full(len(queries), -1.0)
            for q in np.flatnonzero(np.isinf(reach)):
                a, b = leaves[int(np.argmin(distance[q]))]
                some = np.sort(((points[a:b] - asked[q]) ** 2).sum(1))
                far[q] = some[min(k, len(some) - 1)]
        far = np.where(active, far, -1.0)
        for at, (a, b) in enumerate(leaves):
            rows = np.flatnonzero(distance[:, at] <= far)
            if not len(rows):
                continue
            fresh = rows[~opened[rows, at]]
            if len(fresh):
                p = points[a:b]
                near[fresh, a:b] = np.einsum("ij,ij->i", asked[fresh], asked[fresh])[:, None] - 2 * asked[fresh] @ p.T + np.einsum("ij,ij->i", p, p)[None, :]
                opened[fresh, at] = True
            inside = (near[rows, a:b] <= far[rows, None]) & ~own[rows, a:b]
            new = inside & np.isneginf(products[rows, a:b])
            some = np.flatnonzero(new.any(1))
            if len(some):
                values = queries[rows[some]] @ vectors[a:b].T
                block = products[rows[some], a:b]
                block[new[some]] = values[new[some]]
                products[rows[some], a:b] = block
                verified += int(new.sum())
        done = np.maximum(done, far)
        better = products > kth[:, None]
        for q in np.flatnonzero(better.sum(1) >= k):
            some = products[q, better[q]]
            kth[q] = np.partition(some, len(some) - k)[len(some) - k]
        reach = within(kth)
        active = done < reach
        if not active.any():
            break
    return best_of(ids, vectors, queries, products, kth, norm, k), verified


# ---------------------------------------------------------------- tables

FOUND = "query_id bigint, key bigint, vec_id bigint, score double"


def taking_part(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, vector) of the rows that take part, vectors as doubles; repeated rows once."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    df = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL")
    return df.where(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0)).select("id", F.size("vector").alias("dim"), "vector")


def few_copies(rows: DataFrame, k: int = NEAREST) -> DataFrame:
    """The distinct rows, of a vector with many copies those with the k + 1 smallest ids: no other can be among anyone's k nearest."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("copy") <= k + 1).drop("copy")


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield int(dim), part, part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows from smaller ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Upper:
    """What a sample tells of the vectors of one length: their norm, the tree of cells, and the sample itself."""

    def __init__(self, n: int, norm: float, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.norm, self.ids, self.vectors = norm, ids, vectors
        cells = max(1, min(1 << MAX_LEVELS, n // block_rows(vectors.shape[1]), len(ids) // 16))
        self.tree = splits(projected(vectors, norm), cells.bit_length() - 1)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return cells_of(projected(vectors, self.norm), self.tree)

    def holds(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Which rows are in the sample."""
        order = np.argsort(self.ids, kind="stable")
        left, right = np.searchsorted(self.ids[order], ids, "left"), np.searchsorted(self.ids[order], ids, "right")
        out = np.zeros(len(ids), bool)
        for i in np.flatnonzero(right > left):
            out[i] = (self.vectors[order[left[i] : right[i]]] == vectors[i]).all(1).any()
        return out

    def verified(self, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(ids, scores) of each query's k nearest in the sample, and the product that the k-th reaches; -inf where it has fewer."""
        products = queries @ self.vectors.T
        for q, i in zip(*np.nonzero(ids[:, None] == self.ids[None, :])):
            if np.array_equal(queries[q], self.vectors[i]):
                products[q, i] = -np.inf
        kth = kth_largest(products, k)
        return best_of(self.ids, self.vectors, queries, products, kth, self.norm, k), kth

    def visits(self, queries: np.ndarray, bounds: np.ndarray, quantile: float) -> np.ndarray:
        """[query, cell]: the cells that the test does not rule out."""
        known = np.isfinite(bounds)
        ways = self.norm / np.sqrt(np.einsum("ij,ij->i", queries, queries))
        reach = np.where(known, quantile * np.maximum(2 * self.norm**2 - 2 * ways * np.where(known, bounds, 0), 0), np.inf)
        return cell_distances(projected_queries(queries, self.norm), self.tree) <= reach[:, None]


def block_rows(dim: int) -> int:
    """Vectors of a block: fewer where they are long."""
    return max(64, min(BLOCK, BLOCK * 64 // dim))


def _upper_levels(rows: DataFrame, part: DataFrame, k: int) -> dict[int, Upper]:
    """By length of vectors; the driver gets a row for each length and ``SAMPLE`` vectors."""
    norm = F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    sizes = {r["dim"]: (r["n"], r["norm"]) for r in part.groupBy("dim").agg(F.count("*").alias("n"), norm.alias("norm")).collect()}
    some = min(SAMPLE, max(2 * k, sum(n for n, _ in sizes.values()) // SAMPLE_SHARE))
    sample = rows.orderBy(F.xxhash64("vector", "id"), "id").limit(some).collect()
    out = {}
    for dim, (n, longest) in sizes.items():
        own = [r for r in sample if r["dim"] == dim]
        out[dim] = Upper(n, longest, np.array([r["id"] for r in own], np.int64), np.array([r["vector"] for r in own]).reshape(-1, dim))
    return out


def index(rows: DataFrame, upper: dict[int, Upper]) -> DataFrame:
    """The index of all rows but the sample, which every query verifies in full: (dim, cell, share, ids, vectors, starts), a row for each block, its vectors in the order of its tree's leaves."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, vectors in _by_dim(batch):
                rest = np.flatnonzero(~upper[dim].holds(part.column("id").to_numpy(), vectors))
                yield part.take(pa.array(rest)).append_column("cell", pa.array(upper[dim].cells(vectors[rest]), pa.int32()))

    def build(group: pa.Table) -> pa.Table:
        dim, cell, share = (group.column(c)[0].as_py() for c in ("dim", "cell", "share"))
        vectors = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order, starts = leaf_order(projected(vectors, upper[dim].norm))
        ids = group.column("id").to_numpy()[order]
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "share": pa.array([share], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors[order].astype("<f8").tobytes()], pa.binary()), "starts": pa.array([starts], pa.list_(pa.int32()))})

    placed = common.save(rows.mapInArrow(place, "id bigint, dim int, vector array<double>, cell int"), "placed")
    counts = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
    shares = counts.select("dim", "cell", F.ceil(F.col("n") / F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK * 64) / F.col("dim"))))).cast("int").alias("shares"))
    dealt = placed.join(shares, ["dim", "cell"]).withColumn("share", F.pmod(F.xxhash64("id", "vector"), F.col("shares")).cast("int")).drop("shares")
    blocks = dealt.groupBy("dim", "cell", "share").applyInArrow(build, "dim int, cell int, share int, ids binary, vectors binary, starts array<int>")
    return common.save(blocks, "index")


def packs(queries: DataFrame, upper: dict[int, Upper], k: int, confidence: float, spread: int) -> DataFrame:
    """(dim, cell, part, ids, vectors, bounds): the queries that must visit a cell, up to ``PACK`` in a row, in ``spread`` parts."""
    quantile = chi_square_quantile(confidence, PROJECTED)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 4 * PACK):
            for dim, part, vectors in _by_dim(batch):
                ids, keys = part.column("id").to_numpy(), part.column("key").to_numpy()
                _, bounds = upper[dim].verified(ids, vectors, k)
                visits = upper[dim].visits(vectors, bounds, quantile)
                for cell in range(visits.shape[1]):
                    at = np.flatnonzero(visits[:, cell])
                    for some in np.split(at, range(PACK, len(at), PACK)) if len(at) else ():
                        share = int(keys[some[0]] % spread)
                        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "part": pa.array([share], pa.int32()), "ids": pa.array([ids[some].astype("<i8").tobytes()], pa.binary()), "keys": pa.array([keys[some].astype("<i8").tobytes()], pa.binary()), "vectors": pa.array([vectors[some].astype("<f8").tobytes()], pa.binary()), "bounds": pa.array([bounds[some].astype("<f8").tobytes()], pa.binary())})

    return queries.mapInArrow(visit, "dim int, cell int, part int, ids binary, keys binary, vectors binary, bounds binary")


def _found(ids: np.ndarray, keys: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lengths = [len(f[0]) for f in found]
    return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, lengths)), "key": pa.array(np.repeat(keys, lengths)), "vec_id": pa.array(np.concatenate([f[0] for f in found])), "score": pa.array(np.concatenate([f[1] for f in found]))})


def _in_sample(queries: DataFrame, upper: dict[int, Upper], k: int) -> DataFrame:
    """What each query finds in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, vectors in _by_dim(batch):
                ids = part.column("id").to_numpy()
                yield _found(ids, part.column("key").to_numpy(), upper[dim].verified(ids, vectors, k)[0])

    return queries.mapInArrow(run, FOUND)


def _search_all(norms: dict[int, float], k: int, confidence: float):
    """Reads blocks and, behind each, the packs that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, vectors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
                if row["kind"] == 0:
                    block = (row["at"], ids, vectors, row["starts"])
                    continue
                if block is None or block[0] != row["at"]:
                    continue  # no row fell into this cell
                keys = np.frombuffer(row["keys"], "<i8")
                found, _ = search(block[1], block[2], block[3], norms[dim], ids, vectors, np.frombuffer(row["bounds"], "<f8"), k, confidence)
                yield _found(ids, keys, found)

    return run


def nearest(rows: DataFrame, divisor: int = 20, k: int = NEAREST, confidence: float = CONFIDENCE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``divisor``.

    A task reads blocks and behind each the packs of queries that visit it, at most ``QUERIES`` of them for a copy of
    a block: a block that more queries visit is copied and its queries are dealt to the copies.
    """
    part = common.save(taking_part(rows, key, vector).distinct(), "vectors")
    kept = few_copies(part, k)
    upper = _upper_levels(kept, part, k)
    blocks = index(kept, upper)
    queries = part.where(F.col("id") % divisor == 0).withColumn("key", F.xxhash64("vector"))
    n = queries.count()
    spread = max(1, -(-n // QUERIES))
    asked = packs(queries.repartition(max(1, -(-n // (4 * PACK)))), upper, k, confidence, spread)

    place = ["dim", "cell", "share", "part"]
    shares = blocks.select("dim", "cell", "share")
    first = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("kind", F.lit(0))
    then = asked.join(shares, ["dim", "cell"]).withColumn("kind", F.lit(1))
    both = first.unionByName(then, allowMissingColumns=True).withColumn("at", F.concat_ws(".", *place))
    both = both.repartition(*place).sortWithinPartitions(*place, "kind").select("at", "dim", "kind", "ids", "vectors", "starts", "keys", "bounds")
    norms = {dim: u.norm for dim, u in upper.items()}
    found = common.save(both.mapInArrow(_search_all(norms, k, confidence), FOUND), "nearest", rows=8)
    found = found.unionByName(common.save(_in_sample(queries, upper, k), "nearest_in_sample"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
