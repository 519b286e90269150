"""What the corpus operators share: scratch tables, summed vectors, hashed words, components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

#: Rows that a Python worker gets at a time: texts and sets are long, and a worker should hold little.
BATCH_ROWS = 512

U64 = np.uint64


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Small batches for the plans that run inside; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; on a local master that names none, the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark, rows):
        df.write.parquet(path)
    out = spark.read.parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished steps once the driver has collected what referred to them; asks for that."""
    gc.collect()
    spark._jvm.System.gc()


def neutral(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with all columns but doc_id and text under names that clash with none, and what restores them."""
    names = docs.columns
    held = [n if n in ("doc_id", "text") else f"column_{i}_" for i, n in enumerate(names)]
    return docs.toDF(*held), lambda df: df.select(*held).toDF(*names)


def told_apart(name: Column) -> Column:
    """A name that is never null: a null one differs from every other, the empty one included."""
    return F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), name.cast("string")))


# ---------------------------------------------------------------- vectors of fixed length


def summed_vector(df: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], length: int, ranges: int = 16) -> np.ndarray:
    """Sum over all rows of a vector of fixed length.

    ``add(vector, batch)`` adds a batch in place. A task sends its vector in ``ranges`` slices, slices are
    summed where they meet, and the driver gets ``length`` numbers whatever the input's size.
    """
    width = -(-length // ranges)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width * ranges, np.int64), False
        for batch in batches:
            if batch.num_rows:
                add(total[:length], batch)
                seen = True
        if seen:
            for r in range(ranges):
                part = total[r * width : (r + 1) * width]
                if part.any():
                    at = np.flatnonzero(part)
                    yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "at": pa.array([at.astype("<u4").tobytes()], pa.binary()), "v": pa.array([part[at].astype("<u8").tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, at, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sums.setdefault(r, np.zeros(width, np.int64))[np.frombuffer(at, "<u4")] += np.frombuffer(v, "<i8")
        for r, s in sums.items():
            yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int32()), "v": pa.array([s.tobytes()], pa.binary())})

    parts = df.mapInArrow(gather, "r int, at binary, v binary").repartition(ranges, "r").mapInArrow(merge, "r int, v binary")
    out = np.zeros(width * ranges, np.int64)
    with small_batches(df.sparkSession):
        rows = parts.collect()  # `ranges` rows at most
    for row in rows:
        out[row["r"] * width : (row["r"] + 1) * width] = np.frombuffer(row["v"], np.int64)
    return out[:length]


# ---------------------------------------------------------------- words of UTF-8 texts


def separators(pattern: str) -> np.ndarray:
    """For each byte, whether it separates words. ``space``: \\x20 \\x09-\\x0D. ``alnum``: all ASCII but letters and digits."""
    sep = np.zeros(256, bool)
    if pattern == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    else:
        sep[:128] = True
        for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
            sep[ord(lo) : ord(hi) + 1] = False
    return sep


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about ``limit`` bytes: first row, rows, bytes, offsets (rows + 1). A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi - lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (rows + 1)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~sep[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from sums of prefixes; equal spans have equal hashes in any text."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; the last k - 1 have none."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, U64)
    for j in range(k):
        out = (out + words[j : j + n]) * U64(0xA24BAED4963EE407)
        out ^= out >> U64(29)
    return mix(out)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)``: (id, component), component the smallest id that is reachable.

    Alternating large and small stars: each round is two aggregations and joins on a node, written to the shared
    folder; rounds end when the edges stay as they are. Nothing is collected, and a node with many neighbours is
    aggregated before its rows are dealt. Nodes without an edge are not returned.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (after := mark(now)) != before:
        before = after
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = save(small, "edges")
        discard(now)
        now = new
    # at rest each edge joins a node to its component's smallest id
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
