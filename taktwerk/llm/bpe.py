"""Byte-level BPE: vectorised splitting by a scanned automaton, cached pair merging, decoding by offsets.

A batch of texts becomes one array of code points. Each code point gets a symbol (its class, with what a
look at its neighbours adds), a symbol is a function from state to state, and because such functions
compose associatively the states of a whole batch come from a blocked scan in numpy. Where the automaton
says that a piece starts, the UTF-8 bytes are cut; pieces are merged once and kept in a bounded cache.

Defined results: a null text is the empty text (no ids, empty bytes); an empty table gives an empty table;
repeated rows are encoded each; columns other than the key and the text are not read. Texts are taken whole,
whatever their length. Memory in a task is bounded by a chunk of text (1 MB, or one longer text) and the cache.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from taktwerk.llm import common

LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3
# symbols beyond the classes: an apostrophe before one or two letters that it binds, a space that joins the
# next piece, the last white space before a piece that it cannot join, and the end of a text
SHORT, LONG, JOIN, LAST, STOP = 4, 5, 6, 7, 8
# states: what the piece under way may take
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BREAKS, JOINED, ONE_MORE, TWO_MORE, FRESH = range(8)
#: The state after a symbol that starts a piece.
OPENS = (IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BREAKS, ONE_MORE, TWO_MORE, JOINED, FRESH, FRESH)
#: Cached pieces of a worker; beyond, the cache starts anew.
CACHE_PIECES = 400_000
_BLOCK = 128
_END = 0x110000  # no code point


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by symbol and state."""
    nxt, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol in range(9):
        nxt[symbol, :] = OPENS[symbol]
        if symbol == STOP:
            continue
        as_class = OTHER if symbol in (SHORT, LONG) else symbol
        if as_class <= BREAK:
            starts[symbol, as_class] = False  # goes on with its own class
            nxt[symbol, as_class] = as_class
        if as_class in (LETTER, NUMBER, OTHER):
            starts[symbol, JOINED] = False
            nxt[symbol, JOINED] = as_class
        if symbol == LETTER:
            starts[symbol, [ONE_MORE, TWO_MORE]] = False
            nxt[symbol, ONE_MORE], nxt[symbol, TWO_MORE] = FRESH, ONE_MORE
    return nxt, starts


NEXT, STARTS = _automaton()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """The class of each code point by Unicode's general category and White_Space; the end mark is last."""
    out = np.full(_END + 1, OTHER, np.uint8)
    for cp in range(_END):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    # White_Space: the fixed values of Unicode's property list
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BREAK
    out[_END] = STOP
    return out


def symbols_of(points: np.ndarray) -> np.ndarray:
    """A symbol for each code point of texts that each end in the end mark."""
    kind = code_point_classes()[points]
    after = np.append(kind[1:], STOP)
    out = kind.copy()
    last = (kind == BREAK) & (after != BREAK) & (after != STOP)
    out[last] = LAST
    out[last & (points == 0x20)] = JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.append(points, [_END, _END])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[at[pair]] = LONG
    return out


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Where pieces start: a scan of composed transition functions over blocks, then each block from its state."""
    n = len(symbols)
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, STOP, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    flat = NEXT.reshape(-1)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in grid:  # each block's function
        maps = flat[(column[:, None].astype(np.uint16) << 3) | maps]
    step = 1
    maps = np.ascontiguousarray(maps)
    while step < rows:  # functions of all blocks up to each: composed pairwise, doubling
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = FRESH, maps[:-1, FRESH]
    out = np.empty((_BLOCK, rows), bool)
    begins = STARTS.reshape(-1)
    for i, column in enumerate(grid):
        key = (column.astype(np.uint16) << 3) | state
        out[i] = begins[key]
        state = flat[key]
    return np.flatnonzero(out.T.reshape(-1)[:n])


def cut(texts: list[str]) -> tuple[bytes, list[int], list[int], list[int]]:
    """The texts' bytes, the offsets where pieces start and end, and by text the number of pieces up to its end."""
    lengths = np.array([len(t) for t in texts], np.int64)
    marks = np.cumsum(lengths + 1) - 1
    points = np.empty(int(lengths.sum()) + len(texts), np.int32)
    is_text = np.ones(len(points), bool)
    is_text[marks] = False
    joined = "".join(texts)
    points[is_text] = np.frombuffer(joined.encode("utf-32-le"), np.int32)
    points[marks] = _END
    starts = piece_starts(symbols_of(points))
    width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    width[marks] = 0
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    ends = at[np.append(starts[1:], len(points))]
    real = points[starts] != _END
    upto = np.cumsum(real)[np.searchsorted(starts, marks)]
    return joined.encode(), at[starts[real]].tolist(), ends[real].tolist(), upto.tolist()


class Merger:
    """Ranks, the tokens' bytes, and a bounded cache of merged pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimals = {rank: str(rank) for rank in self.tokens}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Joins the adjacent pair of least rank, the leftmost of ties, until no pair has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > 200:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, far = self.ranks.get, 1 << 40
        pair = [get(a + b, far) for a, b in zip(parts, parts[1:])]
        while pair and (least := min(pair)) < far:
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], far)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], far)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over a linked list, for pieces of any length."""
        import heapq

        n = len(piece)
        ends, nexts, prevs, alive = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = nexts[i]
            if j < n and (rank := self.ranks.get(piece[i : ends[j]])) is not None:
                heap.append((rank, i, ends[i], ends[j])) if not ready else heapq.heappush(heap, (rank, i, ends[i], ends[j]))

        ready = False
        for i in range(n):
            push(i)
        heapq.heapify(heap)
        ready = True
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            j = nexts[i]
            if not alive[i] or ends[i] != mid or j >= n or ends[j] != end:
                continue
            alive[j], ends[i], nexts[i] = False, end, nexts[j]
            if nexts[i] < n:
                prevs[nexts[i]] = i
            push(i)
            if prevs[i] >= 0:
                push(prevs[i])
        return tuple(self.ranks[piece[i : ends[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        data, starts, ends, upto = cut(texts)
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE_PIECES:
            cache.clear()
        pieces = list(map(data.__getitem__, map(slice, starts, ends)))
        for piece in set(pieces).difference(cache):
            cache[piece] = merge(piece)
        found = list(map(cache.__getitem__, pieces))
        lo = 0
        for hi in upto:
            yield list(chain.from_iterable(found[lo:hi]))
            lo = hi

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Where each token's bytes start in the decoded text, and at the end its length."""
        return np.cumsum([0, *(len(self.tokens[i]) for i in ids)])


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def _ranks_file(spark: SparkSession, path: str) -> str:
    """Ships the rank file with the job; returns its name on the workers."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _per_text(docs: DataFrame, path: str, key: str, text: str, build, schema: str) -> DataFrame:
    name = _ranks_file(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(SparkFiles.get(name))
        for batch in batches:
            column = batch.column(1)
            for lo, n, _, _ in common.text_chunks(column):
                texts = [t or "" for t in column.slice(lo, n).to_pylist()]
                yield build(bpe, batch.column(0).slice(lo, n), texts)

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, {schema}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, offsets array<int>): tokens of each text and where their bytes start."""

    def build(bpe: Merger, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        ids = list(bpe.encode(texts))
        return pa.RecordBatch.from_pydict({key: keys, "ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array([bpe.offsets(x)[:-1].astype(np.int32) for x in ids], pa.list_(pa.int32()))})

    return _per_text(docs, path, key, text, build, "ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, data binary): the bytes of each list of ids."""
    name = _ranks_file(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(SparkFiles.get(name))
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "data": common.binary_column(data)})

    return encoded.select(key, "ids").mapInArrow(run, f"{key} bigint, data binary")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes the ids, and keeps digests of both."""

    def build(bpe: Merger, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
        n, coded, decoded = [], [], []
        sha, decimal = hashlib.sha256, bpe.decimals.__getitem__
        for ids in bpe.encode(texts):
            n.append(len(ids))
            coded.append(sha(" ".join(map(decimal, ids)).encode()).hexdigest())
            decoded.append(sha(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_pydict({key: keys, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(coded), "decoded_sha256": pa.array(decoded)})

    return _per_text(docs, path, key, text, build, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
