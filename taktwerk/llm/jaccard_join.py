"""N-gram Jaccard join of documents with signature trees, returning connected classes.

Each document becomes the set of its distinct word shingles; equal sets are one node. By the prefix principle two
sets with Jaccard similarity t share one of their first |A| - ceil(t|A|) + 1 shingles in any common order; the order
here puts shingles last that are frequent, so boilerplate brings nobody together. A shingle that two nodes have in
their prefixes is a posting list. Nodes then meet twice:

1. by the first shared shingle, with their whole sets: a signature tree of the group (bit vectors combined by OR and
   ranges of size in each tree node) is traversed against itself, pairs of tree nodes are pruned by the largest
   overlap they allow, leaf pairs are checked exactly, and pairs that links already connect are passed over;
2. by all posting lists that still hold nodes of different classes, each list of members once: the same traversal
   over bit vectors alone marks the members that may be similar to one of another class, and over the whole sets of
   the marked ones it finds the links.

So every pair at or above the threshold is checked or already connected; nothing is capped. Links become classes by
distributed components. Groups are dealt in parts of bounded size (first shingles) or as pairs of parts (posting lists);
a list too long for one task is first cut into bands of size, as similar sets lie in one band or in neighbouring ones.

Defined results: a null text, or one without words, has no shingles and is alone; fewer words than a shingle has are
one shingle; copies and repeated rows share a class; a null doc_id is a row like any other, ignored in the smallest
id (null if the class has no other); an empty table gives an empty table. Other columns are not read. Shingles are
told apart by 64-bit hashes throughout. Sets are made again from the texts where they are needed and never stored:
eight bytes for each shingle, written and then shuffled, would be more than the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm import common

SHINGLE, PERCENT = 5, 80
SEP = common.separators("space")
#: Bits of the cells that count shingles and of the filters over sets: by the number of sets, within these bounds.
COUNT_BITS, MOST_BITS = 20, 22
#: A shingle is frequent whose count cell exceeds so many times the mean, and so many at least.
FREQUENT_TIMES, FREQUENT_LEAST = 8, 32
#: Shingles in a part of a group; a row counts as so many more, so that parts of short texts are bounded as well.
PART_SHINGLES, ROW_SHINGLES = 2_000_000, 128
#: Distinct sets that a task remembers before it shuffles their prefixes.
REMEMBERED = 1 << 20
#: Bits of a vector at least; sets of many shingles have more.
BITS = 256
#: Bits a shingle in the vectors that stand before an exact check.
FINE = 64
LEAF, FAN = 32, 8
#: Smaller sets are kept as they are, eight bytes for each shingle; larger ones take about seven.
RAW = 256


# ---------------------------------------------------------------- sets


def shingles(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct 64-bit shingle hashes."""
    for _, n, data, offsets in common.text_chunks(column):
        data = common.LOWER[data]
        starts, ends, first = common.split_words(data, offsets, SEP)
        words = common.span_hashes(data, starts, ends)
        windows = common.window_hashes(words, k)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(windows[a : b - k + 1])
            elif b > a:
                yield common.window_hashes(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def pack(s: np.ndarray) -> bytes:
    """A sorted set of 64-bit hashes: their top bytes, which grow, as a bit row of n ones and 256 steps, then the other seven."""
    n = len(s)
    if n < RAW:
        return s.tobytes()
    bits = np.zeros(n + 256, bool)
    bits[np.arange(n) + (s >> np.uint64(56)).astype(np.int64)] = True
    return np.packbits(bits).tobytes() + s.astype("<u8").view(np.uint8).reshape(n, 8)[:, :7].tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    if n < RAW:
        return np.frombuffer(blob, "<i8")
    size = (n + 256 + 7) // 8
    out = np.empty((n, 8), np.uint8)
    out[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, size).reshape(n, 7)
    out[:, 7] = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size), count=n + 256)) - np.arange(n)
    return out.reshape(-1).view("<i8")


def set_id(s: np.ndarray) -> int:
    return int(common.mix(np.array([common.mix(s + np.uint64(1)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def placed(docs: DataFrame) -> DataFrame:
    """(place, text): a row's place is a hash of its key and text, by which one of many copies is chosen."""
    return docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("place"), "text")


def shingle_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, place, sid, n): key, hashes of the text, of both, and of the set (null if empty), and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n = [], []
            for s in shingles(batch.column(3), k):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text_key": batch.column(1), "place": batch.column(2), "sid": pa.array(sid, pa.int64()), "n": pa.array(n, pa.int64())})

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64("doc_id", F.xxhash64("text")).alias("place"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, place bigint, sid bigint, n bigint")


def cell_bits(sets: int) -> int:
    """Bits of the cells that stand for sets: as many cells as there are sets, within bounds."""
    return min(MOST_BITS, max(COUNT_BITS, sets.bit_length()))


def frequent_cells(docs: DataFrame, bits: int, k: int = SHINGLE) -> np.ndarray:
    """For each of 2**bits cells of shingle hashes the shares in which its rows are dealt: 0 for the usual, one or more
    where its documents are many. The counts cover all rows."""
    mask = np.uint64((1 << bits) - 1)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        cells = [s & mask for s in shingles(batch.column(0), k)]
        total += np.bincount(np.concatenate(cells).astype(np.int64), minlength=len(total))

    counts = common.summed_vector(docs.select("text"), add, 1 << bits)
    most = FREQUENT_TIMES * counts.mean() + FREQUENT_LEAST
    return np.where(counts > most, np.minimum(np.ceil(counts / most), np.iinfo(np.uint16).max), 0).astype(np.uint16)


def prefixes(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(h, share, sid, pos): the shingles of each set's prefix in the common order; share 0 but for frequent ones."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    mask = len(frequent) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that a task has met lately: before the shuffle a set seldom counts twice in a task
        for batch in batches:
            hs, sids, pos, share = [], [], [], []
            for s in shingles(batch.column(0), k):
                n = len(s)
                if not n or (sid := set_id(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(sid)
                v = s.view(np.int64)
                shares = shared.value[v & mask]
                late = shares > 0
                most = n - -(-n * percent // 100) + 1
                hs.append(np.concatenate([v[~late], v[late]])[:most])
                shares = np.concatenate([shares[~late], shares[late]])[:most].astype(np.int64)
                share.append(np.where(shares > 0, 1 + sid % np.maximum(shares, 1), 0).astype(np.int32))
                sids.append(np.full(len(hs[-1]), sid))
                pos.append(np.arange(len(hs[-1]), dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_pydict({"h": np.concatenate(hs), "share": np.concatenate(share), "sid": np.concatenate(sids), "pos": np.concatenate(pos)})

    return docs.select("text").mapInArrow(run, "h bigint, share int, sid bigint, pos int")


def shared_postings(prefix: DataFrame) -> DataFrame:
    """(h, sid, pos) of shingles that two sets or more have in their prefixes; one shuffle, each row once.

    The rows of a frequent shingle are dealt by shares and all stay, with or without company."""
    w = Window.partitionBy("h", "share")
    rows = prefix.withColumns({"lo": F.min("sid").over(w), "hi": F.max("sid").over(w)}).where("share > 0 or lo < hi")
    return rows.dropDuplicates(["h", "share", "sid"]).select("h", "sid", "pos")


# ---------------------------------------------------------------- signature trees


def width_of(n: int) -> int:
    """Bits for a set of n shingles: a power of two from 2n on, so that vectors of large sets do not fill up."""
    return max(BITS, 1 << (2 * n - 1).bit_length())


def bit_vector(values: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, bool)
    bits[values & (width - 1)] = True
    return np.packbits(bits).tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A vector of fewer bits that has every element of the longer one: hashes are cut by their low bits."""
    v = np.frombuffer(bits, np.uint64)
    return np.bitwise_or.reduce(v.reshape(-1, width // 64), axis=0)


def by_width(sizes: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of items whose vectors meet in one width: those of a width, and the larger ones near enough in size."""
    widths = np.array([width_of(n) for n in sizes.tolist()])
    for width in np.unique(widths).tolist():
        near = (widths == 2 * width) & (percent * sizes <= 100 * (width // 2))
        yield width, np.flatnonzero((widths == width) | near)


class SignatureTree:
    """Bit vectors combined by OR and size ranges over items in the given order; ``labels`` may change during a walk."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, labels: np.ndarray, percent: int = PERCENT):
        self.sizes, self.bits, self.labels, self.percent = sizes, bits, labels, percent
        self.spare = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)
        cuts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(sizes, cuts), np.maximum.reduceat(sizes, cuts), np.maximum.reduceat(self.spare, cuts))
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FAN)
            level = (np.bitwise_or.reduceat(level[0], cuts), np.minimum.reduceat(level[1], cuts), np.maximum.reduceat(level[2], cuts), np.maximum.reduceat(level[3], cuts))
            self.levels.append(level)

    def _reach(self, overlap, a, b):
        """Whether sets of a and b elements (or more) with this overlap at most can be similar enough."""
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def _apart(self, depth: int, i: int, j: int) -> bool:
        bits, low, high, spare = self.levels[depth]
        if 100 * high[i] < self.percent * low[j] or 100 * high[j] < self.percent * low[i]:
            return True
        overlap = min(int(np.bitwise_count(bits[i] & bits[j]).sum()) + min(spare[i], spare[j]), high[i], high[j])
        return not self._reach(overlap, low[i], low[j])

    def _one_label(self, depth: int, i: int, j: int) -> bool:
        width = LEAF * FAN**depth
        a, b = self.labels[i * width : (i + 1) * width], self.labels[j * width : (j + 1) * width]
        return bool((a == a[0]).all() and (b == a[0]).all())

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of items (i, j, largest overlap) that may be similar and have different labels, near ones first."""
        for depth, level in enumerate(self.levels):
            for node in range(len(level[0])):
                if depth == 0:
                    yield from self._leaves(node, node)
                else:
                    kids = range(node * FAN, min((node + 1) * FAN, len(self.levels[depth - 1][0])))
                    for i in kids:
                        for j in range(i + 1, kids.stop):
                            yield from self._visit(depth - 1, i, j)

    def _visit(self, depth: int, i: int, j: int):
        if self._apart(depth, i, j) or self._one_label(depth, i, j):
            return
        if depth == 0:
            yield from self._leaves(i, j)
            return
        n = len(self.levels[depth - 1][0])
        for a in range(i * FAN, min((i + 1) * FAN, n)):
            for b in range(j * FAN, min((j + 1) * FAN, n)):
                yield from self._visit(depth - 1, a, b)

    def _leaves(self, i: int, j: int):
        a = np.arange(i * LEAF, min((i + 1) * LEAF, len(self.sizes)))
        b = np.arange(j * LEAF, min((j + 1) * LEAF, len(self.sizes)))
        apart = self.labels[a][:, None] != self.labels[b]
        na, nb = self.sizes[a][:, None], self.sizes[b]
        ok = apart & (100 * np.minimum(na, nb) >= self.percent * np.maximum(na, nb))
        if i == j:
            ok &= a[:, None] < b
        x, y = np.nonzero(ok)
        if not len(x):
            return
        x, y = a[x], b[y]
        overlap = np.bitwise_count(self.bits[x] & self.bits[y]).sum(1, dtype=np.int64) + np.minimum(self.spare[x], self.spare[y])
        ok = self._reach(overlap, self.sizes[x], self.sizes[y])
        if ok.any():
            x, y, overlap = x[ok], y[ok], overlap[ok]
            order = np.argsort(-overlap / (self.sizes[x] + self.sizes[y]), kind="stable")
            yield x[order], y[order], overlap[order]


def similar(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (na + nb - both)


def link(sizes: list[int], sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT, skip: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Merges the labels of items that are similar, all pairs taken into account; returns the pairs that merged two.

    Pairs within one part of ``skip`` are left to another task.
    """
    links: list[tuple[int, int]] = []

    def check(x: int, y: int) -> None:
        if labels[x] != labels[y] and (skip is None or skip[x] != skip[y]) and similar(sets[x], sizes[x], sets[y], sizes[y], percent):
            links.append((x, y))
            labels[labels == labels[y]] = labels[x]

    if len(sizes) <= 6:
        for x in range(len(sizes)):
            for y in range(x):
                if 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]):
                    check(x, y)
        return links
    all_sizes = np.array(sizes)
    for width, items in by_width(all_sizes, percent):
        n = all_sizes[items]
        fine = np.stack([np.frombuffer(bit_vector(sets[i], width * FINE // 2), np.uint64) for i in items.tolist()])
        spare = n - np.bitwise_count(fine).sum(1, dtype=np.int64)
        tree = SignatureTree(n, np.bitwise_or.reduce(fine.reshape(len(items), -1, width // 64), axis=1), labels[items], percent)
        for xs, ys, _ in tree.walk():
            for lo in range(0, len(xs), 256):
                x, y = xs[lo : lo + 256], ys[lo : lo + 256]
                overlap = np.bitwise_count(fine[x] & fine[y]).sum(1, dtype=np.int64) + np.minimum(spare[x], spare[y])
                ok = (100 + percent) * overlap >= percent * (n[x] + n[y])
                for i, j in zip(items[x[ok]].tolist(), items[y[ok]].tolist()):
                    check(i, j)
            tree.labels[:] = labels[items]
    return links


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns, over batches."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def local_classes(parts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sid, leader, n, bits) from rows (key, part, n, sid, blob) in order: classes within each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in _by_group(batches, 2):
            rows = sorted({r[1]: r for r in rows}.values(), key=lambda r: r[:2])  # a repeated row has one set
            sizes, sids = [r[0] for r in rows], [r[1] for r in rows]
            sets = [unpack(r[2], r[0]) for r in rows]
            labels, ids = np.arange(len(sids)), np.array(sids)
            link(sizes, sets, labels, percent)
            least = {label: int(ids[labels == label].min()) for label in np.unique(labels).tolist()}
            out += zip(sids, map(least.__getitem__, labels.tolist()), sizes, (bit_vector(s, width_of(n)) for s, n in zip(sets, sizes)))
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(("sid", "leader", "n", "bits"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), zip(*out))})

    return parts.mapInArrow(run, "sid bigint, leader bigint, n bigint, bits binary")


def marked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(h, sid, leader, n) from rows (h, i, j, part, n, sid, leader, bits) in order: members that may be similar to one of another leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (h, i, j), group in _by_group(batches, 3):
            group.sort(key=lambda r: r[1:3])
            labels, parts, sizes = (np.array([r[c] for r in group]) for c in (3, 0, 1))
            if (labels == labels[0]).all():
                continue
            near = np.zeros(len(group), bool)
            for width, items in by_width(sizes, percent):
                tree = SignatureTree(sizes[items], np.stack([folded(group[x][4], width) for x in items.tolist()]), labels[items], percent)
                for xs, ys, _ in tree.walk():
                    x, y = items[xs], items[ys]
                    if i != j:
                        apart = parts[x] != parts[y]
                        x, y = x[apart], y[apart]
                    near[x] = near[y] = True
            out += [(h, group[x][2], int(labels[x]), int(sizes[x])) for x in np.flatnonzero(near).tolist()]
            if len(out) >= 4096:
                yield _longs(("h", "sid", "leader", "n"), out)
                out = []
        yield _longs(("h", "sid", "leader", "n"), out)

    return rows.mapInArrow(run, "h bigint, sid bigint, leader bigint, n bigint").distinct()


def linked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v) from rows (h, i, j, part, n, sid, leader, blob) in order: leaders of similar members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, i, j), group in _by_group(batches, 3):
            group.sort(key=lambda r: r[1:3])
            leaders = [r[3] for r in group]
            labels = np.unique(leaders, return_inverse=True)[1]
            parts = np.array([r[0] for r in group]) if i != j else None
            pairs = link([r[1] for r in group], [unpack(r[4], r[1]) for r in group], labels, percent, parts)
            out += {(leaders[x], leaders[y]) for x, y in pairs}
            if len(out) >= 4096:
                yield _longs(("u", "v"), out)
                out = []
        yield _longs(("u", "v"), out)

    return rows.mapInArrow(run, "u bigint, v bigint").distinct()


def _longs(names: tuple[str, ...], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def whole_sets(wanted: DataFrame, docs: DataFrame, bits: int, k: int = SHINGLE) -> DataFrame:
    """The rows of ``wanted`` (sid, place, ...) with size n and content blob of their sets, made again from the texts.

    A bit vector passes over most rows that nobody asks for before they are shuffled. Rows that repeat key and text of
    an asked one come along, once for each task at most."""
    mask = (1 << bits) - 1

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[np.array(batch.column(0)) & mask] = 1

    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common.summed_vector(wanted.select("place"), add, 1 << bits) > 0))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen = np.unpackbits(shared.value).astype(bool), set()
        for batch in batches:
            places = np.array(batch.column(0), np.int64)
            if len(seen) >= REMEMBERED:
                seen.clear()
            at = []
            for i in np.flatnonzero(asked[places & mask]).tolist():
                if (place := int(places[i])) not in seen:
                    seen.add(place)
                    at.append(i)
            rows = batch.take(pa.array(at, pa.int64()))
            made = [(p, set_id(s), len(s), pack(s)) for p, s in zip(rows.column(0).to_pylist(), shingles(rows.column(1), k)) if len(s)]
            if made:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(("place", "sid", "n", "blob"), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), zip(*made))})

    return placed(docs).mapInArrow(keep, "place bigint, sid bigint, n bigint, blob binary").join(wanted, ["sid", "place"])


# ---------------------------------------------------------------- the join


def _weight(size: str) -> Column:
    """What a set weighs in a part."""
    return F.col(size) + F.lit(ROW_SHINGLES)


def _parts(total: Column) -> Column:
    return F.ceil(total / F.lit(PART_SHINGLES)).cast("int")


def _dealt(cross: DataFrame, content: DataFrame, column: str, percent: int) -> DataFrame:
    """Posting rows (h, sid, leader, n) with the content of their sets, in order by list; a long list is dealt by bands of size, each band
    with the one below it, as pairs of its parts.

    Long lists and their bands are small tables of their own, so the rows need not be shuffled to find them."""
    long = common.save(cross.groupBy("h").agg(F.sum(_weight("n")).alias("total")).where(F.col("total") > PART_SHINGLES).select("h", F.lit(True).alias("long")), "long")
    # a shade wider than the threshold, so that rounding cannot part two sets by more than one band
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) * 1.0001 if percent < 100 else 1.0)).cast("int") + 1
    bands = F.explode(F.when(F.col("long"), F.array(band, band + 1)).otherwise(F.array(F.lit(0))))
    shares = common.save(cross.join(long, "h").withColumn("band", bands).groupBy("h", "band").agg(_parts(F.sum(_weight("n"))).alias("parts")), "bands")
    rows = cross.join(long, "h", "left").withColumn("band", bands).join(shares, ["h", "band"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = lambda p: F.col("band").cast("bigint") * (1 << 32) + p
    rows = rows.withColumn("part", part(F.pmod(F.xxhash64("sid"), F.col("parts")))).withColumn("other", F.explode(F.sequence(part(F.lit(0)), part(F.col("parts") - 1))))
    rows = rows.select("h", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "n", "sid", "leader")
    rows = rows.join(content.select("sid", column), "sid").select("h", "i", "j", "part", "n", "sid", "leader", column)
    return rows.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")


def _between_classes(posts: DataFrame) -> DataFrame:
    """The rows of posting lists with more than one leader, one list of those with the same members."""
    marks = [F.bit_xor(F.xxhash64("sid", F.lit(seed))).alias(f"m{seed}") for seed in (1, 2)]
    lists = posts.groupBy("h").agg(*marks, F.count("*").alias("c"), F.min("leader").alias("lo"), F.max("leader").alias("hi")).where("lo < hi")
    return posts.join(lists.groupBy("m1", "m2", "c").agg(F.min("h").alias("h")).select("h"), "h")


def classes(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    alone = F.col("component").isNull()
    return _judged(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n, component, component_id) of each document; no component where it has no words."""
    sets = common.save(shingle_sets(docs, k), "sets")
    first = sets.where("n > 0").groupBy("sid").agg(F.min("place").alias("place"), F.min("doc_id").alias("least_id"), F.first("n").alias("size"))
    bits = cell_bits(sets.count())
    posts = common.save(shared_postings(prefixes(docs, frequent_cells(docs, bits, k), percent, k)), "posts")
    common.settle(docs.sparkSession)

    keys = posts.groupBy("sid").agg(F.min_by("h", "pos").alias("key")).join(first, "sid").select("sid", "place", "key", "size")
    keys = common.save(keys, "keys")
    long = common.save(keys.groupBy("key").agg(_parts(F.sum(_weight("size"))).alias("parts")).where("parts > 1"), "long")
    dealt = keys.join(long, "key", "left").select("sid", "place", "key", F.pmod(F.xxhash64("sid"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    whole = whole_sets(dealt, docs, bits, k).select("key", "part", "n", "sid", "blob").repartition("key", "part").sortWithinPartitions("key", "part")
    local = common.save(local_classes(whole, percent), "local")
    common.settle(docs.sparkSession)

    cross = common.save(_between_classes(posts.select("h", "sid").join(local.select("sid", "leader", "n"), "sid")), "cross")
    common.discard(posts, keys)
    near = common.save(marked(_dealt(cross, local, "bits", percent), percent), "near")
    common.discard(cross)
    lists = common.save(_between_classes(near), "near-lists")
    common.discard(near)
    common.settle(docs.sparkSession)
    asked = common.save(whole_sets(lists.select("sid").distinct().join(first, "sid").select("sid", "place"), docs, bits, k).select("sid", "n", "blob").dropDuplicates(["sid"]), "asked")
    reached = common.save(common.components(linked(_dealt(lists, asked, "blob", percent), percent)), "classes")
    common.discard(lists, asked)
    leaders = local.select("sid", "leader").join(reached.select(F.col("id").alias("leader"), "component"), "leader", "left").select("sid", F.coalesce("component", "leader").alias("component"))
    named = first.select("sid", "least_id").join(leaders, "sid", "left").select("sid", "least_id", F.coalesce("component", "sid").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("sid", "component", "component_id")
    return sets.select("doc_id", "text_key", "sid", "n").join(named, "sid", "left").select("doc_id", "text_key", "n", "component", "component_id")


def representatives(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, with its own columns: that with the smallest doc_id (nulls last; of the same id the
    one whose text hashes lower). Repeated rows of it are one. Documents without words are linked with nothing and stay."""
    rows, restore = common.neutral(docs)
    last = F.lit((1 << 63) - 1)
    first = F.min(F.struct(F.coalesce("doc_id", last).alias("place_"), F.col("text_key").alias("text_key_")))
    kept = _judged(docs, k, percent).where("n > 0").groupBy("component").agg(first.alias("w")).select("w.place_", "w.text_key_")
    rows = rows.withColumns({"place_": F.coalesce("doc_id", last), "text_key_": F.xxhash64("text"), "worded_": F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))})
    one = rows.where("worded_").join(kept, ["place_", "text_key_"], "left_semi").dropDuplicates(["place_", "text_key_"])
    return restore(one.unionByName(rows.where("not worded_")))
