"""Benchmark decontamination over a positional inverted index that Spark builds, stores and joins.

The index has a row for each document: the hashes of its terms and the positions of each. Test items become windows of
terms; the number of documents of each term is counted, and each window is joined to the documents that hold its rarest
term (the postings of terms that are rarest in some window, one row for each document). In a document the position
lists of a window's terms, shifted by their offsets, are intersected from the rarest on, and what is left are the places
where the phrase (or with ``slop`` its terms near their places) stands. Windows with a term that the corpus lacks end
before any list is read. All windows of a document meet it in one task, which unites their hits in place.

The index stores the terms that the test items may ask for: a bit vector of fixed length (2**20 bits, however many
items there are) tells which, so the filter is a superset and costs no result.

Defined results: a null text has no words and no hits; an item without words has no window; an item with a null id
marks words but is not listed; different texts of one id, or without one, are each looked for; items count once by id;
repeated or null doc_ids are separate documents, a row each; an empty corpus or benchmark gives no hits. Whole texts
are indexed. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import common

WINDOW = 10
VOCABULARY_BITS = 20
SEP = common.separators("alnum")

INDEX = "doc bigint, doc_id bigint, n_words bigint, terms binary, counts binary, positions binary"


def term_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slice of a column: first row, the words' hashes, the index of each text's first word (rows + 1)."""
    for lo, _, data, offsets in common.text_chunks(column):
        data = common.LOWER[data]
        starts, ends, first = common.split_words(data, offsets, SEP)
        yield lo, common.span_hashes(data, starts, ends), first


def vocabulary(items: DataFrame) -> np.ndarray:
    """For each of 2**20 hash values, whether a term of the items has it."""
    mask = np.uint64((1 << VOCABULARY_BITS) - 1)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for _, h, _ in term_hashes(batch.column(0)):
            total += np.bincount((h & mask).astype(np.int64), minlength=len(total))

    return np.packbits(common.summed_vector(items.select("text"), add, 1 << VOCABULARY_BITS) > 0)


def build_index(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row for each document: a number of its own, its words, and the sorted terms with the positions of each."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    mask = np.uint64((1 << VOCABULARY_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for lo, h, first in term_hashes(batch.column(2)):
                rows = len(first) - 1
                at = np.flatnonzero(wanted[(h & mask).astype(np.int64)])
                which = np.searchsorted(first, at, "right") - 1
                order = np.lexsort((at, h[at], which))
                at, which, terms = at[order], which[order], h[at][order]
                edge = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (which[1:] != which[:-1]))) if len(at) else np.zeros(0, np.int64)
                counts = np.diff(np.append(edge, len(at))).astype("<u4")
                positions = (at - first[which]).astype("<u4")
                by_term, by_word = (np.searchsorted(x, np.arange(rows + 1)) for x in (which[edge], which))

                def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
                    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((cuts * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, rows) for c in (0, 1)), pa.array(np.diff(first).astype(np.int64)), lists(terms[edge], by_term), lists(counts, by_term), lists(positions, by_word)], names=["doc", "doc_id", "n_words", "terms", "counts", "positions"])

    return docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, INDEX)


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term of the index stands; summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist()]
            term, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "n"])

    return index.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(rarest, doc) for the terms in ``terms(rarest)``, and few others: a bit vector of fixed length tells which."""
    mask = np.int64((1 << VOCABULARY_BITS) - 1)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        total[batch.column(0).to_numpy() & mask] = 1

    shared = index.sparkSession.sparkContext.broadcast(np.packbits(common.summed_vector(terms, add, 1 << VOCABULARY_BITS) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            held = [t[wanted[t & mask]] for t in held]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else np.zeros(0, np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(held)), [len(t) for t in held])))], names=["rarest", "doc"])

    return index.select("doc", "terms").mapInArrow(run, "rarest bigint, doc bigint")


def item_windows(items: DataFrame, k: int = WINDOW) -> DataFrame:
    """(item_id, key, window, terms): k consecutive words of an item, or all of a shorter one; key is a hash of the
    item's terms, so that texts which share an id, or have none, stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for lo, h, first in term_hashes(batch.column(1)):
                h = h.view(np.int64)
                for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    key = int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True)
                    out += [(ids[lo + i], key, w, h[a + w : min(b, a + w + k)]) for w in range(max(1, b - a - k + 1)) if b > a]
            kinds = {"item_id": pa.int64(), "key": pa.int64(), "window": pa.int32(), "terms": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(kinds.items())})

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, key bigint, window int, terms array<bigint>")


def ranked_windows(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(item_id, length, rarest, terms, offs): the windows whose terms the corpus has, their terms from the rarest on."""
    terms = windows.select("item_id", "key", "window", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term"))
    ranked = terms.join(document_counts(index), "term", "left").groupBy("item_id", "key", "window", "length").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term"))).alias("t"))
    ranked = ranked.where(F.col("t")[0]["df"] > 0)
    return ranked.select("item_id", "length", F.col("t")[0]["term"].alias("rarest"), F.col("t.term").alias("terms"), F.col("t.off").alias("offs"))


def starts_of(at: dict[int, np.ndarray], terms: list[int], offs: list[int], n_words: int, slop: int) -> np.ndarray:
    """Where a window stands in a document: its terms' position lists, shifted, intersected from the rarest on."""
    begin = at.get(terms[0], np.zeros(0, np.int64)) - offs[0]
    for term, off in zip(terms[1:], offs[1:]):
        here = at.get(term)
        if here is None or not len(begin):
            return begin[:0]
        i = np.searchsorted(here, begin + off - slop)
        begin = begin[(i < len(here)) & (here[np.minimum(i, len(here) - 1)] <= begin + off + slop)]
    return begin[(begin >= 0) & (begin + len(terms) <= n_words)]


FOUND = "doc bigint, n_hit bigint, items array<string>, hit_spans array<struct<start:bigint,length:int>>"


def occurrences(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(doc, n_hit, items, hit_spans) of documents where windows stand: words inside, ids as sorted strings, places.

    With ``slop`` a term may stand so many words off its place.
    """
    ranked = common.save(ranked_windows(index, windows), "windows")
    probes = ranked.join(postings(index, ranked.select("rarest")), "rarest").groupBy("doc").agg(F.collect_list(F.struct("item_id", "terms", "offs")).alias("windows"))
    rows = index.select("doc", "n_words", "terms", "counts", "positions").join(probes, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n_words, terms, counts, positions, asked in zip(*(c.to_pylist() for c in batch.columns)):
                lists = np.split(np.frombuffer(positions, "<u4").astype(np.int64), np.cumsum(np.frombuffer(counts, "<u4"))[:-1])
                at = dict(zip(np.frombuffer(terms, np.int64).tolist(), lists))
                hit, items, spans = np.zeros(n_words + 1, np.int64), set(), set()
                for w in asked:
                    begin, length = starts_of(at, w["terms"], w["offs"], n_words, slop), len(w["terms"])
                    if len(begin):
                        np.add.at(hit, begin, 1)
                        np.add.at(hit, begin + length, -1)
                        spans.update((b, length) for b in begin.tolist())
                        if w["item_id"] is not None:
                            items.add(str(w["item_id"]))
                if spans:
                    out.append((doc, int((np.cumsum(hit) > 0).sum()), sorted(items), [{"start": b, "length": n} for b, n in sorted(spans)]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc", "n_hit", "items", "hit_spans"])

    return rows.mapInArrow(run, FOUND)


def contamination(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans (starts and lengths of hit windows, in words)."""
    index = common.save(build_index(docs, vocabulary(items)), "index")
    found = common.save(occurrences(index, item_windows(items, k)), "occurrences")
    out = index.select("doc", "doc_id", "n_words").join(found, "doc", "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("bigint").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "hit_spans")


def clean(docs: DataFrame, items: DataFrame, k: int = WINDOW) -> DataFrame:
    """The documents without a hit, with their own columns. A hash of id and text tells documents apart, so null and
    repeated ids are no matter."""
    rows, restore = common.neutral(docs)
    key = F.xxhash64("doc_id", "text")
    hit = contamination(docs.select(key.alias("doc_id"), "text"), items, k).where("contaminated").select(F.col("doc_id").alias("key_")).distinct()
    return restore(rows.withColumn("key_", key).join(hit, "key_", "left_anti"))
