"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and their beginnings (4, 5 and 6 bytes), told apart by 64-bit hashes. The model is fitted
on a bounded sample of labelled rows (``MAX_TRAIN``, by a hash of the id). There the documents of each of 2**19 buckets
of features are counted by label; in the buckets whose log-odds differ most from
chance (``BUCKETS_KEPT``) the documents of each single feature are counted, and of these the ``KEEP`` that differ most
stay, beyond ``LEAST_Z`` standard errors.
Grades: 0 for a row labelled not toxic; toxic rows are graded 1 or 2 by whether the words with clearly toxic features
make up less or more than the median share among toxic rows, since the labels themselves have two values. The model
has one weight for each feature, shared by all grades, and ordered thresholds: P(grade >= k) = sigmoid(w.x - t_k), fitted
by accelerated proximal gradient steps with an L1 penalty.

Defined results: a null text, or one without words, has no features and gets the severity of the thresholds alone;
labels that are null teach nothing, nor do labels without a document; without labels of both kinds nothing is toxic
and the severity is 0; repeated rows get the same result; a null doc_id is a row like any other; an empty table gives
an empty table; other columns pass through ``rejected_removed``. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import common

BUCKETS = 1 << 19
PREFIXES = (4, 5, 6)
BUCKETS_KEPT, KEEP, MAX_TRAIN, MIN_DOCS = 8192, 2048, 20_000, 3
L1, STEPS = 1e-3, 600
LEAST_Z = 2.0
SMOOTH = 30
LIMIT = 0.5
SEP = common.separators("alnum")


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By slice: first row, hashes of features (words and beginnings, a row each kind), the words' texts, words of each text."""
    for lo, _, data, offsets in common.text_chunks(column):
        data = common.LOWER[data]
        starts, ends, first = common.split_words(data, offsets, SEP)
        kinds = [common.span_hashes(data, starts, ends)]
        for n in PREFIXES:
            h = common.mix(common.span_hashes(data, starts, np.minimum(starts + n, ends)) + np.uint64(n))
            kinds.append(np.where(ends - starts < n, kinds[0], h))  # a shorter word stands for itself
        yield lo, np.stack(kinds), np.repeat(np.arange(len(first) - 1), np.diff(first)), np.diff(first)


def bucket(f: np.ndarray) -> np.ndarray:
    return (f >> np.uint64(45)).astype(np.int64)


def log_odds_z(toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far the log-odds of being in toxic against clean documents are from 0, in standard errors."""
    a, b, c, d = toxic + 0.5, clean + 0.5, n1 - toxic + 0.5, n0 - clean + 0.5
    z = (np.log(a / c) - np.log(b / d)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return np.where(toxic + clean < MIN_DOCS, 0, z)


@dataclass
class Model:
    """Kept features in order, which buckets they fall in, their weights, and the ordered thresholds."""

    kept: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each score."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -50, 50)))


def places(f: np.ndarray, kept: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, kept feature) for all that are kept."""
    kind, word = np.nonzero(np.unpackbits(buckets).astype(bool)[bucket(f)])
    h = f[kind, word]
    at = np.minimum(np.searchsorted(kept, h), max(0, len(kept) - 1))
    ok = kept[at] == h if len(kept) else np.zeros(len(h), bool)
    return word[ok], at[ok]


def amounts(f: np.ndarray, text: np.ndarray, n: np.ndarray, kept: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kept feature, amount) for features that a text has: the log of one and its words in a hundred, where a
    text counts ``SMOOTH`` words more than it has, so that one word of a short text is no more than a hint."""
    word, at = places(f, kept, buckets)
    key, c = np.unique(text[word] * KEEP + at, return_counts=True)
    return key // KEEP, key % KEEP, np.log1p(100 * c / (n[key // KEEP] + SMOOTH))


def fit_ordinal(text: np.ndarray, feature: np.ndarray, x: np.ndarray, y: np.ndarray, size: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least penalised log loss, by FISTA; thresholds are kept in order by their gaps."""
    n = len(y)
    w, t = np.zeros(size), np.linspace(0.5, 1.5, grades - 1)
    above = (y[:, None] >= np.arange(1, grades)).astype(float)
    # rows of either kind weigh alike, or the common grade would hide the others
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    # the loss bends at most by a quarter for each threshold and the largest eigenvalue of the weighted squares
    v, bias, size2 = np.ones(size), 1.0, 1.0
    for _ in range(30):
        z = (np.bincount(text, weights=x * v[feature], minlength=n) + bias) * weight
        v, bias = np.bincount(feature, weights=x * z[text], minlength=size), z.sum()
        size2 = float(np.sqrt(v @ v + bias * bias))
        v, bias = v / size2, bias / size2
    step = 4 / (1.05 * (grades - 1) * size2)
    vw, vt, m = w.copy(), t.copy(), 1.0
    for _ in range(STEPS):
        z = np.bincount(text, weights=x * vw[feature], minlength=n)
        err = (1 / (1 + np.exp(-np.clip(z[:, None] - vt, -50, 50))) - above) * weight[:, None]
        nw = vw - step * np.bincount(feature, weights=x * err.sum(1)[text], minlength=size)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * L1, 0)
        nt = np.maximum.accumulate(vt + step * err.sum(0))
        if (vw - nw) @ (nw - w) + (vt - nt) @ (nt - t) > 0:
            m = 1.0  # the momentum leads uphill: begin anew
        nm = (1 + np.sqrt(1 + 4 * m * m)) / 2
        vw, vt = nw + (m - 1) / nm * (nw - w), nt + (m - 1) / nm * (nt - t)
        w, t, m = nw, nt, nm
    return w, t


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    labelled = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    fraction = min(1.0, max_train / max(1, labelled.count()))
    # about max_train ids, whatever the labels' number; Spark broadcasts them where they are as small as that
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < fraction * (1 << 30)).distinct()
    rows = common.save(docs.where("text is not null").select("doc_id", "text").join(common.save(picked, "picked"), "doc_id"), "labelled")
    if (n := rows.count()) > 2 * max_train:  # ids that stand on many rows: the sample keeps its bound
        thin = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 30)) < max_train / n * (1 << 30)
        rows = common.save(rows.where(thin).dropDuplicates(["doc_id", "text", "toxic"]), "labelled")

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        toxic = np.array(batch.column(1).to_pylist()) > 0
        for lo, f, text, n in features(batch.column(0)):
            f = bucket(f)
            for k, mine in enumerate((~toxic[lo : lo + len(n)], toxic[lo : lo + len(n)])):
                key = np.unique(np.concatenate([text[mine[text]] * BUCKETS + row[mine[text]] for row in f]))
                total[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(key % BUCKETS, minlength=BUCKETS)
                total[2 * BUCKETS + k] += int(mine.sum())

    sums = common.summed_vector(rows.select("text", "toxic"), add, 2 * BUCKETS + 2)
    clean, toxic, (n0, n1) = sums[:BUCKETS], sums[BUCKETS : 2 * BUCKETS], sums[2 * BUCKETS :].tolist()
    if not n0 or not n1:
        return None
    z = np.abs(log_odds_z(toxic, clean, n1, n0))
    chosen = np.zeros(BUCKETS, bool)
    chosen[np.argsort(-z, kind="stable")[:BUCKETS_KEPT]] = True
    buckets = np.packbits(chosen & (z > 0))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(buckets).astype(bool)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist()) > 0
            for lo, f, text, _ in features(batch.column(0)):
                kind, word = np.nonzero(wanted[bucket(f)])
                own = np.unique(np.stack([text[word], f[kind, word].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_pydict({"feature": own[1], "toxic": y[lo + own[0]].astype(np.int64)})

    each = rows.select("text", "toxic").mapInArrow(single, "feature bigint, toxic bigint").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    share = lambda x, n: (F.col(x) + 0.5) / (n - F.col(x) + 0.5)
    error = F.sqrt(sum((1 / (F.col(x) + 0.5) + 1 / (n - F.col(x) + 0.5) for x, n in (("t", n1), ("c", n0))), F.lit(0.0)))
    each = each.where(F.col("t") + F.col("c") >= MIN_DOCS).withColumn("z", (F.log(share("t", n1)) - F.log(share("c", n0))) / error).where(F.abs("z") > LEAST_Z)
    with common.small_batches(docs.sparkSession):
        best = sorted(each.orderBy(F.desc(F.abs("z")), "feature").limit(KEEP).collect(), key=lambda r: r["feature"] % (1 << 64))
    kept = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    chosen = np.zeros(BUCKETS, bool)
    chosen[bucket(kept)] = True
    buckets = np.packbits(chosen)
    # clearly toxic: many times likelier in toxic rows
    clear = np.array([r["z"] > 3 and r["t"] / n1 > 20 * r["c"] / n0 for r in best], bool)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(2).to_pylist()
            for lo, f, text, n in features(batch.column(1)):
                t, feature, x = amounts(f, text, n, kept, buckets)
                edges = np.searchsorted(t, np.arange(len(n) + 1))
                word, at = places(f, kept, buckets)
                hit = np.bincount(text[np.unique(word[clear[at]])] if len(at) else [], minlength=len(n))
                edges = pa.array(edges, pa.int32())
                yield pa.RecordBatch.from_pydict({"o": batch.column(0).slice(lo, len(n)), "toxic": pa.array(y[lo : lo + len(n)], pa.int32()), "share": pa.array(hit / np.maximum(n, 1), pa.float64()), "feature": pa.ListArray.from_arrays(edges, feature.astype(np.int16)), "x": pa.ListArray.from_arrays(edges, x.astype(np.float32))})

    # the sample is bounded; it stays in arrays of few bytes on the driver, in an order that does not depend on tasks
    with common.small_batches(docs.sparkSession):
        got = rows.select(F.xxhash64("doc_id", "text").alias("o"), "text", "toxic").mapInArrow(sample, "o bigint, toxic int, share double, feature array<smallint>, x array<float>").toArrow().sort_by("o")
    y, dense = got["toxic"].to_numpy().astype(np.int64), got["share"].to_numpy()
    middle = float(np.median(dense[y > 0])) if (y > 0).any() else 0.0
    grade = np.where(y > 0, 1 + (dense > middle), 0)
    text = np.repeat(np.arange(len(y)), pc.list_value_length(got["feature"]).to_numpy())
    feature = pc.list_flatten(got["feature"]).to_numpy().astype(np.int64)
    x = pc.list_flatten(got["x"]).to_numpy().astype(float)
    del got
    w, t = fit_ordinal(text, feature, x, grade, KEEP, 3)
    common.discard(rows)
    return Model(kept, buckets, w, t)


def severity(docs: DataFrame, model: Model | None, limit: float = LIMIT) -> DataFrame:
    """The documents with severity (the expected grade), p_toxic (of grade 1 or more) and toxic."""
    if model is None:
        return docs.withColumns({"severity": F.lit(0.0), "p_toxic": F.lit(0.0), "toxic": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: kept features, a bit for each bucket
    names = docs.columns
    at = names.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "severity double, p_toxic double, toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for lo, f, text, n in features(batch.column(at)):
                t, feature, x = amounts(f, text, n, m.kept, m.buckets)
                z[lo : lo + len(n)] = np.bincount(t, weights=x * m.weights[feature], minlength=len(n))
            p = m.at_least(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= limit)], names=[*names, "severity", "p_toxic", "toxic"])

    return docs.mapInArrow(run, schema)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return severity(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "severity", "p_toxic", "toxic")


def rejected_removed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    rows, restore = common.neutral(docs)
    return restore(severity(rows, fit(docs, labels)).where("not toxic"))
