"""Quality by hierarchical empirical Bayes: a document's own evidence combined with its host's and path's record.

A logistic regression on a dozen counts of the text gives each document's evidence, as log odds against the base rate
of its training rows (a bounded sample, ``MAX_TRAIN``). The evidence of all documents is summed by path and by host
(one grouped aggregation each, summed before the shuffle). The spread between hosts and between paths gives the
strength of the priors by the method of moments, so sites with few documents shrink to their host and hosts to the
whole corpus. The posterior of a document adds its evidence to its path's prior log odds, in which the document itself
has no part.

Defined results: a null text has the counts of an empty one; a null host or path is a group of its own, apart from the empty one; labels that are
null, or without a document, teach nothing; without labels of both kinds the evidence is 0 and the prior one half;
repeated rows count each and get the same result; a null doc_id is a row like any other; an empty table gives an
empty table; other columns are not read. Whole texts are measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import common

MAX_TRAIN = 50_000
RIDGE, NEWTON_STEPS = 1e-2, 30
SALTS = 16
LIMIT = 0.5
MEASURES = ("upper", "digit", "symbol", "mark", "space", "long", "words", "word_length", "new_words", "repeated_lines", "line_words")
SEP = common.separators("space")
_SETS = {"upper": range(65, 91), "digit": range(48, 58), "symbol": map(ord, "#*$%&|<>{}[]\\^~_=+@"), "mark": map(ord, ".,;:!?'\"()-"), "space": (9, 10, 11, 12, 13, 32), "long": range(128, 256)}
_CLASS = np.zeros((6, 256))
for _row, _name in zip(_CLASS, MEASURES):
    _row[list(_SETS[_name])] = 1


def measures(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text: shares of kinds of bytes, and how words and lines repeat."""
    for _, _, data, offsets in common.text_chunks(column):
        starts, ends, first = common.split_words(data, offsets, SEP)
        h = common.span_hashes(common.LOWER[data], starts, ends)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            text = data[offsets[i] : offsets[i + 1]]
            share = _CLASS @ np.bincount(text, minlength=256) / max(1, len(text))
            n = int(b - a)
            lines = bytes(text).split(b"\n")
            yield np.array([*share, np.log1p(n), (ends[a:b] - starts[a:b]).sum() / max(1, n) / 10, len(np.unique(h[a:b])) / max(1, n), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept last) by Newton steps with a ridge; rows of either kind weigh alike."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + RIDGE * w
        hess = (x.T * (weight * p * (1 - p))) @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measured(docs: DataFrame) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names if n != "text"), pa.array(list(measures(batch.column(names.index("text")))), pa.list_(pa.float64()))], names=[*(n for n in names if n != "text"), "x"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "x array<double>"]))


def evidence(docs: DataFrame, labels: DataFrame, host: str, path: str, max_train: int = MAX_TRAIN) -> tuple[DataFrame, float]:
    """(doc_id, host, path, evidence) of all documents, and the share of good ones among the labelled."""
    rows = docs.select("doc_id", common.told_apart(F.col(host)).alias("host"), common.told_apart(F.col(path)).alias("path"), "text")
    rows = common.save(_measured(rows), "measures")
    labelled = rows.join(labels.where("quality is not null").select("doc_id", "quality"), "doc_id")
    bad, good = labelled.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") != 0)).first()
    if not bad or not good:
        return rows.select("doc_id", "host", "path", F.lit(0.0).alias("evidence")), 0.5
    share = min(1.0, max_train / (bad + good))
    spread = F.xxhash64("doc_id", F.lit(9))
    some = labelled.where(F.pmod(spread, F.lit(1 << 30)) < share * (1 << 30)).orderBy(spread, "doc_id", F.xxhash64("x"), "quality")
    train = some.limit(max_train).select("x", "quality").toArrow()  # however many rows an id has
    w = fit_logistic(np.array(train["x"].to_pylist()), (np.array(train["quality"].to_pylist()) > 0).astype(float))
    z = reduce(lambda a, b: a + b, (F.col("x")[i] * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    # the kinds weighed alike, so the log odds are against even ones: evidence alone
    return rows.select("doc_id", "host", "path", z.alias("evidence")), good / (bad + good)


def _logit(p):
    return F.log(p / (1 - p))


def posteriors(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", limit: float = LIMIT) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, quality, kept) for each document."""
    own, base = evidence(docs, labels, host, path)
    prior = float(np.log(base / (1 - base)))
    q = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("evidence") + prior))))
    paths = own.withColumn("q", q).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("s"), F.sum(F.col("q") * F.col("q")).alias("ss"))
    paths = common.save(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = total["s"] / total["n"] if total["n"] else base

    def strength(groups: DataFrame, n: str, s: str) -> float:
        """How many documents the prior weighs: from the spread of group rates beyond that of drawing documents."""
        r = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - rate) ** 2).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
        inner = rate * (1 - rate)
        span = (r["n"] - r["nn"] / r["n"]) if r["n"] else 0
        between = (r["v"] - (r["k"] - 1) * inner) / span if span else 0
        return float(min(1e6, max(1.0, inner / between - 1))) if between and between > 0 else 1e6

    of_host, of_path = strength(hosts, "hn", "hs"), strength(paths, "n", "s")
    # a site with many documents is dealt by salt; its sums are copied instead
    sums = paths.join(hosts, "host").select("host", "path", "n", "s", "hn", "hs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = own.withColumn("q", q).withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int"))
    out = own.join(sums, ["host", "path", "salt"])
    # the others' record: a document's evidence counts once
    out = out.withColumn("host_rate", (F.col("hs") - F.col("q") + of_host * rate) / (F.col("hn") - 1 + of_host))
    out = out.withColumn("path_rate", (F.col("s") - F.col("q") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("path_rate")))))))
    return out.select("doc_id", "evidence", "host_rate", "path_rate", quality.alias("quality"), (quality >= limit).alias("kept"))
