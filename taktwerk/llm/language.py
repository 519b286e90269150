"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, what is no letter becomes one space, and n-grams of 1 to 3 characters are hashed to 2**15
features with weight log(1 + count) * idf, scaled to length 1. Document frequencies are counted over all training
rows. The weights are learned by follow-the-regularised-leader with L1 and L2 penalties on a bounded sample
(``MAX_TRAIN`` rows, spread evenly over the ``MAX_LANGUAGES`` most frequent languages, by a hash of key and text; repeated
rows count once in it); on a part of the sample that the weights never see, a
temperature is fitted that calibrates the scores.

Defined results: a null text, or one without a letter, is ``und`` with score 0; the language, the source and the key
are never inputs of a prediction; rows with a null key, text or language teach nothing, and a null key counts as not
held out; without training rows all is ``und``; ties go to the language first in the alphabet; repeated rows get the
same result; an empty table gives an empty table; other columns are not read. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import bpe, common

FEATURES = 1 << 15
MAX_TRAIN = 3000
#: Languages that are learned, the most frequent ones: the weights have a column for each.
MAX_LANGUAGES = 1000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 1e-3
UNKNOWN = "und"


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def gram_counts(column: pa.Array) -> Iterator[np.ndarray | None]:
    """For each text the counts of its hashed n-grams; nothing for a text without a letter."""
    letters = bpe.code_point_classes() == bpe.LETTER
    for lo, n, _, _ in common.text_chunks(column):
        for text in column.slice(lo, n).to_pylist():
            points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
            is_letter = letters[points]
            if not is_letter.any():
                yield None
                continue
            c = np.where(is_letter, points, 32).astype(np.uint64)
            c = c[is_letter | np.append(True, is_letter[:-1])]
            c = np.concatenate([[np.uint64(32)], c, [np.uint64(32)]])
            grams = [c[1:-1] * np.uint64(0x9E3779B97F4A7C15)]
            for _ in range(2):
                last = grams[-1]
                m = len(last) - 1
                grams.append((last[:m] ^ (c[len(grams) + 1 :][:m] + np.uint64(0x51ED27))) * np.uint64(0xD6E8FEB86659FD93))
            yield np.bincount((np.concatenate(grams) >> np.uint64(49)).astype(np.int64), minlength=FEATURES)


@dataclass
class Model:
    """Languages, idf, weights (features x languages), bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        v = np.log1p(counts[at]) * self.idf[at]
        return at, v / np.sqrt(v @ v)

    def scores(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties; the bias carries none."""
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        l1 = np.where(at == features, 0.0, L1)[:, None]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at, v, y = rows[r]
            at, v = np.append(at, features), np.append(v, 1.0)
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(features + 1))
    return w[:-1], w[-1]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by search over a fine geometric grid."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.02, 20, 200)
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", max_train: int = MAX_TRAIN) -> Model | None:
    """Learns from the rows of ``train``. Counts cover all rows; the weights come from ``max_train`` rows at most."""
    train = train.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(label).isNotNull()).select(key, text, label)
    counts = train.groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LANGUAGES)
    sizes = {r[label]: r["count"] for r in counts.collect()}
    train = train.where(F.col(label).isin(*sizes)) if len(sizes) == MAX_LANGUAGES else train
    if not sizes:
        return None
    languages = sorted(sizes)
    share = max_train / len(languages)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for counts in gram_counts(batch.column(0)):
            if counts is not None:
                total[:-1] += counts > 0
                total[-1] += 1

    df = common.summed_vector(train.select(text), add, FEATURES + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, np.flatnonzero(c), c) for i, c in enumerate(gram_counts(batch.column(1))) if c is not None]
            which = pa.array([i for i, _, _ in got], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(2).take(which), pa.array([a.astype(np.int32) for _, a, _ in got], pa.list_(pa.int32())), pa.array([c[a].astype(np.int32) for _, a, c in got], pa.list_(pa.int32()))], names=["o", "label", "at", "n"])

    order = F.xxhash64(key, text, F.lit(11))
    below = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, share / sizes[lang])))])
    picked = train.where(F.pmod(order, F.lit(1 << 30)) < below[F.col(label)] * (1 << 30)).select(order.alias("o"), text, label).dropDuplicates(["o", label])
    with common.small_batches(train.sparkSession):
        rows = picked.mapInArrow(sample, "o bigint, label string, at array<int>, n array<int>").toArrow()
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    made = []
    for o, lang, at, n in zip(*(rows.column(c) for c in ("o", "label", "at", "n"))):
        counts = np.zeros(FEATURES, np.int64)
        counts[at.values.to_numpy()] = n.values.to_numpy()
        made.append((o.as_py(), *model.vector(counts), languages.index(lang.as_py())))
    made.sort(key=lambda r: (r[0], r[3]))
    learn = [r[1:] for i, r in enumerate(made) if i % 5] or [r[1:] for r in made]
    check = [r[1:] for i, r in enumerate(made) if i % 5 == 0]
    model.weights, model.bias = follow_the_leader(learn, len(languages), FEATURES)
    model.temperature = fit_temperature(np.array([model.scores(a, v) for a, v, _ in check]), np.array([y for _, _, y in check], np.int64))
    return model


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: features x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, score = [], []
            for counts in gram_counts(batch.column(2)):
                if counts is None or m is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = softmax(m.scores(*m.vector(counts)) / m.temperature)
                pred.append(m.languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return docs.select(key, held_out(F.col(key)).alias("held_out"), text).mapInArrow(run, f"{key} bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all."""
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id")))))
