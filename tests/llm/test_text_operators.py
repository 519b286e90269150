"""Language, toxicity, quality, licences and line rules."""

import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from taktwerk.llm import language, licenses, line_rules, quality, queries, toxicity


def test_language_learns_and_holds_out(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_language(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, edges, nothing):
    rows = language.identify(edges).collect()
    assert len(rows) == edges.count()
    blank = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert len(blank) == 3 and all((r.lang_pred, r.score) == ("und", 0.0) for r in blank)
    assert language.identify(nothing).count() == 0
    unknown = language.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_prediction_reads_the_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs)
    a = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in language.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("xx")), model).collect()}
    assert a == b


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(500, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(z / 0.7)])
    t = language.fit_temperature(z, y)
    loss = lambda t: -np.log(language.softmax(z / t)[np.arange(500), y]).mean()
    assert loss(t) <= loss(1.0) and 0.4 < t < 1.2


def test_toxicity_on_labels(spark, sf):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf).collect()
    known = [r for r in rows if r.doc_id in labels]
    assert sum(r.toxic == bool(labels[r.doc_id]) for r in known) >= 0.97 * len(known)
    assert all(0 <= r.severity <= 2 for r in rows)


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 3))
    y = np.clip(x[:, 0] + x[:, 1], 0, 2)
    text, feature = np.nonzero(x)
    w, t = toxicity.fit_ordinal(text, feature, np.ones(len(text)), y, 3, 3)
    p = toxicity.Model(np.zeros(0), np.zeros(0), w, t).at_least(x @ w)
    assert t[0] <= t[1] and (p[:, 0] >= p[:, 1]).all()
    assert abs(w[2]) < 0.5 * min(w[0], w[1])
    assert ((p > 0.5).sum(1) == y).mean() > 0.9


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (8, 0), (99, 1), (None, 1), (2, None), (13, 0)], "doc_id long, toxic int")
    kept = toxicity.rejected_removed(edges, labels)
    assert kept.columns == edges.columns
    assert toxicity.graded(edges, labels).count() == edges.count()
    assert toxicity.rejected_removed(nothing, labels).count() == 0
    assert toxicity.rejected_removed(edges, labels.where("toxic = 0")).count() == edges.count()


def test_quality_shrinks_small_sites(spark):
    rng = random.Random(5)
    good = lambda: "A fine sentence with " + " ".join(rng.choices(["some", "plain", "words", "here"], k=30)) + "."
    bad = lambda: " ".join(rng.choices(["BUY!!!", "###", "|||", "NOW$$$"], k=30))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "mixed") for i in range(200)] + [(1000 + i, bad(), "en", "spam") for i in range(60)] + [(2000, good(), "en", "tiny"), (2001, good(), None, None), (2002, None, "en", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(0, 120)] + [(1000 + i, 0) for i in range(20)] + [(5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.posteriors(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept != (i % 4 == 0) for i in range(200))
    assert got[1000].path_rate < got[2000].path_rate < got[1].path_rate + 0.2
    assert got[1000].host_rate < 0.3 < got[1].host_rate


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1), (9, 0), (12, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    assert quality.posteriors(edges, labels).count() == edges.count()
    assert quality.posteriors(nothing, labels).count() == 0
    none = quality.posteriors(edges, labels.where("quality = 1")).collect()
    assert {r.evidence for r in none} == {0.0} and all(r.kept for r in none)


def test_licences(spark, edges, nothing):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit), (2, mit.upper().replace(",", " ;")), (3, mit + " and more"), (4, None), (5, ""), (6, "text\nLicenced under CC-BY-NC 4.0!\nmore"), (6, "text\nLicenced under CC-BY-NC 4.0!\nmore"), (None, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((r.doc_id or 0, r.line, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, "Apache-2.0"), (0, 1, "Apache-2.0"), (1, 0, "MIT"), (2, 0, "MIT"), (6, 2, "CC-BY-NC-4.0"), (6, 2, "CC-BY-NC-4.0")]
    assert licenses.scan(nothing).count() == 0 and licenses.scan(edges).count() == 0
    long_table = licenses.known_table(spark).unionByName(spark.createDataFrame([(f"x{i}", f"text number {i}") for i in range(licenses.BROADCAST_ROWS)], "license_id string, text string"))
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), long_table).count() == len(got)


def test_full_licence_files(spark):
    texts = dict(licenses.KNOWN[:3])
    files = {}
    for i, t in licenses.KNOWN[13:]:
        files.setdefault(i, t)
    wrapped = lambda t: "\n\n".join(textwrap.fill(p, 78) for p in t.split("\n\n"))
    told = "\n\nCopyright (c) 2021 Some Body <some@body.org>\nAll rights reserved.\n\n"
    docs = [
        ("MIT", "MIT License" + told + wrapped(texts["MIT"]) + "\n"), ("MIT", "The MIT License (MIT)" + told + wrapped(texts["MIT"])), ("ISC", "ISC License" + told + wrapped(texts["ISC"])),
        ("BSD-3-Clause", "BSD 3-Clause License" + told + files["BSD-3-Clause"]),
        ("Apache-2.0", files["Apache-2.0"]), ("GPL-2.0", files["GPL-2.0"]), ("GPL-3.0", files["GPL-3.0"]), ("AGPL-3.0", files["AGPL-3.0"]), ("MPL-2.0", files["MPL-2.0"]), ("Zlib", files["Zlib"]), ("Unlicense", files["Unlicense"]),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")).where("line = 0").collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(i, n) for i, (n, _) in enumerate(docs)]


def test_licences_at_every_width(spark):
    """The usual file, with and without its title, whatever the width of its lines."""
    files = {}
    for i, t in licenses.KNOWN[13:]:
        files.setdefault(i, t)
    texts = {"MIT": dict(licenses.KNOWN[:3])["MIT"], "BSD-3-Clause": files["BSD-3-Clause"], "PostgreSQL": files["PostgreSQL"]}
    docs = []
    for name, title in (("MIT", "MIT License\n\n"), ("MIT", ""), ("BSD-3-Clause", ""), ("PostgreSQL", "")):
        for width in range(20, 121, 3):
            body = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False) for p in texts[name].split("\n\n"))
            docs.append((name, f"{title}Copyright (c) 2021 Some Body\nAll rights reserved.\n\n{body}\n"))
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id long, text string")).where("line = 0").collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(i, n) for i, (n, _) in enumerate(docs)]
    whole = {i for i, t in licenses.KNOWN if len(t) > 150}
    assert len(whole) >= 30


@pytest.mark.parametrize("n", [10, 11])
def test_line_limit(spark, n):
    shared = "this line stands in many documents of one host and says nothing new at all really"
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(45))
    rows = [(i, "\n".join([shared, f"{shared} "] * 8 + [own(i)]), "h") for i in range(n)] + [(99, "\n".join([shared] * 8 + [own(99)]), "other")]
    got = {r.doc_id: r for r in line_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].base_failed or got[0].n_repeat_words > 0
    depleted = {(r.text_key) for r in line_rules.depleted(line_rules.line_counts(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert len(depleted) == (n if n > line_rules.MAX_DOCS else 0)
    left = line_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r.doc_id: (shared in r.text) for r in left.collect()} == {**{i: n <= line_rules.MAX_DOCS for i in range(n)}, 99: True}


@pytest.mark.parametrize("n", [10, 11])
def test_copies_are_documents_of_their_host(spark, n):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4))
    rows = [(i, text, "h") for i in range(n)] * 3 + [(90, text, "other"), (91, text, None)]  # repeated rows are one document
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = {(r.doc_id, r.kept) for r in line_rules.verdicts(docs).collect()}
    assert kept == {(i, n <= line_rules.MAX_DOCS) for i in range(n)} | {(90, True), (91, True)}
    assert all(r.kept for r in line_rules.verdicts(docs, count_copies=False).collect())


def test_line_edges(spark, edges, nothing):
    rows = line_rules.verdicts(edges).collect()
    assert len(rows) == edges.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert {r.n_words for r in rows if r.doc_id == 5} == {60_000}
    assert line_rules.verdicts(nothing).count() == 0


def test_null_hosts_are_not_empty_ones(spark):
    shared = "this line stands in many documents of one host and says nothing new at all really"
    rows = [(i, "\n".join([shared] * 8 + [" ".join(f"own{i}x{j}" for j in range(45))]), None if i % 2 else "") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_rules.depleted(line_rules.line_counts(table)).count() == 0  # six documents of each
    more = table.unionByName(spark.createDataFrame([(100 + i, rows[1][1], None) for i in range(6)], table.schema))
    assert line_rules.depleted(line_rules.line_counts(more)).count() == 0  # copies are one text
    lines = line_rules.line_counts(more).join(line_rules.text_counts(more), ["host", "text_key"])
    assert line_rules.depleted(lines).count() == 6  # or documents each: twelve of the null host
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(12)], "doc_id long, quality int")
    rates = {r.host_rate for r in quality.posteriors(table.withColumn("lang", F.lit("en")), labels).collect()}
    assert len(rates) > 1


def test_posteriors_against_plain_sums(spark, sf):
    """Evidence, spreads and shrunken rates recomputed over plain lists."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own, base = quality.evidence(docs, labels, "source", "lang")
    rows = own.collect()
    e = np.array([r.evidence for r in rows])
    q = 1 / (1 + np.exp(-np.clip(e + np.log(base / (1 - base)), -30, 30)))
    rate = q.mean()

    def sums(keys):
        n, s = {}, {}
        for k, x in zip(keys, q):
            n[k], s[k] = n.get(k, 0) + 1, s.get(k, 0) + x
        return n, s

    def strength(n, s):
        size, inner = sum(n.values()), rate * (1 - rate)
        v = sum(n[k] * (s[k] / n[k] - rate) ** 2 for k in n)
        between = (v - (len(n) - 1) * inner) / (size - sum(x * x for x in n.values()) / size)
        return min(1e6, max(1.0, inner / between - 1)) if between > 0 else 1e6

    host, path = [r.host for r in rows], [(r.host, r.path) for r in rows]
    (hn, hs), (pn, ps) = sums(host), sums(path)
    of_host, of_path = strength(hn, hs), strength(pn, ps)
    want = {}
    for r, h, p, x in zip(rows, host, path, q):
        of = (hs[h] - x + of_host * rate) / (hn[h] - 1 + of_host)
        at = min(1 - 1e-9, max(1e-9, (ps[p] - x + of_path * of) / (pn[p] - 1 + of_path)))
        want.setdefault(r.doc_id, 1 / (1 + np.exp(-(r.evidence + np.log(at / (1 - at))))))
    got = quality.posteriors(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(abs(r.quality - want[r.doc_id]) < 1e-9 for r in got)
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    pairs = [(r.kept, truth[r.doc_id] > 0) for r in got if r.doc_id in truth]
    assert sum(a == b for a, b in pairs) >= 0.8 * len(pairs)


def test_leader_against_a_dense_loop():
    """The sparse updates of follow-the-regularised-leader give what the textbook loop over all weights gives."""
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        at = np.sort(rng.choice(11, 4, replace=False))
        v = rng.random(4)
        rows.append((at, v / np.sqrt(v @ v), int(at[0] % 3)))
    w, bias = language.follow_the_leader(rows, 3, 12)
    z, n = np.zeros((13, 3)), np.zeros((13, 3))
    order = np.random.default_rng(7)

    def weight(f, c):
        l1 = 0.0 if f == 12 else language.L1
        if abs(z[f, c]) <= l1:
            return 0.0
        return -(z[f, c] - np.sign(z[f, c]) * l1) / ((language.BETA + np.sqrt(n[f, c])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for r in order.permutation(len(rows)):
            at, v, y = rows[r]
            x = np.zeros(13)
            x[at], x[12] = v, 1.0
            now = np.array([[weight(f, c) for c in range(3)] for f in range(13)])
            score = np.exp(x @ now)
            p = score / score.sum()
            for f in range(13):
                for c in range(3):
                    g = (p[c] - (c == y)) * x[f]
                    sigma = (np.sqrt(n[f, c] + g * g) - np.sqrt(n[f, c])) / language.ALPHA
                    z[f, c] += g - sigma * now[f, c]
                    n[f, c] += g * g
    dense = np.array([[weight(f, c) for c in range(3)] for f in range(13)])
    assert np.allclose(w, dense[:-1]) and np.allclose(bias, dense[-1])
    assert not w[11].any()  # a feature that never occurs has no weight


def test_ordinal_fit_against_plain_likelihood():
    """Grades drawn from planted weights and thresholds are found again, as by plain gradient steps on the same loss."""
    rng = np.random.default_rng(9)
    n, size = 3000, 5
    x = rng.normal(size=(n, size))
    true_w, true_t = np.array([1.5, -1.0, 0.0, 0.5, 0.0]), np.array([0.0, 1.6])
    z = x @ true_w
    y = (rng.random(n)[:, None] < 1 / (1 + np.exp(-(z[:, None] - true_t)))).astype(int)
    u = rng.random(n)
    p = 1 / (1 + np.exp(-(z[:, None] - true_t)))
    y = (u[:, None] < p).sum(1)
    text, feature = np.repeat(np.arange(n), size), np.tile(np.arange(size), n)
    w, t = toxicity.fit_ordinal(text, feature, x.ravel(), y, size, 3)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())[:, None]
    above = y[:, None] >= np.arange(1, 3)
    a, b = np.zeros(size), np.zeros(2)
    for _ in range(20_000):
        err = (1 / (1 + np.exp(-((x @ a)[:, None] - b))) - above) * weight
        a -= 1.0 * (x.T @ err.sum(1))
        b += 1.0 * err.sum(0)
    assert np.abs(w - a).max() < 0.1 and np.abs(t - b).max() < 0.1
    assert np.abs(w - true_w).max() < 0.25 and abs((t[1] - t[0]) - 1.6) < 0.25


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    """One id on many rows, each of them labelled more than once, does not come to the driver whole."""
    seen = []
    fit = quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y: seen.append(len(x)) or fit(x, y))
    docs = spark.createDataFrame([(1 if i < 300 else i, f"word {i} again. " * (1 + i % 7), "a", "p") for i in range(320)], "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, None), *((i, i % 2) for i in range(300, 320))], "doc_id bigint, quality int")
    rows, share = quality.evidence(docs, labels, "source", "lang", max_train=40)
    assert rows.count() == 320 and seen and seen[0] <= 40 and share == 310 / 620
