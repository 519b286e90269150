import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from taktwerk.llm import common


@pytest.mark.parametrize("kind, pattern", [("space", r"[^\x20\x09-\x0D]+"), ("alnum", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_words_are_the_patterns(kind, pattern):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1 \t\n.,ßé東🙂Z") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " "]
    got = []
    for _, n, data, offsets in common.text_chunks(pa.array(texts), limit=500):
        starts, ends, first = common.split_words(data, offsets, common.separators(kind))
        words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        got += [words[a:b] for a, b in zip(first[:-1], first[1:])]
    assert got == [re.findall(pattern, t or "") for t in texts]


def test_hashes_tell_spans_apart():
    data = np.frombuffer(b"abc abd abc \0 \0\0 a", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 14, 17]), np.array([3, 7, 11, 13, 16, 18])
    h = common.span_hashes(data, starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 5


def test_summed_vector(spark):
    def add(total, batch):
        total += np.bincount(np.array(batch.column(0)) % 1000, minlength=1000)

    got = common.summed_vector(spark.range(5000).repartition(7), add, 1000, ranges=3)
    assert (got == 5).all()
    assert not common.summed_vector(spark.range(0), add, 1000).any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    sizes = collections.Counter(find(x) for x in parent)
    want = {x: find(x) for x in parent if sizes[find(x)] > 1}
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_the_session_keeps_its_settings(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = common.save(common.table(spark, sf, "documents"), "copy")
    common.summed_vector(docs.select("doc_id"), lambda total, batch: None, 4)
    assert spark.conf.get(name) == before
    common.discard(docs)
