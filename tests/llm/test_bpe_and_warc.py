"""Byte pairs against the tiktoken library; archives against what went in."""

import base64
import hashlib
import random
import time
import struct

import public_tokenizers
import pytest
import tiktoken

from taktwerk.llm import bpe, queries, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merger():
    return bpe.Merger(PATH)


def test_random_texts(encoding, merger):
    rng = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "é", "1", "٣", "!", "...", "　", "👍", "̀", "\x1c", "\x85", "東"]
    texts = ["", " ", "'s", "a" * 500, "ab" * 1000 + " " * 300] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert list(merger.encode(texts)) == [encoding.encode_ordinary(t) for t in texts]


def test_classes_of_code_points(encoding, merger):
    points = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c}" for c in points]
    assert list(merger.encode(texts)) == encoding.encode_ordinary_batch(texts)


def test_query(spark, sf, encoding):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op3_byte_bpe(spark, sf).collect():
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges_and_round_trip(edges, nothing):
    coded = bpe.encode(edges, PATH)
    texts = sorted((r.doc_id or 0, (r.text or "").encode()) for r in edges.collect())
    assert sorted((r.doc_id or 0, bytes(r.data)) for r in bpe.decode(coded, PATH).collect()) == texts
    for r in coded.where("doc_id = 10").collect():
        assert len(r.offsets) == len(r.ids) and r.offsets[0] == 0 and r.offsets == sorted(r.offsets)
    assert bpe.digests(nothing, PATH).count() == 0


def test_archive_starts_with_its_dictionary():
    records = [warc.record(i, f"http://x/{i}", b"<html>" + b"the same words again and again " * 20 + str(i).encode(), None) for i in range(400)]
    packed = warc.pack(records)
    magic, size = struct.unpack_from("<II", packed)
    assert magic == warc.SKIPPABLE_MAGIC and size > 0
    assert list(warc.unpack(packed)) == records
    assert len(packed) < sum(map(len, records)) / 5
    assert list(warc.unpack(warc.pack(records[:1]))) == records[:1]  # too few to train


def test_warc_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages, reverse=True):
        first[pages[i]] = i
    rows = queries.op10_warc(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[body] == r.page_id else ("revisit", first[body]))


def test_warc_edges(spark):
    rows = [(3, "u", "x"), (1, None, "x"), (1, None, "x"), (2, "a\r\nb", None), (5, "u", ""), (None, "u", "x"), (None, "v", "only"), (7, "u", "ü" * 100_000), (8, "u", "ü" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.archive_and_read(df).collect())
    assert got == [(0, 1, "revisit", 1), (0, 4, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (2, 0, "response", 0), (3, 1, "revisit", 1), (5, 0, "revisit", 2), (7, 200_000, "response", 0), (8, 200_000, "revisit", 7)]
    bodies = {r.page_id: bytes(r.payload) for r in warc.archive_and_read(df, min_bytes=2).collect() if r.page_id in (1, 3, 8)}
    assert bodies == {1: b"x", 3: b"x", 8: b""}
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_wrong_payloads_and_counts_are_errors(spark, tmp_path):
    whole = warc.record(1, "http://a", b"body of a page", None)
    for name, records, n in (("good", [whole], 1), ("payload", [whole.replace(b"body of", b"corp of")], 1), ("short", [whole], 2)):
        path = tmp_path / f"{name}.warc"
        path.write_bytes(warc.pack(records))
        read = warc.read(spark.createDataFrame([(str(path), n, 1)], "archive string, n_records long, n_bytes long"))
        if name == "good":
            assert [(r.page_id, r.payload_bytes) for r in read.collect()] == [(1, 14)]
        else:
            with pytest.raises(Exception, match="digest of its header" if name == "payload" else "in the manifest"):
                read.collect()


def test_reading_takes_time_in_proportion():
    """Steps of the reader never copy the rest of an archive: twice the records take about twice as long."""
    took = []
    for n in (8000, 32_000):
        archive = warc.pack([warc.record(i, f"https://e.org/{i}", f"page {i} of text ".encode() * 9, None) for i in range(n)])
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            assert sum(1 for _ in warc.unpack(archive)) == n
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 8 * took[0]
    with pytest.raises(ValueError):
        list(warc.unpack(archive[:-5]))
