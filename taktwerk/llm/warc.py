"""WARC archives compressed record by record with a Zstandard dictionary, written and read back.

An archive starts with a skippable frame that holds the dictionary (itself compressed); after it each record is
one frame of its own, so that any record can be read from its offset. Payloads that occur again are written as
revisit records that refer to the first: of equal payloads the smallest page_id is the response.

Defined results: a null payload is the empty payload, and equal to it; a null page_id sorts after all others (among
equal payloads it is a revisit unless every page_id is null, then a response); repeated rows are each written;
rows with the first's page_id and payload are responses; an empty table writes no archive and reads as an empty
table; a null url is written without a target. Columns other than page_id, url and html are not read.

Every task writes its own archives of bounded size under a name of its own and renames each when it is whole, so a
task that runs again leaves no half archive; the manifest of a run names the archives that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import common

# fixed values of the formats
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records from which an archive's dictionary is built, and the dictionary's size at most.
SAMPLE_BYTES, DICT_BYTES = 2 << 20, 64 << 10
#: Bytes of records before compression at which an archive is closed.
ARCHIVE_BYTES = 64 << 20
#: Bytes that the reader looks at together: what it takes up beyond a record's end is copied, so this stays small.
STEP = 16 << 10
DATE = "2024-01-01T00:00:00Z"


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload (binary), payload_key and refers_to (null for a response).

    Only page ids and digests are dealt by digest, aggregated before the shuffle; the payloads are joined by
    page_id and digest, so a payload that a third of all pages share does not gather anywhere.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_key", F.unhex(F.sha2("payload", 256)))
    small = rows.where(F.length("payload") >= min_bytes).select("page_id", "payload_key")
    first = small.groupBy("payload_key").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = small.distinct().join(first, "payload_key").where("first_id is not null and (page_id is null or page_id <> first_id)")
    later = later.select(F.col("page_id").alias("id_"), F.col("payload_key").alias("key_"), "first_id")
    return rows.join(later, rows["page_id"].eqNullSafe(later["id_"]) & (rows["payload_key"] == later["key_"]), "left").select("page_id", "url", "payload", F.col("first_id").alias("refers_to"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, its payload left out of a revisit."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from the first ``SAMPLE_BYTES`` of an archive's records; empty where they are too few to train."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        part = r[: 64 << 10]
        sample.append(part)
        size += len(part)
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, size // 8)), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes]) -> bytes:
    """An archive: the skippable frame with the dictionary, then a frame for each record."""
    trained = build_dictionary(records)
    inner = zstandard.ZstdCompressor(level=9).compress(trained)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdCompressor(level=3)
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(inner)), inner, *map(coder.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame after the other."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive does not start with a dictionary")
    trained = zstandard.ZstdDecompressor().decompress(archive[8 : 8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    at = 8 + size
    view = memoryview(archive)
    while at < len(archive):
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ValueError(f"no frame at {at}")
        one, out = reader.decompressobj(), []
        while not one.eof:
            part = view[at : at + STEP]
            if not len(part):
                raise ValueError("the archive ends inside a record")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives into ``folder`` (a URI all executors reach); returns the manifest (archive, n_records, n_bytes)."""
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size
            data, name = pack(held), f"{uuid.uuid4().hex}.warc.zst"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/_{name}") as f:
                f.write(data)
            store.move(f"{root}/_{name}", f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"archive": pa.array([f"{folder}/{name}"]), "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})
            held, size = [], 0
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if held:
            yield close()

    return mark_revisits(pages, min_bytes).mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response whose body has another length or digest than its header says, or an archive with another number of
    records than the manifest says, is an error.
    """
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def number(urn: str | None) -> int | None:
        text = (urn or "")[10:-1]
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = _store(uri)
                with store.open_input_stream(path) as f:
                    archive = f.read()
                rows: list[tuple] = []
                size = n = 0
                for raw in unpack(archive):
                    h, body = parse(raw)
                    n += 1
                    if h["WARC-Type"] == "response" and (len(body) != int(h["X-Payload-Length"]) or sha1_base32(body) != h["WARC-Payload-Digest"][5:]):
                        raise ValueError(f"{uri}: {h['WARC-Record-ID']} does not have the length or digest of its header")
                    rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), body, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], number(h.get("WARC-Refers-To"))))
                    size += len(body)
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{uri}: {n} records, {expected} in the manifest")
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})

    return manifest.select("archive", "n_records").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder, keeps the manifest there, and reads the records back."""
    spark = pages.sparkSession
    manifest = common.save(write(pages, common.scratch_path(spark, "warc"), min_bytes), "warc-manifest")
    n = max(1, spark.sparkContext.defaultParallelism)
    return read(manifest.repartition(n, "archive"))
