"""Upstream answers as a Spark data source, for batches and streams: ``format("upstream")``.

Answers are kept as they came, a JSON object a line, in folders by kind and time of the poll::

    <path>/<kind>/poll=<epoch ms>/*.json (or .jsonl, .txt)

Kinds are ``trips`` (the active trips of a mode), ``trip`` (a single trip with its stops) and ``stops`` (the stop list);
``errors`` reads the answers of all three that hold nothing usable, with code and message. A file is a partition; a
stream's offset is the last poll that was read, so what a restarted query reads next follows from its checkpoint.

Options: ``path`` (any URI that pyarrow's file systems know), ``kind``, and for batches ``fromPoll`` and ``toPoll`` (ms,
inclusive).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from taktwerk.sources import feeds

KINDS = ("trips", "trip", "stops")
SCHEMAS = {
    "trips": "poll bigint, Produkt string, Fahrtnummer int, Betriebstag date, Linienname string, Besetzgrad string, Fahrzeugnummer string, Richtung string, FaelltAus boolean, Startzeit string, Endzeit string, StartHaltID string, EndHaltID string",
    "trip": f"poll bigint, {feeds.TRIP}",
    "stops": "poll bigint, VGNKennung int, VAGKennung string, Haltestellenname string, Latitude double, Longitude double, Produkte string",
    "errors": "poll bigint, kind string, code int, message string",
}
ROWS = 1000


# ---------------------------------------------------------------- files


class Polls(NamedTuple):
    """The folder of one kind of answers."""

    path: str
    kind: str

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, posixpath.join(root, self.kind)

    def known(self) -> list[int]:
        """The polls there are, in order; a poll whose folder holds no finished file is none."""
        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        polls = sorted(int(f.base_name.removeprefix("poll=")) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("poll="))
        return [p for p in polls if self.files(p)]

    def files(self, poll: int) -> list[str]:
        system, root = self._open()
        found = system.get_file_info(fs.FileSelector(posixpath.join(root, f"poll={poll}")))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith((".json", ".jsonl", ".txt")) and not f.base_name.startswith(("_", ".")))

    def lines(self, poll: int, name: str) -> Iterator[bytes]:
        system, root = self._open()
        with system.open_input_stream(posixpath.join(root, f"poll={poll}", name), compression=None) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\n")
                yield from whole
            yield rest


# ---------------------------------------------------------------- answers to rows


def _text(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _usable(kind: str, answer: Any) -> list | None:
    """The rows' objects of an answer, or None where it is an error: trips without a list, a trip without stops, no stop list."""
    if not isinstance(answer, dict):
        return None
    if kind == "stops":
        return answer["Haltestellen"] if isinstance(answer.get("Haltestellen"), list) else None
    trip = answer.get("Fahrt")
    if not isinstance(trip, dict):
        return None
    if kind == "trips":
        return [{"Produkt": trip.get("Produkt")} | one for one in trip["Fahrten"] if isinstance(one, dict)] if isinstance(trip.get("Fahrten"), list) else None
    return [trip] if isinstance(trip.get("Fahrtverlauf"), list) and trip["Fahrtverlauf"] else None


def _row(values: dict, kinds: StructType) -> dict:
    """A JSON object under a schema; what does not fit is null."""
    out = {}
    for field in kinds:
        value, name = values.get(field.name), field.dataType.simpleString()
        if name.startswith("array<struct"):
            out[field.name] = [_row(one, field.dataType.elementType) for one in value if isinstance(one, dict)] if isinstance(value, list) else None
        elif name == "string":
            out[field.name] = _text(value)
        elif name == "boolean":
            out[field.name] = value if isinstance(value, bool) else None
        else:
            out[field.name] = _parsed(value, name)
    return out


def _parsed(value: Any, kind: str) -> Any:
    try:
        if kind == "date":
            return pa.scalar(value, pa.string()).cast(pa.date32()).as_py()
        number = float(value) if kind == "double" else int(value)
        return number if kind == "double" or abs(number) < 1 << (31 if kind == "int" else 63) else None
    except (TypeError, ValueError, OverflowError, pa.ArrowException):
        return None


def _error(answer: Any) -> dict:
    """Code and message of an answer without content; 500 where it has no code."""
    answer = answer if isinstance(answer, dict) else {}
    code = _parsed(answer.get("code") or answer.get("statusCode") or 500, "int")
    return {"code": 500 if code is None else code, "message": _text(answer.get("message") or answer.get("error"))}


def rows_of(kind: str, poll: int, lines: Iterator[bytes], schema: StructType, errors: bool = False) -> Iterator[dict]:
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = json.loads(line)
        except ValueError:
            answer = {"message": "not JSON"}
        found = _usable(kind, answer)
        if errors:
            if found is None:
                yield {"poll": poll, "kind": kind, **_error(answer)}
        else:
            for one in found or ():
                if kind in ("trips", "trip"):  # the upstream spells it in two ways
                    one = one | {"Besetzgrad": one.get("Besetzgrad", one.get("Besetztgrad"))}
                yield _row(one | {"poll": poll}, schema)


# ---------------------------------------------------------------- the data source


class File(InputPartition):
    def __init__(self, kind: str, poll: int, name: str) -> None:
        self.kind, self.poll, self.name = kind, poll, name


class _Reading:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.rows_schema = options, schema
        kind = options["kind"]
        self.folders = [Polls(options["path"], k) for k in (KINDS if kind == "errors" else (kind,))]

    def polls(self) -> list[int]:
        return sorted({p for f in self.folders for p in f.known()})

    def between(self, low: int, high: int) -> list[File]:
        """The files of the polls low < poll <= high."""
        return [File(f.kind, p, name) for f in self.folders for p in f.known() if low < p <= high for name in f.files(p)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no files
            return
        schema, held = to_arrow_schema(self.rows_schema), []
        lines = Polls(self.options["path"], partition.kind).lines(partition.poll, partition.name)
        for row in rows_of(partition.kind, partition.poll, lines, self.rows_schema, self.options["kind"] == "errors"):
            held.append(row)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class BatchReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.between(int(self.options.get("frompoll", 0)) - 1, int(self.options.get("topoll", 1 << 62)))


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"poll": -1}

    def latestOffset(self) -> dict:
        return {"poll": max(self.polls(), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.between(start["poll"], end["poll"])

    def commit(self, end: dict) -> None:
        pass  # answers stay where they are


class Upstream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "upstream"

    def schema(self) -> str:
        kind = self.options.get("kind")
        if kind not in SCHEMAS or "path" not in self.options:
            raise ValueError(f"upstream needs a path and a kind out of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return StreamReader(dict(self.options), schema)


def reader(spark, path: str, kind: str, stream: bool = False, **options: object) -> DataFrame:
    """Answers of a kind as a table or a stream."""
    spark.dataSource.register(Upstream)
    start = (spark.readStream if stream else spark.read).format("upstream").option("path", path).option("kind", kind)
    for name, value in options.items():
        start = start.option(name, value)
    return start.load()


def keep(answers: DataFrame, path: str, kind: str) -> None:
    """Adds ``answers(poll, answer)``, JSON texts, to the folder of a kind."""
    answers.select("poll", F.col("answer").alias("value")).write.mode("append").partitionBy("poll").format("text").option("lineSep", "\n").save(f"{path}/{kind}")
