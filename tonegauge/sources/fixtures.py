"""Fixture rows in fenced JSON blocks or JSON lines, as a data source of Spark that checks what it writes.

Rows are JSON objects, one a line, and arrive in order of their ids: each task sees to it that no id of its own comes
twice, reads its file again when it is written, and tells the driver in one message how many rows it has, how many of
each family, and its first and last id. The commit holds these against each other and against what was asked for; only
then it writes ``manifest.json``, which readers go by, so files of failed or repeated attempts are never read. The
driver gets a message a file; no ids and no rows.

Defined results: a null, missing or repeated id, a family that isn't named, a count that differs, or a file that reads
otherwise than it was written fails the write, which leaves no manifest and removes its files. Ids are compared as text.
Null fields are left out and come back as null. An empty table is a manifest without files.
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"
#: Characters of rows that a reader hands on at a time.
_BATCH = 1 << 20
_ROW = pa.schema([("row", pa.string())])
FORMS = {"blocks": "md", "lines": "jsonl"}


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def _rows(path: str, name: str, form: str, title: str) -> Iterator[str]:
    """The JSON objects of a file: its lines, or those of the fenced block after the header."""
    fs, at = _system(path)
    with fs.open_input_stream(f"{at}/{name}") as source, io.TextIOWrapper(source, encoding="utf-8", newline="\n") as lines:
        place = "row" if form == "lines" else "before"
        for line in lines:
            text = line.removesuffix("\n")
            if form == "lines":
                yield text
            elif place == "before":
                place = "header" if text == f"## {title}" else place
            elif place == "header":
                place = "row" if text == "```json" else place
            elif text == "```":
                return
            elif text not in ("[", "]"):
                yield text.removesuffix(",")


def _digest(rows: Iterator[str]) -> tuple[int, int]:
    count = total = 0
    for row in rows:
        count, total = count + 1, total + zlib.crc32(row.encode())
    return count, total


@dataclass
class Written(WriterCommitMessage):
    """What a task has to say about its file; name is None where it had no rows."""

    name: str | None = None
    rows: int = 0
    first: str = ""
    last: str = ""
    families: dict = field(default_factory=dict)
    faults: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.form, self.title = options["path"], options.get("form", "blocks"), options.get("title", "Rows")
        self.expected = int(options["expected"]) if "expected" in options else None
        self.families = json.loads(options["families"]) if "families" in options else None
        if self.form not in FORMS:
            raise ValueError(f"form is one of {', '.join(FORMS)}")
        fs, at = _system(self.path)
        if fs.get_file_info(f"{at}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} holds fixture rows already")
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        said, families, digest, out = Written(), Counter(), 0, None
        fs, at = _system(self.path)
        try:
            for batch in iterator:
                for key, family, row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    if out is None:
                        task = TaskContext.get()
                        said.name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.{FORMS[self.form]}"
                        out = fs.open_output_stream(f"{at}/{said.name}")
                        if self.form == "blocks":
                            out.write(f"## {self.title}\n\n```json\n[\n".encode())
                        said.first = key or ""
                    elif self.form == "blocks":
                        out.write(b",\n")
                    out.write(row.encode())
                    if self.form == "lines":
                        out.write(b"\n")
                    # one fault of each kind is enough to fail
                    if key is None:
                        said.faults = said.faults or ["a row has no id"]
                    elif said.rows and key <= said.last:
                        said.faults = said.faults or [f"id {key!r} comes twice"]
                    if self.families is not None and family not in self.families:
                        said.faults = said.faults or [f"id {key!r} is of family {family!r}"]
                    elif family is not None and self.families is not None:
                        families[family] += 1
                    said.rows, said.last, digest = said.rows + 1, key or "", digest + zlib.crc32(row.encode())
            if out is not None and self.form == "blocks":
                out.write(b"\n]\n```\n")
        finally:
            if out is not None:
                out.close()
        said.families = dict(families)
        if said.name and _digest(_rows(self.path, said.name, self.form, self.title)) != (said.rows, digest):
            said.faults = said.faults or [f"{said.name} reads otherwise than it was written"]
        return said

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.name), key=lambda m: m.first)
        faults = [f for m in parts for f in m.faults]
        faults += [f"id {b.first!r} comes twice" for a, b in zip(parts, parts[1:], strict=False) if b.first <= a.last]
        rows, families = sum(m.rows for m in parts), Counter()
        for m in parts:
            families.update(m.families)
        if self.expected is not None and rows != self.expected:
            faults.append(f"{rows} rows instead of {self.expected}")
        for name, n in (self.families or {}).items():
            if n is not None and families[name] != n:
                faults.append(f"{families[name]} rows of family {name!r} instead of {n}")
        if faults:
            self._remove(messages)
            raise ValueError("; ".join(faults[:10]))
        fs, at = _system(self.path)
        with fs.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(json.dumps({"form": self.form, "title": self.title, "rows": rows, "families": dict(families), "files": [{"name": m.name, "rows": m.rows} for m in parts]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._remove(messages)

    def _remove(self, messages: list[Written | None]) -> None:
        fs, at = _system(self.path)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{at}/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{at}/{m.name}")


def manifest(path: str) -> dict:
    fs, at = _system(path)
    with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Part(InputPartition):
    name: str
    form: str
    title: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        known = manifest(self.path)
        return [Part(f["name"], known["form"], known["title"]) for f in known["files"]]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no file
            return
        held, size = [], 0
        for row in _rows(self.path, partition.name, partition.form, partition.title):
            held.append(row)
            size += len(row)
            if size >= _BATCH:
                yield pa.record_batch([pa.array(held, pa.string())], schema=_ROW)
                held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(held, pa.string())], schema=_ROW)


class FixtureRows(DataSource):
    """``spark.read.format("fixture_rows").load(path)``: row (JSON text); written from id, family, row in order of id."""

    @classmethod
    def name(cls) -> str:
        return "fixture_rows"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session with the data source; Python workers get this package's folder, where it is installed by path only."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.dataSource.register(FixtureRows)
    return spark


def write(rows: DataFrame, path: str, key: str = "id", family: str | None = None, form: str = "blocks", title: str = "Rows", expected: int | None = None, families: dict[str, int | None] | None = None) -> None:
    """Write all columns of rows. expected: how many there must be; families: those that there may be, each with how many
    rows it must have, or None."""
    registered(rows.sparkSession)
    options = {"form": form, "title": title} | ({} if expected is None else {"expected": str(expected)}) | ({} if families is None else {"families": json.dumps(families)})
    of = F.lit(None) if family is None else F.col(family)
    d = rows.select(F.col(key).cast("string").alias("id"), of.cast("string").alias("family"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))
    d.repartitionByRange("id").sortWithinPartitions("id").write.format("fixture_rows").options(**options).mode("append").save(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return registered(spark).read.format("fixture_rows").load(path).select(F.from_json("row", schema).alias("r")).select("r.*")
