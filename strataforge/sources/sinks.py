"""Sinks of our own: a file a document, and an export with its counts, each committed as a whole.

Tasks write their files into folders of their own. The commit writes one manifest that names the folders and their counts, under a
temporary name first; readers follow the manifest, so a task's files are there with all others' or not at all. An abort deletes
the folders. Paths may be on any file system that Arrow knows by its URI.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_manifest.json"
READ_BYTES = 4 << 20  # of lines in a batch


@dataclass
class Part(WriterCommitMessage):
    folder: str
    first: list  # of the order, to number parts by
    rows: int = 0
    counts: dict[str, dict[str, int]] = field(default_factory=dict)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns

    def _open(self):
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Part:
        place, base = self._open()
        part = Part(f"part-{uuid.uuid4().hex}", [])
        place.create_dir(f"{base}/{part.folder}", recursive=True)
        try:
            self.fill(iterator, place, f"{base}/{part.folder}", part)
        except BaseException:  # a failed attempt leaves nothing
            place.delete_dir(f"{base}/{part.folder}")
            raise
        return part

    def commit(self, messages: list[Part | None]) -> None:
        place, base = self._open()
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first)
        for m in messages:
            if m is not None and not m.rows:
                place.delete_dir(f"{base}/{m.folder}")
        total: dict[str, Counter] = {}
        for m in parts:
            for name, counts in m.counts.items():
                total.setdefault(name, Counter()).update(counts)
        manifest = {"rows": sum(m.rows for m in parts), "parts": [{"folder": m.folder, "rows": m.rows} for m in parts], "counts": {k: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))) for k, v in total.items()}}
        with place.open_output_stream(f"{base}/{MANIFEST}.new") as out:
            out.write(json.dumps(manifest, ensure_ascii=False, indent=1).encode())
        place.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        place, base = self._open()
        for m in messages:
            if m is not None:
                place.delete_dir(f"{base}/{m.folder}")


class _FileADocument(_Writer):
    """JSON lines, a file for each run of rows with one key: rows must come sorted by it."""

    def __init__(self, path: str, columns: list[str], key: str):
        super().__init__(path, columns)
        self.key = key

    def fill(self, rows, place, folder, part) -> None:
        now, out = None, None
        for row in rows:
            if out is None or row[self.key] != now:
                if out is not None:
                    out.close()
                now = row[self.key]
                out = place.open_output_stream(f"{folder}/{now}.jsonl")
            out.write((json.dumps(row.asDict(), ensure_ascii=False) + "\n").encode())
            part.rows += 1
            part.first = part.first or [str(now)]
        if out is not None:
            out.close()


class _Export(_Writer):
    """A CSV and a JSON-lines file a task, rows in the order given, with counts by some columns."""

    def __init__(self, path: str, columns: list[str], counted: list[str]):
        super().__init__(path, columns)
        self.counted = counted

    def fill(self, rows, place, folder, part) -> None:
        counts = {c: Counter() for c in self.counted}
        with place.open_output_stream(f"{folder}/rows.csv") as table, place.open_output_stream(f"{folder}/rows.jsonl") as lines:
            for row in rows:
                values = [row[c] for c in self.columns]
                text = io.StringIO()
                csv.writer(text, lineterminator="\n").writerow(values)
                table.write(text.getvalue().encode())
                lines.write((json.dumps(dict(zip(self.columns, values)), ensure_ascii=False) + "\n").encode())
                part.rows += 1
                part.first = part.first or values
                for c in self.counted:
                    counts[c][str(row[c])] += 1
        part.counts = {c: dict(n) for c, n in counts.items()}


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strataforge_document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileADocument(self.options["path"], schema.names, self.options["key"])


class SortedExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strataforge_sorted_export"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Export(self.options["path"], schema.names, self.options["counted"].split(","))


def write_document_files(rows: DataFrame, path: str, key: str) -> None:
    """A file for each key with its rows as JSON lines, all of them or none; rows with a null key are left out."""
    rows.sparkSession.dataSource.register(DocumentFiles)
    sorted_ = rows.filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key)
    sorted_.write.format("strataforge_document_files").option("path", path).option("key", key).mode("append").save()


def write_export(rows: DataFrame, path: str, order: list[str], counted: list[str]) -> None:
    """CSV and JSON lines over range partitions of ``order``, and the counts by some columns in the same commit. ``order`` are the first columns."""
    rows.sparkSession.dataSource.register(SortedExport)
    columns = [*order, *(c for c in rows.columns if c not in order)]
    ranged = rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.format("strataforge_sorted_export").option("path", path).option("counted", ",".join(counted)).mode("append").save()


def manifest(path: str) -> dict:
    place, base = fs.FileSystem.from_uri(path.rstrip("/"))
    with place.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed JSON lines of a sink, with ``before``, the number of rows in parts before theirs.

    A task lists and reads the files of its parts, so names of files never come to the driver, however many there are.
    """
    parts, before, numbered = manifest(path)["parts"], 0, []
    for p in parts:
        numbered.append((p["folder"], before))
        before += p["rows"]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("before", F.lit(0).cast("long"))
    base = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for folder, before in zip(batch.column("folder").to_pylist(), batch.column("before").to_pylist()):
                lines: list[bytes] = []
                size = 0
                for file in place.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                    if not file.path.endswith(".jsonl"):
                        continue
                    with place.open_input_stream(file.path) as f:
                        for line in io.BufferedReader(f, READ_BYTES):
                            lines.append(line)
                            size += len(line)
                            if size > READ_BYTES:
                                yield _lines(lines, before)
                                lines, size = [], 0
                if lines:
                    yield _lines(lines, before)

    at = spark.createDataFrame(numbered, "folder string, before long").repartition(len(numbered))
    return at.mapInArrow(run, "line string, before long").select(F.from_json("line", schema).alias("row"), "before").select("row.*", "before")


def _lines(lines: list[bytes], before: int) -> pa.RecordBatch:
    text = pa.array(lines, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([text, pa.array([before] * len(lines), pa.int64())], ["line", "before"])
