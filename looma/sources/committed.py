"""A sink whose output appears with one last write: part files first, then a manifest that names them.

Tasks write part files below `_parts` under names of their own; the driver's commit writes `_manifest.json` when all tasks have ended, and read_committed()
reads what the manifest names and nothing else. A write that is killed, retried or run twice at once leaves parts without a name, so a reader
sees what was there before, or an error if nothing was. kind: parquet, csv (with a header) or json (lines).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tablefiles import plain

MANIFEST = "_manifest.json"
KINDS = ("parquet", "csv", "json")


def _store(path: str):
    return pafs.FileSystem.from_uri(plain(path))


def read_manifest(path: str) -> dict | None:
    """The manifest of a sink; null where nothing has been committed."""
    fs, base = _store(path)
    try:
        with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    size: int
    sha256: str


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.kind, self.schema, self.overwrite, self.run = options["path"], options.get("kind", "parquet"), schema.json(), overwrite, uuid.uuid4().hex
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One task's rows as one file; another attempt of the task writes another file."""
        fs, base = _store(self.path)
        name = f"_parts/{self.run}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{self.kind}"
        fs.create_dir(f"{base}/_parts/{self.run}", recursive=True)
        rows, out = 0, None
        with fs.open_output_stream(f"{base}/{name}") as f:
            for batch in iterator:
                rows += batch.num_rows
                if self.kind == "json":
                    f.write("".join(json.dumps(r, default=str) + "\n" for r in batch.to_pylist()).encode())
                else:
                    out = out or (pq.ParquetWriter(f, batch.schema) if self.kind == "parquet" else pc.CSVWriter(f, batch.schema))
                    out.write_batch(batch)
            if out:
                out.close()
        digest, size = hashlib.sha256(), 0
        with fs.open_input_stream(f"{base}/{name}") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
                size += len(piece)
        return Part(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        fs, base = _store(self.path)
        before = None if self.overwrite else read_manifest(self.path)
        parts = [{"name": m.name, "rows": m.rows, "size": m.size, "sha256": m.sha256} for m in messages if m is not None and m.rows]
        document = {"version": 1, "kind": self.kind, "schema": json.loads(self.schema), "parts": (before["parts"] if before else []) + parts}
        if before and (before["kind"], before["schema"]) != (document["kind"], document["schema"]):
            raise ValueError("what is appended has another kind or schema")
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFEST}.{self.run}") as f:
            f.write(json.dumps(document).encode())
        fs.move(f"{base}/{MANIFEST}.{self.run}", f"{base}/{MANIFEST}")  # the one write by which output appears

    def abort(self, messages: list[Part | None]) -> None:
        fs, base = _store(self.path)
        fs.delete_dir_contents(f"{base}/_parts/{self.run}", missing_dir_ok=True)


class CommittedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter({**self.options}, schema, overwrite)


def write_committed(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(CommittedFiles)
    df.write.format("committed_files").option("kind", kind).mode(mode).save(path)


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the parts that the manifest names."""
    found = read_manifest(path)
    if found is None:
        raise FileNotFoundError(f"nothing has been committed to {path}")
    schema = StructType.fromJson(found["schema"])
    names = [f"{path.rstrip('/')}/{p['name']}" for p in found["parts"]]
    if not names:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if found["kind"] == "parquet":
        return reader.parquet(*names)
    return reader.json(names) if found["kind"] == "json" else reader.option("header", True).csv(names)
