"""Collections of table files: discovery, decoding to cells, their last columns, and routing by label."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILES = "path string, modificationTime timestamp, length long, content binary"


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """path, length, content of every Parquet file under root. Reading goes through Spark, so any store will do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def read_tables(spark: SparkSession, root: str, errors: str = "skip") -> DataFrame:
    """path, num_rows, num_cols, bytes (Arrow IPC), error of every file; unreadable ones are skipped or raise."""
    files = list_files(spark, root)
    if files.limit(1).count() == 0:
        raise ValueError(f"no Parquet file under {root}")
    decoded = files.select("path", "content").mapInArrow(_decode, "path string, num_rows long, num_cols long, table_bytes binary, error string")
    if errors == "raise":
        return decoded.withColumn("error", F.when(F.col("error").isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")))
    return decoded


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                t = pq.read_table(io.BytesIO(content))
                row = [path, t.num_rows, t.num_columns, to_blob(t), None]
            except Exception as e:  # any broken file: the message goes to the error column
                row = [path, None, None, None, str(e)[:200]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "num_rows", "num_cols", "table_bytes", "error"])


def to_blob(t: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    return sink.getvalue()


def encode_tables(rows: DataFrame, keys: str = "table_id") -> DataFrame:
    """rows of many small tables -> table_id, num_rows, num_cols, table_bytes (Arrow IPC of the other columns); a table must fit
    into a task's memory."""

    def one(t: pa.Table) -> pa.Table:
        own = t.drop_columns([keys])
        return pa.table({"table_id": t.column(keys)[:1].cast(pa.string()), "num_rows": [t.num_rows], "num_cols": [own.num_columns], "table_bytes": pa.array([to_blob(own)], pa.binary())})

    return rows.groupBy(keys).applyInArrow(one, "table_id string, num_rows long, num_cols long, table_bytes binary")


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


CELLS = "table_id string, row_idx long, col_idx int, col_name string, kind string, num double, txt string, ts timestamp"


def _kind_of(t: pa.DataType) -> str | None:
    if pa.types.is_integer(t) or pa.types.is_floating(t):
        return "number"
    if pa.types.is_date(t) or pa.types.is_timestamp(t):
        return "date"
    return None if pa.types.is_binary(t) or pa.types.is_large_binary(t) else "text"


def _cells(table_id: str, at: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
    """The cells of a part of a table whose first row has the number at."""
    numbers = pa.array(np.arange(at, at + part.num_rows), pa.int64())
    for i, f in enumerate(part.schema):
        kind = _kind_of(f.type)
        if kind is None:
            continue
        n, c = part.num_rows, part.column(i)
        num = c.cast(pa.float64()) if kind == "number" else pa.nulls(n, pa.float64())
        txt = pa.nulls(n, pa.string()) if kind != "text" else c.cast(pa.string()) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) else pa.array([None if v is None else str(v) for v in c.to_pylist()], pa.string())
        ts = c.cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")) if kind == "date" else pa.nulls(n, pa.timestamp("us", "UTC"))
        one = lambda v, k: pa.repeat(pa.scalar(v, k), n)  # noqa: B023, E731
        whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        yield pa.RecordBatch.from_arrays([one(table_id, pa.string()), numbers, one(i, pa.int32()), one(f.name, pa.string()), one(kind, pa.string()), whole(num), whole(txt), whole(ts)], names=["table_id", "row_idx", "col_idx", "col_name", "kind", "num", "txt", "ts"])


def blobs_to_cells(tables: DataFrame, rows: int = 20_000) -> DataFrame:
    """tables (table_id, table_bytes) -> cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = from_blob(blob)
                for at in range(0, t.num_rows, rows):
                    yield from _cells(table_id, at, t.slice(at, rows))

    return tables.select("table_id", "table_bytes").mapInArrow(run, CELLS)


def files_to_cells(files: DataFrame, rows: int = 20_000) -> DataFrame:
    """files (table_id, content) -> cells with error, for stores whose byte ranges tasks cannot read. An unreadable file gives one
    row with its error; row groups are decoded once, and kept until the last one is through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_fields(CELLS + ", error string")
        for batch in batches:
            for table_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    f = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                    groups = [f.read_row_group(g, use_threads=False) for g in range(f.num_row_groups)]
                except Exception as e:  # any broken file
                    row = {"table_id": table_id, "error": f"footer: {e}"[:200]}
                    yield pa.RecordBatch.from_arrays([pa.array([row.get(k.name)], k.type) for k in fields], schema=pa.schema(fields))
                    continue
                at = 0
                for part in (b for g in groups for b in g.to_batches(rows)):
                    for cells in _cells(table_id, at, pa.Table.from_batches([part])):
                        yield pa.RecordBatch.from_arrays([*cells.columns, pa.nulls(cells.num_rows, pa.string())], names=[*cells.schema.names, "error"])
                    at += part.num_rows

    return files.select("table_id", "content").mapInArrow(run, CELLS + ", error string")


LAST = "path string, column_name string, kind string, value string, n long, error string"


def arrow_fields(schema: str) -> list[pa.Field]:
    """The Arrow fields of one of the schemas above."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC"), "boolean": pa.bool_(), "binary": pa.binary()}
    return [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(","))]


def last_kind(t: pa.DataType) -> str:
    return "boolean" if pa.types.is_boolean(t) else "other" if pa.types.is_time(t) or pa.types.is_duration(t) else _kind_of(t) or "text"


def value_counts(path: str, field: pa.Field, c: pa.Array) -> list[list]:
    """Rows of LAST: the values of a part of a column as texts and how often each occurs."""
    kind = last_kind(field.type)
    text = pa.array([None if v is None else str(v) for v in c.to_pylist()], pa.string()) if kind in ("text", "boolean", "other") else c.cast(pa.string())
    return [[path, field.name, kind, pair["values"], pair["counts"], None] for pair in text.value_counts().to_pylist()]


def last_column_values(files: DataFrame, rows: int = 20_000) -> DataFrame:
    """files (path, content) -> of each file's last column the values as texts and how often a batch of rows holds them; a file
    without rows gives one line with n 0, an unreadable one its error. Only the last column is decoded."""

    def one(path: str, content: pa.Scalar) -> Iterator[list]:
        try:
            f = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
            field = f.schema_arrow[-1]
            yield [path, field.name, last_kind(field.type), None, 0, None]
            for part in f.iter_batches(rows, columns=[field.name]):
                yield from value_counts(path, field, part.column(0))
        except Exception as e:  # any broken file
            yield [path, None, None, None, 0, str(e)[:200]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = arrow_fields(LAST)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = list(one(path, content))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    return files.select("path", "content").mapInArrow(run, LAST)


def write_files(files: DataFrame, root: str) -> None:
    """files (name, content) written below root, each as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                fs, base = pafs.FileSystem.from_uri(re.sub(r"^file:(//)?(?=/)", "", root))
                fs.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_last_column(spark: SparkSession, path: str) -> DataFrame:
    """Only the last column; the scan reads no other."""
    df = spark.read.parquet(path)
    return df.select(df.columns[-1])


def source_group(path: Column, root: str) -> tuple[Column, Column]:
    """(group, path below root): the first directory below root, or the file's stem where it lies in root itself."""
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    stem = F.regexp_replace(below, r"\.[^.]*$", "")
    return F.when(F.instr(below, "/") > 0, F.substring_index(below, "/", 1)).otherwise(stem), below


def destination(label: Column, group: Column) -> Column:
    return F.when(label == "unknown", F.concat(F.lit("unknown/"), group)).otherwise(F.concat_ws("-", group, label))


def write_routed(results: DataFrame, out: str) -> None:
    """Instead of copying files: data partitioned by destination."""
    results.write.mode("overwrite").partitionBy("destination").parquet(out)


def sample_tables(files: DataFrame, limit_chunks: int, per_chunk: int, n_chunks: int) -> DataFrame:
    """files (chunk, path): every k-th chunk, the first files of each."""
    step = max(1, n_chunks // limit_chunks)
    chunks = files.select("chunk").distinct().withColumn("i", F.row_number().over(W.orderBy("chunk")) - 1)
    kept = chunks.where((F.col("i") % step == 0) & (F.col("i") / step < limit_chunks)).select("chunk")
    rn = F.row_number().over(W.partitionBy("chunk").orderBy("path"))
    return files.join(F.broadcast(kept), "chunk", "left_semi").withColumn("rn", rn).where(F.col("rn") <= per_chunk).drop("rn")
