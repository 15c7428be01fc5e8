"""A Spark data source for collections of Parquet files with different schemas.

Spark's own reader wants one schema, so a collection of a million tables would be a million scans. This source plans from the
files' footers: a partition is a list of ranges of row groups of about `target_mb` of the columns asked for, so small files share a task
and big ones are split. Only the byte ranges of these columns are read. A file that cannot be read gives a row with the reason
instead of cells: of one range, at once or not at all; of several ranges, the others still come, and quarantine() takes them back.

Formats (option `what`): 'cells', every cell of every table, 'blobs', its rows as Arrow blobs of some megabytes each, and 'last', how often values of the
last column occur. Rows are decoded as a stream; only a file that counts as small and has one range is held. Stores that
pyarrow does not know are read by collection.list_files() instead, whole files through Spark; read_cells() and last_values() choose.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import collection
from .scratch import scratch_folder, written

ROWS, TARGET_MB, OPEN_MB, READERS = 20_000, 16, 1, 16
#: Decoded MB of a file that is held whole, of a blob, and of a batch of rows.
HELD_MB, BLOB_MB, BATCH_MB = 64, 8, 16
READ = collection.CELLS + ", error string"
#: first_row, num_rows: the rows of a blob; table_rows: those of its file; size: bytes of the blob.
BLOBS = "path string, first_row long, num_rows long, num_cols long, table_rows long, size long, table_bytes binary, error string"
SCHEMAS = {"cells": (READ, "table_id"), "last": (collection.LAST, "path"), "blobs": (BLOBS, "path")}


def plain(root: str) -> str:
    """A local path without its scheme; any other location as it is."""
    return re.sub(r"^file:(//)?(?=/)", "", root.rstrip("/"))


def table_path(path: Column) -> Column:
    """The table that a file belongs to: the folder named *.parquet that it lies in, as Spark writes a table, or itself."""
    found = F.regexp_extract(path, r"^(.*?[^/]\.parquet)(/|$)", 1)
    return F.when(found == "", path).otherwise(found)


def reachable(root: str) -> bool:
    """Whether tasks can read byte ranges of this store."""
    try:
        pafs.FileSystem.from_uri(plain(root))
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


@dataclass
class Piece:
    """Row groups [first, stop) of a file, the number of its first row, and whether it is all of the file; or why there is none."""

    path: str
    first: int = 0
    stop: int = 0
    row: int = 0
    whole: bool = True
    error: str | None = None


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


class TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern, self.what = options["path"].rstrip("/"), options.get("pattern", "*.parquet"), options.get("what", "cells")
        self.target = float(options.get("target_mb", TARGET_MB)) * 2**20

    def files(self) -> list[str]:
        """Paths below the root, in order; hidden files and folders are left out, as Spark does."""
        fs, base = pafs.FileSystem.from_uri(plain(self.root))
        found = [fs.get_file_info(base)]
        if found[0].type == pafs.FileType.Directory:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        below = [(f.path[len(base) :], f.base_name) for f in found if f.type == pafs.FileType.File]
        return sorted(p for p, name in below if fnmatch.fnmatch(name, self.pattern) and not any(x[:1] in "._" for x in p.strip("/").split("/") if x))

    def open(self, below: str):
        fs, base = pafs.FileSystem.from_uri(plain(self.root))
        return pq.ParquetFile(fs.open_input_file(base + below))

    def plan(self, below: str) -> list[tuple[float, Piece]]:
        """(bytes to read, piece) of a file."""
        try:
            meta = self.open(below).metadata
            last = meta.row_group(0).column(meta.row_group(0).num_columns - 1).path_in_schema.split(".")[0] if meta.num_row_groups and meta.num_columns else None
            out, held, first, row, start, wide = [], 0.0, 0, 0, 0, 0
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                held += sum(c.total_compressed_size for c in map(group.column, range(group.num_columns)) if self.what != "last" or c.path_in_schema.split(".")[0] == last)
                row += group.num_rows
                wide += max(group.total_byte_size, 8 * group.num_rows * group.num_columns)  # bytes when decoded, about
                if held >= self.target or wide >= HELD_MB * 2**20 or g + 1 == meta.num_row_groups:
                    out.append((held, Piece(below, first, g + 1, start, first == 0 and g + 1 == meta.num_row_groups and wide <= HELD_MB * 2**20)))
                    held, first, start, wide = 0.0, g + 1, row, 0
            return out or [(0.0, Piece(below))]
        except Exception as e:  # any broken file: its message is the result
            return [(0.0, Piece(below, error=f"footer: {e}"[:200]))]

    def partitions(self) -> list[Pieces]:
        with ThreadPoolExecutor(READERS) as pool:
            planned = [p for pieces in pool.map(self.plan, self.files()) for p in pieces]
        out, held = [], 0.0
        for size, piece in planned:
            if not out or held + size > self.target:
                out.append([])
                held = 0.0
            out[-1].append(piece)
            held += size + OPEN_MB * 2**20
        return [Pieces(p) for p in out] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            name = self.root + piece.path
            try:
                if piece.error:
                    raise ValueError(piece.error)
                batches = {"cells": self.cells, "last": self.last, "blobs": self.blobs}[self.what](name, piece)
                # a small file of one range comes whole or not at all: it is read, not kept as cells, before the first of them goes on
                yield from batches
            except Exception as e:  # any broken file
                reason = str(e) if str(e).startswith("footer: ") else f"rows: {e}"
                columns = SCHEMAS[self.what]
                fields = collection.arrow_fields(columns[0])
                row = {columns[1]: name, "error": reason[:200], "n": 0}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in fields], schema=pa.schema(fields))

    def parts(self, file: pq.ParquetFile, piece: Piece, columns: list[str] | None) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(number of the first row, rows) of a piece; one that is all of its file is decoded before any of it is given."""
        meta = file.metadata
        held = sum(meta.row_group(g).total_byte_size for g in range(piece.first, piece.stop))
        n = sum(meta.row_group(g).num_rows for g in range(piece.first, piece.stop))
        rows = max(1, min(ROWS, BATCH_MB * 2**20 * n // max(held, 1)))
        batches = file.iter_batches(rows, row_groups=list(range(piece.first, piece.stop)), columns=columns, use_threads=False) if n else ()
        row = piece.row
        for batch in list(batches) if piece.whole else batches:
            yield row, batch
            row += batch.num_rows

    def cells(self, name: str, piece: Piece) -> Iterator[pa.RecordBatch]:
        for row, part in self.parts(self.open(piece.path), piece, None):
            for cells in collection._cells(name, row, pa.Table.from_batches([part])):
                yield pa.RecordBatch.from_arrays([*cells.columns, pa.nulls(cells.num_rows, pa.string())], names=[*cells.schema.names, "error"])

    def blobs(self, name: str, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The rows of a piece as blobs; a file without rows gives one without."""
        file = self.open(piece.path)
        fields, empty = collection.arrow_fields(BLOBS), file.metadata.num_rows == 0

        def one(first: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held, file.schema_arrow)
            blob = collection.to_blob(t)
            row = {"path": name, "first_row": first, "num_rows": t.num_rows, "num_cols": t.num_columns, "table_rows": file.metadata.num_rows, "size": len(blob), "table_bytes": blob}
            return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in fields], schema=pa.schema(fields))

        held, first = [], piece.row
        for row, part in self.parts(file, piece, None):
            held.append(part)
            if sum(b.nbytes for b in held) >= BLOB_MB * 2**20:
                yield one(first, held)
                held, first = [], row + part.num_rows
        if held or empty:
            yield one(first, held)

    def last(self, name: str, piece: Piece) -> Iterator[pa.RecordBatch]:
        file = self.open(piece.path)
        field = file.schema_arrow[-1]
        rows = [[name, field.name, collection.last_kind(field.type), None, 0, None]]
        for _, part in self.parts(file, piece, [field.name]):
            rows += collection.value_counts(name, field, part.column(0))
        fields = collection.arrow_fields(collection.LAST)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


class TableFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "table_files"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "cells")][0]

    def reader(self, schema) -> TableReader:
        return TableReader({**self.options})


def _load(spark: SparkSession, root: str, what: str, pattern: str, target_mb: float) -> DataFrame:
    spark.dataSource.register(TableFiles)
    return spark.read.format("table_files").option("what", what).option("pattern", pattern).option("target_mb", str(target_mb)).load(root)


def read_cells(spark: SparkSession, root: str, pattern: str = "*.parquet", target_mb: float = TARGET_MB) -> DataFrame:
    """The cells of every table below root (table_id: its path) with error null, and a row with error for each range that cannot be read."""
    if reachable(root):
        return _load(spark, root, "cells", pattern, target_mb)
    return collection.files_to_cells(collection.list_files(spark, root, pattern).select(F.col("path").alias("table_id"), "content"))


def last_values(spark: SparkSession, root: str, pattern: str = "*.parquet", target_mb: float = TARGET_MB) -> DataFrame:
    """path, column_name, kind, value, n, error: collection.last_column_values() of the files below root, without the other columns' bytes."""
    if reachable(root):
        return _load(spark, root, "last", pattern, target_mb)
    return collection.last_column_values(collection.list_files(spark, root, pattern))


def read_blobs(spark: SparkSession, root: str, pattern: str = "*.parquet", target_mb: float = TARGET_MB) -> DataFrame:
    """BLOBS of the files below root: a table in parts of some megabytes, however large it is; error rows as in read_cells()."""
    if reachable(root):
        return _load(spark, root, "blobs", pattern, target_mb)
    return read_files(collection.list_files(spark, root, pattern).select("path", "content"), "blobs")


class _Held(TableReader):
    """A file whose bytes are there."""

    def __init__(self, path: str, content: pa.Scalar, what: str):
        super().__init__({"path": path, "what": what})
        self.content = content

    def open(self, below: str):
        return pq.ParquetFile(pa.BufferReader(self.content.as_buffer()))


PIECES = "path string, first int, stop int, row long, whole boolean, error string"


def read_files(files: DataFrame, what: str = "cells") -> DataFrame:
    """files (path, and content where tasks cannot read the store) -> what the source gives of them. Tasks read their footers, and their ranges are dealt out anew."""
    held = "content" in files.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = _Held(path, content, what)
                yield from reader.read(Pieces([piece for _, piece in reader.plan("")]))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = collection.arrow_fields(PIECES)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [[path, p.first, p.stop, p.row, p.whole, p.error] for _, p in TableReader({"path": path, "what": what}).plan("")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                path = r.pop("path")
                yield from TableReader({"path": path, "what": what}).read(Pieces([Piece("", **r)]))

    if held:
        return files.select("path", "content").mapInArrow(whole, SCHEMAS[what][0])
    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path").mapInArrow(plan, PIECES).repartition(parts).mapInArrow(ranges, SCHEMAS[what][0])


def copy_files(spark: SparkSession, files: DataFrame, source: str, root: str) -> None:
    """files (path below source, name, keep) written below root: the first `keep` bytes of each, as a stream. Where tasks cannot read the store, whole files come through Spark."""
    if not reachable(source):
        whole = collection.list_files(spark, source).select("path", "content").join(files, "path")
        return collection.write_files(whole.select("name", F.expr("substring(content, 1, keep)").alias("content")), root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, keep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, base = pafs.FileSystem.from_uri(plain(path))
                to, below = pafs.FileSystem.from_uri(plain(root))
                to.create_dir(f"{below}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_input_stream(base) as found, to.open_output_stream(f"{below}/{name}") as out:
                    while keep > 0 and (data := found.read(min(keep, 4 << 20))):
                        out.write(data)
                        keep -= len(data)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.select("path", "name", "keep").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def quarantine(spark: SparkSession, root: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells of the tables that could be read whole, bad: table_id, reason, error): one pass over the files writes both. reason is 'footer'
    where a file is no Parquet file, 'rows' where it breaks off later. The bad ones are written too, so that their size is known and cells are not shuffled for a few of them."""
    out = out or scratch_folder(spark, "quarantine")
    read_cells(spark, root).write.parquet(out)
    both = spark.read.schema(READ).parquet(out)
    bad = both.where("error is not null").groupBy("table_id").agg(F.min("error").alias("error")).select("table_id", F.substring_index("error", ":", 1).alias("reason"), "error")
    bad = written(bad, "bad")
    return both.where("error is null").drop("error").join(bad.select("table_id"), "table_id", "left_anti"), bad
