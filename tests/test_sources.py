"""The data source of table files: planning by footers, ranges, bytes read, broken files."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from looma.plans import jobs
from looma.sources import collection, committed, shards, tablefiles
from looma.sources.vectors import EmbeddingCache
from looma.streaming import tables


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "g").mkdir()
    big = pa.table({"bytes": [rng.bytes(200).hex() for _ in range(20_000)], "n": list(range(20_000)), "last": [i % 3 for i in range(20_000)]})
    pq.write_table(big, tmp_path / "g" / "big.parquet", row_group_size=2_500)
    for i in range(30):
        pq.write_table(pa.table({"d": [f"2024-01-{j + 1:02d}" for j in range(i)], "flag": [j % 2 == 0 for j in range(i)]}), tmp_path / f"small{i:02d}.parquet")
    (tmp_path / "no.parquet").write_bytes(b"PAR1 nothing")
    (tmp_path / "_hidden.parquet").write_bytes(b"x")
    data = bytearray((tmp_path / "g" / "big.parquet").read_bytes())
    data[len(data) // 2 : len(data) // 2 + 4000] = b"\0" * 4000  # the footer is whole, a row group is not
    (tmp_path / "torn.parquet").write_bytes(bytes(data))
    return tmp_path


def test_partitions_come_from_footers(folder):
    reader = tablefiles.TableReader({"path": str(folder), "target_mb": "1"})
    pieces = [p for part in reader.partitions() for p in part.pieces]
    big = [p for p in pieces if p.path == "/g/big.parquet"]
    assert (big[0].first, big[-1].stop) == (0, 8) and len(big) > 2 and all(p.row == 2_500 * p.first for p in big)
    assert all(a.stop == b.first and not a.whole for a, b in zip(big, big[1:], strict=False))
    assert len({p.path for p in pieces}) == 33 and [p.error[:7] for p in pieces if p.error] == ["footer:"]
    one = tablefiles.TableReader({"path": str(folder), "target_mb": "64"}).partitions()
    assert sum(p.path.startswith("/small") for part in one for p in part.pieces) == 30 and len(one) <= 2
    assert tablefiles.TableReader({"path": str(folder / "g")}).files() == ["/big.parquet"]


def test_only_the_bytes_of_the_last_column_are_read(folder, monkeypatch):
    count = {"bytes": 0}

    class Counting:
        """A file that counts what is read from it."""

        def __init__(self, f):
            self.f, self.closed = f, False

        def read(self, n=-1):
            data = self.f.read(n)
            count["bytes"] += len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

    monkeypatch.setattr(tablefiles.TableReader, "open", lambda self, below: pq.ParquetFile(pa.PythonFile(Counting(open(f"{self.root}{below}", "rb")), "r")))
    size = (folder / "g" / "big.parquet").stat().st_size

    def read(what):
        count["bytes"] = 0
        reader = tablefiles.TableReader({"path": str(folder / "g"), "what": what})
        return [b for part in reader.partitions() for b in reader.read(part)], count["bytes"]

    last, few = read("last")
    cells, many = read("cells")
    assert sum(b.num_rows for b in cells) == 60_000 and many > 0.9 * size and few < 0.05 * size
    assert sum(r["n"] for b in last for r in b.to_pylist()) == 20_000 and {r["value"] for b in last for r in b.to_pylist() if r["n"]} == {"0", "1", "2"}


@pytest.mark.parametrize("target", [1, 64])
def test_cells_and_quarantine(spark, folder, target):
    raw = tablefiles.read_cells(spark, str(folder), target_mb=target)
    big = raw.where("table_id like '%/big.parquet' and col_name = 'n'")
    assert big.count() == 20_000 and big.where("num = row_idx").count() == 20_000
    assert {r[0].rpartition("/")[2] for r in raw.where("error is not null").select("table_id").distinct().collect()} == {"no.parquet", "torn.parquet"}
    if target == 64:
        assert raw.where("table_id like '%/torn.parquet' and error is null").count() == 0  # of one range: whole or not at all
    cells, bad = tablefiles.quarantine(spark, str(folder))
    assert {(r["table_id"].rpartition("/")[2], r["reason"]) for r in bad.collect()} == {("no.parquet", "footer"), ("torn.parquet", "rows")}
    assert cells.select("table_id").distinct().count() == 30 and cells.count() == 60_000 + 2 * sum(range(30))
    other = collection.files_to_cells(collection.list_files(spark, f"file:{folder}").select("path", "content").withColumnRenamed("path", "table_id"))
    assert other.where("error is null").drop("table_id", "ts").exceptAll(raw.where("error is null and table_id not like '%torn%'").drop("table_id", "ts")).count() == 0
    values = tablefiles.last_values(spark, str(folder), target_mb=target)
    assert values.where("path like '%/big.parquet'").groupBy().sum("n").first()[0] == 20_000
    found, _ = jobs.classify_inputs(spark, str(folder))
    labels = {r["path"].rpartition("/")[2]: (r["label"], r["reason"], r["group"]) for r in found.collect()}
    assert labels["big.parquet"] == ("classification", "numeric_discrete_target", "g") and labels["no.parquet"][1] == "read_error" and labels["small00.parquet"] == ("unknown", "empty_table", "small00")


def test_stores_that_only_spark_reads(spark, folder, monkeypatch):
    assert tablefiles.reachable(str(folder)) and tablefiles.reachable(f"file:{folder}") and not tablefiles.reachable("viewfs://store/in")
    want = sorted(tuple(r)[1:6] for r in tablefiles.read_cells(spark, str(folder / "g")).where("error is null").collect())
    monkeypatch.setattr(tablefiles, "reachable", lambda root: False)
    assert sorted(tuple(r)[1:6] for r in tablefiles.read_cells(spark, str(folder / "g")).where("error is null").collect()) == want


def test_vectors_last_and_are_joined_without_a_shuffle(spark, tmp_path):
    met = spark.sparkContext.accumulator(0)

    def encoder(texts):
        met.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def rows(texts):
        return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, vector string")

    cache = EmbeddingCache(spark, str(tmp_path / "v"), 4)
    first = {r["id"]: r["vector"] for r in cache.embed(rows(["a", "bb", "a", None, ""]), "text", encoder).collect()}
    assert first == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [1.0, 1.0], 3: None, 4: [0.0, 1.0]} and met.value == 3
    spark.sql(f"DROP TABLE {cache.name}")  # another session: the files are still there
    cache = EmbeddingCache(spark, str(tmp_path / "v"), 4)
    second = cache.embed(rows(["ccc", "bb", "a"]), "text", encoder)
    assert {r["id"]: r["vector"] for r in second.collect()} == {0: [3.0, 1.0], 1: [2.0, 1.0], 2: [1.0, 1.0]} and met.value == 4
    assert cache.table().count() == 4 == cache.table().select("text").distinct().count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cache.embed(rows(["a"]), "text", encoder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 2  # texts of the batch and its rows, not the cache
    assert EmbeddingCache(spark, str(tmp_path / "none"), 4).embed(rows([None]), "text", encoder).first()["vector"] is None


@pytest.mark.parametrize("kind", committed.KINDS)
def test_a_killed_write_leaves_no_readable_output(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    df = spark.range(1000).repartition(4).select("id", F.concat(F.lit("n,\"\n"), "id").alias("name") if kind != "csv" else F.concat(F.lit("n "), "id").alias("name"))
    killed = df.withColumn("id", F.when(F.col("id") == 777, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        committed.write_committed(killed, path, kind)
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)
    committed.write_committed(df, path, kind)
    want = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, committed.read_committed(spark, path).collect())) == want
    with pytest.raises(Exception, match="killed"):
        committed.write_committed(killed, path, kind)  # what was there before stays
    (tmp_path / "out" / "_parts" / "left.parquet").write_bytes(b"of a lost task")
    assert sorted(map(tuple, committed.read_committed(spark, path).collect())) == want
    committed.write_committed(df.where("id < 10"), path, kind, "append")
    assert committed.read_committed(spark, path).count() == 1010 == sum(p["rows"] for p in committed.read_manifest(path)["parts"])
    with pytest.raises(Exception, match="another kind or schema"):
        committed.write_committed(df.select("id"), path, kind, "append")
    committed.write_committed(df.limit(0), path, kind)
    assert committed.read_committed(spark, path).count() == 0


@pytest.fixture
def written_by_spark(spark, tmp_path):
    """A table as a folder of files, as Spark writes it, and one of a single row group that is larger than a blob."""
    spark.range(1000).select("id", (F.col("id") % 3).alias("last")).repartition(4).write.parquet(str(tmp_path / "in" / "folder.parquet"))
    rng = np.random.default_rng(2)
    pq.write_table(pa.table({"x": rng.random(1_500_000), "y": [0] * 1_500_000}), tmp_path / "in" / "large.parquet", row_group_size=1_500_000)
    return tmp_path


def test_a_large_table_is_packed_in_parts(spark, written_by_spark):
    out = str(written_by_spark / "out")
    manifest = jobs.repack(spark, str(written_by_spark / "in"), out, 4.0).first()[0]
    large = shards.read_shards(spark, manifest, out, 1_500_000).orderBy("first_row").collect()
    assert len(large) >= 3 and max(len(r["table_bytes"]) for r in large) < 10 * 2**20 and {r["table_rows"] for r in large} == {1_500_000}
    at = 0
    for r in large:
        assert r["first_row"] == at and collection.from_blob(r["table_bytes"]).num_rows == r["num_rows"]
        at += r["num_rows"]
    assert at == 1_500_000 and json.loads(manifest)["num_tables"] == 5  # four files of the folder and the large one


def test_a_folder_of_files_is_one_table(spark, written_by_spark):
    root = str(written_by_spark / "in")
    found, _ = jobs.classify_inputs(spark, root)
    assert {r["path"].rpartition("/")[2]: (r["label"], r["reason"]) for r in found.collect()} == {"folder.parquet": ("classification", "numeric_discrete_target"), "large.parquet": ("classification", "numeric_discrete_target")}
    specs = str(written_by_spark / "specs")
    tables.stream_tables(spark, root, specs, str(written_by_spark / "checkpoint")).awaitTermination()
    rows = [(r["table_id"].rpartition("/")[2], r["is_regression"]) for r in spark.read.parquet(specs).collect()]
    assert sorted(rows) == [("folder.parquet", False), ("folder.parquet", True), ("large.parquet", True)]


def test_large_files_are_not_held(spark, written_by_spark):
    """Neither decoded nor copied as a whole: the second row group of a cut file is missing, its first half is there."""
    reader = tablefiles.TableReader({"path": str(written_by_spark / "in"), "what": "cells"})
    pieces = {p.path: p for part in reader.partitions() for p in part.pieces}
    assert pieces["/large.parquet"].whole and max(b.num_rows for _, b in reader.parts(reader.open("/large.parquet"), pieces["/large.parquet"], None)) <= tablefiles.ROWS
    root = str(written_by_spark / "copy")
    files = collection.list_files(spark, str(written_by_spark / "in")).where("path like '%/large.parquet'").select("path", F.lit("a/b.parquet").alias("name"), F.expr("length div 2").alias("keep"))
    tablefiles.copy_files(spark, files, str(written_by_spark / "in"), root)
    whole = (written_by_spark / "in" / "large.parquet").read_bytes()
    assert (written_by_spark / "copy" / "a" / "b.parquet").read_bytes() == whole[: len(whole) // 2]
