"""Helpers shared by the operators of this package: reading, cutting lineage, hashing and batches."""

from __future__ import annotations

import sys
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session that runs in this one process gets a local one where it names
    none; on a cluster executors would not see that, so it is an error there."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="looma-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: later reads survive lost executors, and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/looma/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows. make() runs once a task and gives the function of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def crc_mod(doc_id, mod: int = 5):
    """crc32 of the id's decimal text, modulo mod. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fitting(rows: list, group: str, budget: int) -> list:
    """Of rows (n, group) in order, those whose n fit into the budget of their group one after the other; one that does not
    fit is left out. Where none of a group fits, its shortest stays, to be cut to the budget."""
    used: dict = {}
    out, least = [], {}
    for r in rows:
        g, n = r[group], r["n"] or 0
        if used.get(g, 0) + n <= budget:
            used[g] = used.get(g, 0) + n
            out.append(r)
        if g not in least or n < (least[g]["n"] or 0):
            least[g] = r
    return out + [r for g, r in least.items() if g not in used]


@cache
def class_of(category: str) -> str:
    """The code points whose Unicode category begins with this letter, as ranges for a class of a regular expression."""
    out, first = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == category
        if inside and first is None:
            first = cp
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{cp - 1:08x}")
            first = None
    return "".join(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Cache(dict):
    """key -> make(key), emptied when it holds `limit` entries, so memory stays bounded whatever the vocabulary."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
