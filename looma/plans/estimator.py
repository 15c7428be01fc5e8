"""Classifier and regressor by similarity to labelled context rows, bagged; composition of operators only.

A bag is a table of its own: its rows are drawn first, and what depends on them (constant and empty columns, the sample of
columns, statistics of numbers) comes from them alone. Context and query never share a frame, so their keys may overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.core import feature_kind
from ..operators import embed, encode, metrics, split
from ..operators.cells import typed_cells
from ..sources.scratch import written

#: Numbers of a text's vector, of a block of context rows, and rows of a tile of query rows: a block and a tile meet in one task.
DIM, BLOCK, TILE = 8, 1 << 22, 16_384
#: Numbers of a cell; queries and context rows that a task compares at a time, so that their cosines stay in the processor's cache.
WIDTH, STEP, SPAN = {"number": 1, "date": 4, "text": DIM}, 128, 2048


def _text(c: Column) -> Column:
    """A text that is equal for equal values of a cell, null for missing ones; of a long one its digest."""
    x = F.coalesce(c["num"].cast("string"), c["txt"], c["ts"].cast("string"))
    return F.when(F.length(x) > 64, F.sha2(x, 256)).otherwise(x)


class _Estimator:
    """fit() keeps the context; predict() draws bags (E6 to E8), drops columns that are empty in the bag (B2), constant ones and
    those over the cap for a bag and a chunk of the query together (B1, B3), encodes numbers with the bag's statistics (F5), compares
    each chunk with each bag (H8) and combines the bags.

    Bags hold bags x max_context_size rows at most. They travel to tiles of query rows, all together where they fit into a block, which then gives
    final answers, and in blocks of a bag otherwise. Of a bag only its statistics are collected, some numbers for each column. A key names a row of
    its side: rows that share a key are drawn, and answered, together; rows without a key are left out."""

    def __init__(self, bagging: int | str = 8, max_context_size: int = 8192, test_chunk_size: int = 1000, seed: int = 0, drop_constant: bool = True, max_columns: int = 500, clip_q: float = 0.005):
        self.bagging, self.max_context_size, self.test_chunk_size, self.seed = bagging, max_context_size, test_chunk_size, seed
        self.drop_constant, self.max_columns, self.clip_q = drop_constant, max_columns, clip_q

    def fit(self, context: DataFrame, target: str, key: str, features: list[str] | None = None):
        """context: labelled rows; features default to all other columns. A row without a key is left out."""
        self.context, self.target, self.key = context.where(F.col(target).isNotNull() & F.col(key).isNotNull()), target, key
        self.features = features or [c for c in context.columns if c not in (target, key)]
        self.n = self.context.count()
        kinds = [feature_kind(context.schema[c].dataType) for c in self.features]
        #: (column, kind) of every number of an encoded row
        self.layout = [(i, k) for i, k in enumerate(kinds) if k for _ in range(WIDTH[k])]
        if not self.layout:
            raise ValueError("no column gives a feature")
        return self

    def bags(self) -> DataFrame:
        """bag, draw, context_id, label: a row for each draw. An int bagging above 1 draws max_context_size rows with replacement, 1
        so many without, 'auto' takes windows; whatever the number of rows."""
        size, spark = self.max_context_size, self.context.sparkSession
        known = self.context.select(F.lit("t").alias("table_id"), F.col(self.key).alias("row_idx"), F.col(self.target).alias("label"), F.col(self.key).alias("own"))
        single = self.bagging != "auto" and int(self.bagging) == 1
        if single or self.n == 0:
            few = split.sample_big(known, "row_idx", size, self.seed) if self.n > size else known
            bags = split.number_rows(few, self.seed).withColumns({"bag": F.lit(0), "draw": F.col("row_idx")})
        elif self.bagging == "auto":
            dense = split.rows_at(known, split.window_places(spark, self.n, size), self.seed) if self.n > size else split.number_rows(known, self.seed)
            bags = split.bags_of_places(dense, self.n, size).withColumn("draw", F.col("row_idx"))
        else:
            places = split.bootstrap_places(spark, self.n, int(self.bagging), size, self.seed)
            bags = places.join(split.rows_at(known, places, self.seed), "row_idx")
        return bags.select(F.col("bag").cast("long").alias("bag"), F.col("draw").cast("long").alias("draw"), F.col("own").alias("context_id"), "label")

    def _vectors(self, df: DataFrame, cells: list[tuple[str, Column]], name: str) -> DataFrame:
        """df -> name (its key), range, at, ends, v, in one pass over its rows: ends has the _text() of each cell, v the numbers of the row in the order of
        self.layout, NaN for missing ones and zeros for null texts. at counts the keys of a partition (range) from 0, if its rows come in their order;
        rows that share a key share it."""
        numbers, texts = [], []
        for kind, c in cells:
            if kind == "text":
                texts.append(c["txt"])
            else:
                numbers += [c["num"]] if kind == "number" else [x / 50.0 for x in encode.date_parts(c["ts"])]
        wide = df.select(F.col(self.key).alias(name), F.array(*(_text(c) for _, c in cells)).alias("ends"), F.array(*numbers).cast("array<double>").alias("x"), F.array(*texts).cast("array<string>").alias("texts"))
        schema = T.StructType([wide.schema[name], T.StructField("range", T.LongType()), T.StructField("at", T.LongType()), wide.schema["ends"], T.StructField("v", T.ArrayType(T.DoubleType()))])
        arrow, encoder = to_arrow_schema(schema), embed.HashingEncoder(DIM)
        of_text = np.array([k == "text" for _, k in self.layout])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, at = None, -1
            for batch in (b for b in batches if b.num_rows):
                n, keys = batch.num_rows, batch.column(0)
                v = np.zeros((n, len(of_text)))
                if not of_text.all():
                    v[:, ~of_text] = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if of_text.any():
                    own = batch.column("texts").flatten().dictionary_encode()  # each text of a batch is encoded once
                    made = np.array([*encoder(own.dictionary.to_pylist()), [0.0] * DIM])
                    v[:, of_text] = made[own.indices.fill_null(len(made) - 1).to_numpy(zero_copy_only=False)].reshape(n, -1)
                new = np.ones(n, int)
                new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
                new[0] = at < 0 or keys[0].as_py() != last
                place = at + np.cumsum(new)
                last, at = keys[n - 1].as_py(), int(place[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, len(of_text), dtype=np.int32)), pa.array(v.ravel()))
                columns = [keys, pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(place), batch.column("ends"), lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return wide.mapInArrow(run, schema)

    def _placed(self, query: DataFrame) -> tuple[DataFrame, int]:
        """The query's rows encoded, with place, the number of the row's key in the order of keys; and how many keys there are. Rows are written with their
        numbers, since another run could draw other ranges."""
        parts = max(1, int(query.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        known = query.where(F.col(self.key).isNotNull()).select(self.key, *self.features).repartitionByRange(parts, self.key).sortWithinPartitions(self.key)
        rows = written(self._vectors(known, typed_cells(known, self.features), "query_id"), "asked")
        total, first = 0, []
        for r in rows.groupBy("range").agg((F.max("at") + 1).alias("n")).orderBy("range").collect():  # a row a range
            first += [total] * (r["range"] + 1 - len(first))
            total += r["n"]
        start = F.element_at(F.array(*(F.lit(x).cast("long") for x in first or [0])), (F.col("range") + 1).cast("int"))
        return rows.select("query_id", "ends", "v", (start + F.col("at")).alias("place")), total

    def _measured(self, drawn: DataFrame) -> dict:
        """By bag: for each column its place in the bag's own order, least and largest _text(), None for an empty column; and fill, low, high, mean and std of
        each number of a row (NaN without a value, null for dates and texts). drawn: a bag's cells. Bags x columns rows are collected."""
        columns = sorted({i for i, _ in self.layout})
        names = {i: self.features[i] for i in columns}
        own = drawn.groupBy("bag", "col_idx").agg(F.min("text").alias("least"), F.max("text").alias("most")).collect()
        stats = encode.number_statistics(drawn.where("kind = 'number'").withColumn("role", F.lit("context")), ["bag", "col_idx"], self.clip_q, "num")
        found = {(r["bag"], r["col_idx"]): [np.nan if r[k] is None else r[k] for k in ("fill", "low", "high", "mean", "std")] for r in stats.collect()}
        ends = {(r["bag"], r["col_idx"]): (r["least"], r["most"]) for r in own}
        h = lambda bag, c: (int(hashlib.md5(f"{bag + self.seed}:{names[c]}".encode()).hexdigest()[:8], 16), names[c])  # noqa: E731  # h32()
        out = {}
        for bag in {b for b, _ in ends}:
            rank = {c: i for i, c in enumerate(sorted(columns, key=lambda c: h(bag, c)))}
            numbers = np.array([found.get((bag, i), [np.nan] * 5) for i, k in self.layout if k == "number"]).reshape(-1, 5).T
            out[bag] = [(c, rank[c], *ends.get((bag, c), (None, None))) for c in columns], numbers
        return out

    def _scored(self, query: DataFrame, score: Callable, combine: np.ufunc, whole: tuple, cut: tuple) -> tuple[DataFrame, bool]:
        """query_id with answers, for every tile of queries and block of bags, and whether all bags fit into one block. score(a bag's labels in order) gives
        the labels that have numbers, and a function from unit vectors of some queries and of the bag's rows (as columns) to some numbers for each query; those
        of rows that share a key are combined. whole and cut are pairs: a function from [(bag, labels, numbers)] to columns of answers, as many for each query,
        and their kinds; whole gets all bags, cut one block of a bag. Vectors are of the columns that bag and chunk keep."""
        spark, width = query.sparkSession, len(self.layout)
        drawn = written(self.bags(), "bags")
        cells = typed_cells(self.context, self.features)
        rows = self.context.join(drawn.select(F.col("context_id").alias(self.key)).distinct(), self.key, "left_semi")
        known = written(rows.select(self.key, F.array(*(c for _, c in cells)).alias("c")), "context")
        own = [(kind, F.col("c")[i]) for i, (kind, _) in enumerate(cells)]
        of_bags = known.withColumnRenamed(self.key, "context_id").join(drawn, "context_id").select("bag", F.explode("c").alias("c"))
        measured = self._measured(written(of_bags.select("bag", "c.col_idx", "c.kind", "c.num", _text(F.col("c")).alias("text")), "bag-cells"))
        size = drawn.agg(F.count(F.lit(1)).alias("n"), F.max("draw").alias("last")).first()
        together, block = size["n"] * width <= BLOCK, max(1, BLOCK // width)
        piece = F.lit(0).cast("long") if together else F.col("bag") * (size["last"] // block + 1) + F.floor(F.col("draw") / block)
        drawn = drawn.withColumn("piece", piece)
        asked, n_keys = self._placed(query)
        chunk_rows = self.test_chunk_size
        tile_rows = chunk_rows * max(1, TILE // chunk_rows)
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        context = self._vectors(known, own, "context_id").select("context_id", F.col("v").alias("_v")).join(drawn, "context_id")
        tiles = spark.range(-(-n_keys // tile_rows)).select(F.col("id").alias("_tile"))
        right = context.repartition(parts, "bag", "draw").crossJoin(F.broadcast(tiles)).select("_tile", F.col("piece").alias("_piece"), "bag", "label", "_v")
        left = asked.withColumn("tile", F.floor(F.col("place") / tile_rows).cast("long")).crossJoin(F.broadcast(drawn.select("piece").distinct()))  # bags x max_context_size / block rows
        answer, kinds = whole if together else cut
        schema = T.StructType([T.StructField("query_id", query.schema[self.key].dataType), *(T.StructField(*k) for k in kinds)])
        arrow = to_arrow_schema(schema)
        column, is_number = np.array([i for i, _ in self.layout]), np.array([k == "number" for _, k in self.layout])
        drop_constant, max_columns = self.drop_constant, self.max_columns

        def scaled(v: np.ndarray, stats: np.ndarray) -> np.ndarray:
            """encode.scaled() of the numbers of rows."""
            fill, low, high, mean, std = stats
            x = v[:, is_number]
            x = np.maximum(low, np.minimum(high, np.where(np.isfinite(x), x, fill)))
            out = v.copy()
            out[:, is_number] = np.where(np.isnan(fill), 0.0, (x - mean) / np.where(std == 0, 1.0, std))
            return out

        def kept(columns: list, ends: list) -> tuple:
            """The columns that a bag and a chunk, whose least and largest texts are given, keep."""
            left = []
            for (c, rank, least, most), (low, high) in zip(columns, ends, strict=True):
                if least is not None and not (drop_constant and least == most and low in (None, least) and high in (None, least)):
                    left.append((rank, c))
            if len(left) + 1 > max_columns:
                left = sorted(left)[: max_columns - 1]
            return tuple(sorted(c for _, c in left))

        def run(asked: pa.Table, known: pa.Table) -> pa.Table:
            if not (asked.num_rows and known.num_rows):
                return arrow.empty_table()
            matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            asked, known = asked.sort_by("place").combine_chunks(), known.sort_by([("bag", "ascending"), ("label", "ascending")])
            q, c, labels, bags = matrix(asked.column("v")), matrix(known.column("_v")), known.column("label").to_pylist(), known.column("bag").to_numpy()
            names, first = np.unique(bags, return_index=True)
            sides = [(int(b), slice(i, j), *score(labels[i:j])) for b, i, j in zip(names, first, [*first[1:], len(bags)], strict=True)]
            place, start = np.unique(asked.column("place").to_numpy(), return_index=True)
            stop = np.append(start[1:], len(q))
            texts = asked.column("ends").combine_chunks().flatten()
            n_texts = len(texts) // len(q)
            texts = [texts.take(pa.array(np.arange(i, len(texts), n_texts))) for i in range(n_texts)]
            same: dict = {}  # the columns that each bag keeps -> keys of the query
            chunks, at = np.unique(place // chunk_rows, return_index=True)
            for i, j in zip(at, [*at[1:], len(place)], strict=True):
                ends = [tuple(pc.min_max(x[start[i] : stop[j - 1]]).as_py().values()) for x in texts]
                same.setdefault(tuple(kept(measured[b][0], ends) for b, *_ in sides), []).append(np.arange(i, j))
            out = []
            for columns, keys in same.items():
                keys = np.concatenate(keys)
                masks = [np.isin(column, own) for own in columns]
                near = [unit(scaled(c[own], measured[b][1]) * mask).T for (b, own, *_), mask in zip(sides, masks, strict=True)]
                for some in (keys[i : i + STEP] for i in range(0, len(keys), STEP)):
                    rows = np.concatenate([np.arange(start[k], stop[k]) for k in some]) if len(q) > len(place) else some
                    parts = []
                    for (b, _, of, compare), mask, other in zip(sides, masks, near, strict=True):
                        x = unit(scaled(q[rows], measured[b][1]) * mask)
                        numbers = np.concatenate([compare(x[i : i + STEP], other) for i in range(0, len(x), STEP)])
                        if len(rows) > len(some):
                            numbers = combine.reduceat(numbers, np.append(0, np.cumsum(stop[some] - start[some])[:-1]), axis=0)
                        parts.append((b, of, numbers))
                    made = answer(parts)
                    each = len(next(iter(made.values()))) // len(some)
                    ids = asked.column("query_id").take(pa.array(np.repeat(start[some], each)))
                    out.append(pa.table([ids.cast(arrow.field(0).type), *(pa.array(made[f.name], f.type) for f in list(arrow)[1:])], schema=arrow))
            return pa.concat_tables(out)

        # tasks are alike in work, not in bytes: a count of partitions that stays, and not one planned from bytes
        spread = max(parts, min(1024, -(-n_keys // tile_rows) * (1 if together else drawn.select("piece").distinct().count())))
        left, right = left.repartition(spread, "tile", "piece"), right.repartition(spread, "_tile", "_piece")
        return left.groupBy("tile", "piece").cogroup(right.groupBy("_tile", "_piece")).applyInArrow(run, schema), together


class Classifier(_Estimator):
    def _answers(self, query: DataFrame, best: bool) -> tuple[DataFrame, bool]:
        """query_id, label, p: of every class of the whole context, or of the most probable one; where bags do not fit into one block, query_id, bag, label, s."""
        label = ("label", self.context.schema[self.target].dataType)
        classes = [r["label"] for r in self.context.select(F.col(self.target).alias("label")).distinct().orderBy("label").limit(embed.MAX_CONTEXT + 1).collect()]
        if len(classes) > embed.MAX_CONTEXT:
            raise ValueError(f"more than {embed.MAX_CONTEXT} classes")
        at = {x: i for i, x in enumerate(classes)}

        def score(labels: list) -> tuple[list, Callable]:
            """The largest similarity to each class; rows come ordered by class."""
            first = np.array([i for i, x in enumerate(labels) if i == 0 or x != labels[i - 1]] + [len(labels)])
            spans, i = [], 0  # of classes that have SPAN rows together at most, or of one class
            while i < len(first) - 1:
                j = max(i + 1, int(np.searchsorted(first, first[i] + SPAN, "right")) - 1)
                spans.append((first[i], first[j], first[i:j] - first[i]))
                i = j

            def compare(x: np.ndarray, other: np.ndarray) -> np.ndarray:
                return np.concatenate([(x @ other[:, a:b]).max(1, keepdims=True) if len(own) == 1 else np.maximum.reduceat(x @ other[:, a:b], own, axis=1) for a, b, own in spans], axis=1)

            return [labels[i] for i in first[:-1]], compare

        def whole(parts: list) -> dict:
            """The mean of the bags' softmaxes of embed.similarity_logit()."""
            p = np.zeros((len(parts[0][2]), len(classes)))
            for _, labels, s in parts:
                x = np.clip((s + 1) / 2, 1e-6, 1 - 1e-6)
                logit = np.log(x / (1 - x))
                e = np.exp(logit - logit.max(axis=1, keepdims=True))
                p[:, [at[x] for x in labels]] += e / e.sum(axis=1, keepdims=True)
            p /= len(parts)
            if best:
                top = p.argmax(axis=1)
                return {"label": [classes[i] for i in top], "p": p[np.arange(len(p)), top]}
            return {"label": classes * len(p), "p": p.ravel()}

        def cut(parts: list) -> dict:
            ((bag, labels, s),) = parts
            return {"bag": np.full(s.size, bag), "label": labels * len(s), "s": s.ravel()}

        return self._scored(query, score, np.maximum, (whole, [label, ("p", T.DoubleType())]), (cut, [("bag", T.LongType()), label, ("s", T.DoubleType())]))

    def _combined(self, scores: DataFrame) -> DataFrame:
        best = scores.groupBy("query_id", "bag", "label").agg(F.max("s").alias("s"))  # over the blocks of a bag
        logits = written(best.select("query_id", "bag", "label", embed.similarity_logit((F.col("s") + 1) / 2).alias("logit")), "logits")
        classes = self.context.select(F.col(self.target).alias("label")).distinct()
        return embed.combine_bags(embed.align_classes(logits, classes, ["query_id", "bag"]))

    def predict_proba(self, query: DataFrame) -> DataFrame:
        """query_id, label, p: of every class of the whole context."""
        found, whole = self._answers(query, best=False)
        return found if whole else self._combined(found)

    def predict(self, query: DataFrame) -> DataFrame:
        """query_id, label, p: of the most probable class; ties to the first."""
        found, whole = self._answers(query, best=True)
        return found if whole else embed.predict_label(self._combined(found))


class Regressor(_Estimator):
    def predict(self, query: DataFrame) -> DataFrame:
        """query_id, value: in each bag the mean of labels weighted by softmaxed similarity, then the mean over bags."""

        def score(labels: list) -> tuple[list, Callable]:
            y = np.array(labels, float)

            def compare(x: np.ndarray, other: np.ndarray) -> np.ndarray:
                w = np.exp(10 * (x @ other))
                return np.stack([w @ y, w.sum(1)], 1)

            return [], compare

        def whole(parts: list) -> dict:
            return {"value": np.mean([x[:, 0] / x[:, 1] for _, _, x in parts], axis=0)}

        def cut(parts: list) -> dict:
            ((bag, _, x),) = parts
            return {"bag": np.full(len(x), bag), "total": x[:, 0], "weight": x[:, 1]}

        numbers = [("bag", T.LongType()), ("total", T.DoubleType()), ("weight", T.DoubleType())]
        found, together = self._scored(query, score, np.add, (whole, [("value", T.DoubleType())]), (cut, numbers))
        if together:
            return found
        per = found.groupBy("query_id", "bag").agg((F.sum("total") / F.sum("weight")).alias("value"))  # over the blocks of a bag
        return embed.combine_regression(per)


def demo_report(rows: DataFrame, target: str, key: str, test_share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Predictions with residuals for a random test share, and their measures."""
    n = rows.count()
    placed = split.number_rows(rows.withColumns({"table_id": F.lit("t"), "row_idx": F.col(key)}), seed)
    test, train = placed.where(F.col("row_idx") < F.ceil(F.lit(n * test_share))), placed.where(F.col("row_idx") >= F.ceil(F.lit(n * test_share)))
    test, train = test.drop("table_id", "row_idx"), train.drop("table_id", "row_idx")
    found = Regressor(bagging=1, seed=seed).fit(train, target, key).predict(test.drop(target))
    out = metrics.residuals(test.select(F.col(key).alias("query_id"), F.col(target).alias("truth")).join(found, "query_id").withColumnRenamed("value", "prediction"))
    return out, metrics.regression_report(out)
