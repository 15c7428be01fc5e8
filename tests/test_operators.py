"""Boundary cases and invariants on small frames."""

import http.server
import json
import math
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from looma.functions import core
from looma.operators import embed, encode, profile, split, tables, tasks, verbalize
from looma.operators.cells import to_cells
from looma.plans import jobs
from looma.sources import collection, shards
from looma.streaming import tables as streaming

ROUTES = [
    ("two values", [5, -3] * 17, "classification"), ("three values, halves", [0.5, 1.5, 2.5] * 40, "classification"), ("twenty", [11 * (i % 20) for i in range(63)], "classification"), ("twenty-one", [11 * (i % 21) for i in range(63)], "regression"),
    ("one value", [-2.25] * 31, "none"), ("just over half missing", [float(i) for i in range(24)] + [None] * 25, "none"), ("half missing", [float(i) for i in range(25)] + [None] * 25, "regression"), ("sixty-three names", [f"n{i % 63}" for i in range(630)], "none"),
    ("sixty-two names", [f"n{i % 62}" for i in range(620)], "classification"), ("a fifth are names", [f"n{i % 9}" for i in range(45)], "classification"), ("over a fifth are names", [f"n{i % 9}" for i in range(44)], "none"), ("flags of nine rows", ([False, True] * 5)[:9], "none"), ("flags of ten rows", [False, True] * 5, "classification"),
]


@pytest.mark.parametrize("name,values,task", ROUTES)
def test_routing(spark, name, values, task):
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}[type(next(v for v in values if v is not None))]
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    assert profile.profile_table(df, "t").select(profile.route()).first()[0] == task
    cells = to_cells(df.withColumn("i", F.monotonically_increasing_id()), F.lit("t"), F.col("i"), ["x"])
    assert profile.profile_columns(cells).select(profile.route()).first()[0] == task


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert profile.profile_table(df, "t").select("n_non_null", "n_distinct").first() == (1, 1)


def test_decimal_and_wide(spark):
    df = spark.range(100).selectExpr("cast(id % 5 as decimal(10,2)) x")
    assert profile.profile_table(df, "t").select(profile.route()).first()[0] == "classification"
    columns = spark.createDataFrame([("t", f"f{i}") for i in range(200)] + [("t", "target")], "table_id string, col_name string")
    kept = tables.cap_columns(columns, 128, 0, "target").collect()
    assert len(kept) == 128 and ("t", "target") in [tuple(r) for r in kept]
    assert tables.cap_columns(columns.limit(11), 128, 0, "f0").count() == 11


def numbers(spark, values, mode, context=None):
    rows = [("t", "Age", float(v) if v is not None else None, "query") for v in values] + [("t", "Age", float(v), "context") for v in context or []]
    df = spark.createDataFrame(rows, "table_id string, col_name string, x double, role string")
    out = verbalize.verbalize_numbers(df, mode, ["table_id", "col_name"]).where("role = 'query'").select("x", "text").collect()
    return {r[0] if r[0] is None or not math.isnan(r[0]) else "nan": r[1] for r in out}


def test_number_texts(spark):
    values = [17.0, -17.00004, 2.718281828, -0.0, 7e9, 98765.4, 6.25e-7, 0.1 + 0.2]
    found = numbers(spark, [*values, None, float("nan"), float("-inf")], "s0")
    assert [found[v] for v in values] == [f"{v + 0.0:.4g}" for v in values] and found[7e9] == "7e+09"
    assert {found[None], found["nan"], found[float("-inf")]} == {""}
    assert numbers(spark, [-2.5], "s1") == {-2.5: "Age: -2.5"}
    context = [float(3 * i) for i in range(21)]  # deciles at 0, 6, 12, ...
    assert numbers(spark, [13.0, -99.0, 99.0], "s2", context) == {13.0: "Age: 12-18 (quantile 20-30%)", -99.0: "Age: 0-6 (quantile 0-10%)", 99.0: "Age: 54-60 (quantile 90-100%)"}
    for bad in ("", "S0", None):
        with pytest.raises(ValueError):
            numbers(spark, [1], bad)


def test_date_texts(spark):
    df = spark.sql("select timestamp'1999-11-30 23:59:59' late, timestamp'2031-05-09' early, cast(null as timestamp) none")
    for mode, want in (("s0", ("1999-11-30", "2031-05-09", "")), ("s1", ("when: 1999-11-30", "when: 2031-05-09", "")), ("s2", ("when: year 1999, November, Tuesday, Q4", "when: year 2031, May, Friday, Q2", ""))):
        assert tuple(df.select(*(verbalize.verbalize_date(F.lit("when"), F.col(c), mode) for c in df.columns)).first()) == want


def frame(spark, context, query=()):
    return spark.createDataFrame([("t", v, "context") for v in context] + [("t", v, "query") for v in query], "table_id string, x double, role string")


def test_quantize(spark):
    out = encode.quantize(frame(spark, [0.0, 1.0, 2.0, 3.0, 4.0]), ["table_id"], bins=2).select("x", "lower_bin", "delta", "bin").collect()
    found = {r[0]: tuple(r[1:]) for r in out}
    assert found[0.0] == (0, 0.0, 0) and found[2.0] == (0, 0.5, 0) and found[4.0] == (0, 1.0, 1)
    out = encode.encode_numbers_binned(frame(spark, [5.0, 5.0, 5.0, None]), ["table_id"]).select("x", "bin", "delta").distinct().collect()
    assert {tuple(r) for r in out} == {(5.0, 14, 0.0), (None, 63, 0.0)}


def test_scaling_edges(spark):
    assert {r[0] for r in encode.standard_scale(frame(spark, [5.0, 5.0]), ["table_id"]).select("z").collect()} == {0.0}
    out = encode.standard_scale(frame(spark, [None, None], [float("inf"), 3.0]), ["table_id"]).select("mean", "std").first()
    assert tuple(out) == (0.0, 1.0)


def test_labels_and_dates(spark):
    df = spark.createDataFrame([("t", "a", "context"), ("t", "a", "context"), ("t", "b", "context"), ("t", "c", "query"), ("t", None, "query")], "table_id string, x string, role string")
    out = {(r.x, r.class_id) for r in encode.encode_labels(df, ["table_id"], "x").collect()}
    assert {i for x, i in out if x in ("a", "b")} == {0, 1} and ("c", 62) in out and (None, 62) in out
    d = spark.sql("select timestamp'1995-03-05' t union all select null")
    assert {tuple(r) for r in d.select(*encode.date_parts(F.col("t"))).collect()} == {(1, 3, 5, 7), (0, 0, 0, 0)}


def test_bags(spark):
    assert split.bag_starts(10, 4) == [(0, 0), (1, 3), (2, 6)] and split.bag_starts(4, 4) == [(0, 0)]
    with pytest.raises(ValueError):
        split.context_size(F.lit(3), True)


def test_number_text(spark):
    values = [" 12 ", "inf", "1e3", ".5", "5.", "1d", "0x10", "nan", "", "-Infinity"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    found = {r[0]: r[1] for r in df.select("x", core.number_text(F.col("x"))).collect()}
    assert found == {" 12 ": 12.0, "inf": math.inf, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "1d": None, "0x10": None, "nan": None, "": None, "-Infinity": -math.inf}


@pytest.fixture
def tree(tmp_path):
    for c in range(2):
        (tmp_path / f"chunk-{c}").mkdir()
        for i in range(4):
            t = pa.table({"a": list(range(10 + i)), "b": [f"x{j % 3}" for j in range(10 + i)]} if i % 2 else {"v": [j * 0.5 for j in range(10 + i)]})
            pq.write_table(t.slice(0, 0) if i == 3 else t, tmp_path / f"chunk-{c}" / f"h{0 if i < 2 else i}=__u{i}.parquet")
        (tmp_path / f"chunk-{c}" / "bad=__x.parquet").write_bytes(b"not parquet")
    return str(tmp_path)


def test_collection_and_repack(spark, tree, tmp_path):
    t = collection.read_tables(spark, tree)
    assert t.where("error is not null").count() == 2 and t.where("error is null").count() == 8
    cells = collection.blobs_to_cells(t.where("error is null").select(F.col("path").alias("table_id"), "table_bytes"))
    assert cells.groupBy("table_id").count().count() == 6
    out = str(tmp_path / "out")
    m = json.loads(jobs.repack(spark, tree, out, 0.001).first()[0])
    assert m["num_tables"] == 4 and m["num_skipped"] == 4
    back = shards.read_shards(spark, json.dumps(m), out, 11)
    assert all(collection.from_blob(r["table_bytes"]).num_rows == r["num_rows"] >= 11 for r in back.collect())
    assert shards.read_manifest(spark, json.dumps(m)).count() == m["num_shards"]
    found, counts = jobs.classify_inputs(spark, f"file:{tree}")
    assert found.where("reason = 'read_error'").count() == 2 and counts.count() == 3
    assert {(r["reason"], r["group"]) for r in found.collect()} >= {("empty_table", "chunk-0"), ("read_error", "chunk-1")}
    jobs.route_inputs(spark, f"file:{tree}", str(tmp_path / "routed"))
    assert spark.read.parquet(str(tmp_path / "routed")).count() == found.count()
    with pytest.raises(Exception, match="bad=__x"):
        collection.read_tables(spark, tree, "raise").collect()


def test_pack_shards_fills_to_the_target(spark):
    t = spark.createDataFrame([("c", f"p{i:02d}", f"t{i}", 40) for i in range(10)], "source_chunk string, source_path string, table_id string, size long")
    sizes = [r[1] for r in shards.pack_shards(t, 100).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 3, 1]


@pytest.mark.parametrize("target", [1, 50, 120, 10_000])
def test_pack_shards_equals_a_greedy_loop(spark, target):
    rng = np.random.default_rng(target)
    rows = [(f"c{c}", f"p{i:03d}", f"c{c}-{i}", int(x)) for c, n in ((0, 150), (1, 1), (2, 7)) for i, x in enumerate(rng.choice([0, 1, 5, 30, 119, 120, 500], n))]
    want = {}
    for c in ("c0", "c1", "c2"):
        n, held = 0, 0
        for _, _, table, size in (r for r in rows if r[0] == c):
            want[table] = f"shard-{c}-{n:04d}"
            held += size
            if held >= target:
                n, held = n + 1, 0
    t = spark.createDataFrame(rows, "source_chunk string, source_path string, table_id string, size long").repartition(3)
    assert {r["table_id"]: r["shard"] for r in shards.pack_shards(t, target).collect()} == want
    assert shards.pack_shards(t.limit(0), target).count() == 0


def test_replay_balances(spark):
    s = spark.createDataFrame([(str(i), "y", i % 4 == 0) for i in range(100)], "table_id string, target_column string, is_regression boolean")
    assert {r[1] for r in tasks.balance_by_replay(s, 1).groupBy("is_regression").count().collect()} == {75}
    one = s.where("is_regression")
    assert tasks.balance_by_replay(one, 1).count() == one.count()


def test_placebo_has_the_same_cells(spark):
    cells = spark.createDataFrame([("t", i, 0, "a", "number", float(i), None, None, "context") for i in range(5)], "table_id string, row_idx long, col_idx int, col_name string, kind string, num double, txt string, ts timestamp, role string")
    texts = verbalize.cell_texts(cells, "s0")
    vectors = verbalize.placebo_vectors(texts, 4, 1)
    assert vectors.count() == texts.count() == 5 and vectors.select("vector").distinct().count() == 5


def test_remote_encoder():
    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            body = json.dumps({"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(texts)))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert embed.RemoteEncoder(f"http://127.0.0.1:{server.server_port}", "m", batch=2)(["abc", "", "x" * 5]) == [[3], [1], [5]]
    server.shutdown()


def test_streams(spark, tree, tmp_path):
    specs = str(tmp_path / "specs")
    want = None
    for run in ("a", "a", "b", "c"):  # the same checkpoint, then lost ones
        if run == "c":
            pq.write_table(pa.table({"v": [j * 0.5 for j in range(30)]}), f"{tree}/chunk-1/h9=__late.parquet")
        streaming.stream_tables(spark, tree, specs, str(tmp_path / f"checkpoint-{run}")).awaitTermination()
        rows = [tuple(r) for r in spark.read.parquet(specs).select("table_id", "is_regression", "target_column").collect()]
        assert len({r[:2] for r in rows}) == len(rows) > 0
        assert want is None or set(rows) - want == ({r for r in rows if "late" in r[0]} if run == "c" else set()) and want <= set(rows)
        want = set(rows)
    assert any("late" in r[0] for r in want)


def test_running_skip_over_batches(spark, tmp_path):
    """Three files, a batch each: the counts go on from batch to batch."""
    flags = str(tmp_path / "flags")
    seqs = list(range(900))
    for part in range(3):
        own = seqs[part * 300 : part * 300 + 300]
        spark.createDataFrame([(s, str(s), s % 10 != 0) for s in own[::-1]], "seq long, table_id string, is_regression boolean").coalesce(1).write.mode("append").parquet(flags)
        time.sleep(1.1)
    stream = spark.readStream.schema("seq long, table_id string, is_regression boolean").option("maxFilesPerTrigger", 1).parquet(flags)
    kept = {r["seq"] for r in streaming.run_to_table(streaming.running_skip(stream, 5, warm_up=8, shares=4), "skip").collect()}
    chance = {r["s"]: r["h"] / 2**32 for r in spark.range(900).select(F.col("id").alias("s"), core.h32(5, F.col("id")).alias("h")).collect()}
    want = set()
    for share in range(4):
        seen = regression = 0
        for s in seqs:
            if s % 4 == share:
                is_regression = s % 10 != 0
                part = (regression if is_regression else seen - regression) / seen if seen else 0
                if seen < 2 or part <= 0.5 or chance[s] >= 2 * (part - 0.5):
                    want.add(s)
                    seen, regression = seen + 1, regression + is_regression
    assert kept == want and 0.4 < sum(s % 10 != 0 for s in kept) / len(kept) < 0.8
    q = streaming.task_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {(True, 810), (False, 90)}


@pytest.mark.parametrize("bagging, size, bags, rows", [(3, 20, 3, 20), (3, 50, 3, 50), ("auto", 20, 2, 20), ("auto", 50, 1, 30), (1, 20, 1, 20), (1, 50, 1, 30)])
def test_bags_follow_bagging_above_and_below_the_context_size(spark, bagging, size, bags, rows):
    from looma.plans.estimator import Regressor

    df = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(30)], "id long, x double, y double")
    query = df.where("id < 2").drop("y").withColumn("id", F.col("id") + 100)
    model = Regressor(bagging=bagging, max_context_size=size, seed=5).fit(df, "y", "id")
    n = {}
    for r in model.bags().collect():
        n.setdefault(r["bag"], []).append(r["context_id"])
    assert len(n) == bags and all(len(x) == rows for x in n.values())
    if bagging != 3:
        assert all(len(set(x)) == rows for x in n.values())
    assert bagging == "auto" or size == 50 or model.predict(query).count() == 2


def encoded(v, context):
    """A column's numbers by hand: clipped to the context's quantiles and standardised."""
    c = np.array([np.mean([x for x in context if x is not None]) if x is None else x for x in context])
    low, high = np.quantile(c, [0.005, 0.995])
    c = c.clip(low, high)
    return (np.clip(np.mean([x for x in context if x is not None]) if v is None else v, low, high) - c.mean()) / (c.std() or 1)


@pytest.mark.parametrize("bagging, size, chunk, columns, block", [(1, 100, 1000, 500, 1 << 22), (1, 100, 2, 3, 1 << 22), (2, 12, 3, 4, 100), (3, 60, 1000, 500, 1 << 22), ("auto", 12, 4, 500, 200), (1, 12, 1000, 500, 1 << 22)])
def test_estimators_against_brute_force(spark, monkeypatch, bagging, size, chunk, columns, block):
    """Every bag by itself; the query's keys are also keys of the context."""
    from looma.functions.core import h32
    from looma.plans import estimator

    monkeypatch.setattr(estimator, "BLOCK", block)
    rng = np.random.default_rng(3)
    schema = "id long, a double, b double, colour string, constant string, rare double, only string, y double, label string"
    make = lambda i: (i, float(rng.normal()), None if i % 5 == 0 else float(i % 4), None if i % 11 == 0 else "red" if i % 3 else "blue", "same", 9.0 if i == 3 else 1.0, None if i < 30 else "q", float(i % 7), "abc"[i % 3])
    table = [make(i) for i in range(40)]
    context = spark.createDataFrame(table[:30], schema)
    shifted = [(r[0] - 25, *r[1:]) for r in table[30:]]  # ids 5 to 14, which the context has, too
    query = spark.createDataFrame(shifted, schema).drop("y", "label")
    names = ["a", "b", "colour", "constant", "rare", "only"]
    rank = {(b, c): h for b in range(5) for c, h in ((r["c"], r["h"]) for r in spark.createDataFrame([(c,) for c in names], "c string").select("c", h32(b, F.col("c")).alias("h")).collect())}
    encoder = embed.HashingEncoder(8)
    value = lambda r, c: r[1 + names.index(c)]

    def vector(row, kept, bag):
        out = []
        for c in kept:
            v = value(row, c)
            text = c in ("colour", "constant", "only")
            out += ([0.0] * 8 if v is None else encoder([v])[0]) if text else [encoded(v, [value(r, c) for r in bag])]
        return np.array(out) / max(np.linalg.norm(out), 1e-12)

    options = {"bagging": bagging, "max_context_size": size, "test_chunk_size": chunk, "max_columns": columns}
    model = estimator.Regressor(**options).fit(context.drop("label"), "y", "id")
    bags: dict = {}
    for r in model.bags().collect():
        bags.setdefault(r["bag"], []).append(table[r["context_id"]])
    want_y, want_p = {}, {}
    for i, q in enumerate(shifted):
        together = [r for k, r in enumerate(shifted) if k // chunk == i // chunk]
        ys, ps = [], []
        for b, rows in bags.items():
            kept = [c for c in names if any(value(r, c) is not None for r in rows) and len({value(r, c) for r in rows + together} - {None}) != 1]
            if len(kept) + 1 > columns:
                kept = sorted(kept, key=lambda c: (rank[b, c], c))[: columns - 1]
            s = np.array([vector(q, kept, rows) @ vector(r, kept, rows) for r in rows])
            w = np.exp(10 * s)
            ys.append(float(w @ np.array([r[7] for r in rows]) / w.sum()))
            best = np.array([max([x for x, r in zip(s, rows, strict=True) if r[8] == c], default=-np.inf) for c in "abc"])
            p = np.where(np.isfinite(best), ((best + 1) / 2).clip(1e-6, 1 - 1e-6), 0)
            p = p / (1 - p)
            ps.append(p / p.sum())
        want_y[q[0]], want_p[q[0]] = np.mean(ys), np.mean(ps, 0)
    found_y = {r["query_id"]: r["value"] for r in model.predict(query).collect()}
    assert found_y == pytest.approx(want_y, rel=1e-6)
    found: dict = {}
    for r in estimator.Classifier(**options).fit(context.drop("y"), "label", "id").predict_proba(query).collect():
        found.setdefault(r["query_id"], {})[r["label"]] = r["p"]
    assert set(found) == set(want_p) and all([found[k][c] for c in "abc"] == pytest.approx(list(want_p[k]), rel=1e-6) for k in found)
    assert estimator.Regressor().fit(context.drop("label").limit(0), "y", "id").predict(query).count() == 0


def test_rows_at_places_sort_only_their_parts_of_the_order(spark):
    from looma.operators import split

    rows = spark.range(20_000).select(F.lit("t").alias("table_id"), F.col("id").alias("row_idx"), F.col("id").alias("own"))
    want = {r["row_idx"]: r["own"] for r in split.number_rows(rows, 5).collect()}
    places = [0, 7, 7, 9_999, 19_999]
    found = {r["row_idx"]: r["own"] for r in split.rows_at(rows, spark.createDataFrame([(p,) for p in places], "row_idx long"), 5).collect()}
    assert set(places) <= set(found) and all(want[p] == x for p, x in found.items()) and len(found) < 50
    assert {r["row_idx"] for r in split.window_places(spark, 100, 30).collect()} == set(range(100))


def test_classifier_compares_each_tile_once_and_gives_final_answers_there(spark):
    from looma.plans.estimator import Classifier

    df = spark.createDataFrame([(i, float(i % 9), "abc"[i % 3]) for i in range(40)], "id long, x double, label string")
    plan = Classifier(bagging=2, max_context_size=20).fit(df, "label", "id").predict(df.drop("label"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and plan.index("FlatMapCoGroupsInArrow") == 0


@pytest.mark.parametrize("block", [1 << 22, 30])
def test_rows_that_share_a_key_are_answered_together(spark, monkeypatch, block):
    from looma.plans import estimator

    monkeypatch.setattr(estimator, "BLOCK", block)
    schema = "id long, x double, y double, t string"
    context = spark.createDataFrame([(i, float(i % 5), float(i % 7), "uv"[i % 2], "ab"[i % 4 // 2]) for i in range(24)], schema + ", label string")
    row = lambda i: (i, float(i % 4), float(i % 3), "uv"[i % 2])
    once, own = [row(i) for i in range(6)], (3, 9.0, 0.0, "u")
    model = estimator.Classifier(bagging=2, max_context_size=12).fit(context, "label", "id")
    p = lambda rows: {(r["query_id"], r["label"]): r["p"] for r in model.predict_proba(spark.createDataFrame(rows, schema)).collect()}
    want = p(once)
    assert len(want) == 12 and p([*once, row(3), row(5)]) == pytest.approx(want)
    both = p([*once, own])
    assert set(both) == set(want) and all(both[k] == pytest.approx(want[k]) for k in want if k[0] != 3)


def test_build_tasks_and_outputs(spark, tmp_path):
    rows = [(f"t{t}", i, float(i * (t + 1) % 17), "xyz"[i % 3], float(i)) for t in range(4) for i in range(40 if t else 5)]
    df = spark.createDataFrame(rows, "table_id string, row_idx long, x double, c string, z double")
    cells = to_cells(df, F.col("table_id"), F.col("row_idx"), ["x", "c", "z"])
    config = jobs.RunConfiguration(rules=profile.TableRules(min_rows=10), query_rows=(5, 9), max_rows=30, cell_text="s1", workers=2)
    specs, encoded = jobs.build_tasks(cells, config, embed.HashingEncoder(4), 4)
    s = specs.collect()
    assert {r["table_id"] for r in s} == {"t1", "t2", "t3"} and sum(r["is_regression"] for r in s) * 2 == len(s) and sorted(r["place"] for r in s) == list(range(len(s)))
    e = encoded.collect()
    for task in {r["task_id"] for r in e}:
        own = [r for r in e if r["task_id"] == task]
        assert len({r["row_idx"] for r in own}) == 30 and 5 <= len({r["row_idx"] for r in own if r["role"] == "query"}) <= 9
        assert all(r["value"] == -100 for r in own if r["kind"] == "target" and r["role"] == "query")
        assert all((r["text_vector"] is not None) == (r["kind"] == "number") for r in own)
    jobs.write_tasks(specs, encoded, str(tmp_path / "tasks"))
    assert spark.read.parquet(str(tmp_path / "tasks/cells")).count() == len(e)
    with pytest.raises(ValueError):
        jobs.build_tasks(cells, jobs.RunConfiguration(mode="other"), embed.HashingEncoder(4), 4)[1].count()
    shards.write_outputs(df, df.select("row_idx"), df.agg(F.count("x").alias("n")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/metrics.json")).first()["n"] == len(rows) and spark.read.option("header", True).csv(str(tmp_path / "out/predictions.csv")).count() == len(rows)


def test_big_tables_are_numbered_without_one_window(spark):
    df = spark.range(500).select(F.lit("t").alias("table_id"), (F.col("id") * 7_919_000_001 - 100).alias("row_idx")).withColumn("own", F.col("row_idx"))  # sparse keys
    for seed in (None, 3):
        placed = {r["own"]: r["row_idx"] for r in split.number_rows(df, seed).collect()}
        order = sorted(placed) if seed is None else [r["own"] for r in df.orderBy(core.h32(seed, F.col("table_id"), F.col("row_idx")), "row_idx").collect()]
        assert [placed[o] for o in order] == list(range(500))
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (1, 1, 1.0)], "a long, b long, similarity double")
    assert {tuple(r) for r in embed.symmetrised(pairs).collect()} == {(1, 2, 0.375), (2, 1, 0.375), (1, 1, 1.0)}
    with pytest.raises(ValueError):
        embed.bounded(spark.range(5), 4)


def test_sketches_decide_as_exact_counts(spark):
    rows = [(i, i % 20, i % 21, i % 62, i % 63, str(i % 400), str(i % 401), float(i % 3) if i % 2 else None, "one", None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k20 long, k21 int, k62 string, k63 string, share400 string, share401 string, half double, one string, nothing string")
    tasks_of = lambda p: {r["col_name"]: tuple(r)[1:] for r in p.select("col_name", profile.route().alias("new"), profile.route_legacy().alias("old"), "num_rows", "n_non_null").collect()}
    exact, found = profile.profile_table(df, "t"), profile.routing_profile(df, "t")
    assert tasks_of(found) == tasks_of(exact) and tasks_of(found)["share400"][1] == "classification" and tasks_of(found)["share401"][1] == "none"
    parts = profile.sketch_table(df.where("id % 2 = 0"), "t").unionByName(profile.sketch_table(df.where("id % 2 = 1"), "t"))
    merged = {r["col_name"]: r for r in profile.merge_sketches(parts).select("*", F.hll_sketch_estimate("sketch").alias("k")).collect()}
    for r in exact.collect():
        m = merged[r["col_name"]]
        assert (m["num_rows"], m["n_non_null"]) == (r["num_rows"], r["n_non_null"]) and abs(m["k"] - r["n_distinct"]) <= profile.SKETCH_ERROR * r["n_distinct"]
    wide = spark.range(300).select(*(F.pmod("id", F.lit(i + 1)).alias(f"c{i}") for i in range(200)))
    assert {r["col_name"]: r["n_distinct"] for r in profile.profile_table(wide, "w").collect()} == {f"c{i}": i + 1 for i in range(200)}


@pytest.mark.parametrize("pattern, history, part", [("ccccbrccbrrrcbc", 3, 2), ("b", 5, 2), ("cccc", 5, 2), ("rrrrrcbbccr", 50, 3), ("bbbb", 1, 1), ("rc" * 30, 4, 7)])
def test_replays_stand_where_a_running_loop_puts_them(spark, pattern, history, part):
    """r: a table with a regression target, c: a classification target, b: both (the order within a table alternates)."""
    rows = []
    for t, x in enumerate(pattern):
        kinds = {"r": [True], "c": [False], "b": [True, False] if t % 2 else [False, True]}[x]
        rows += [(f"t{t}", f"y{int(k)}", k, t, i) for i, k in enumerate(kinds)]
    specs = spark.createDataFrame(rows, "table_id string, target_column string, is_regression boolean, table_place long, position int")
    h = {(r["seq"], r["k"]): r["h"] for r in spark.range(200).crossJoin(spark.range(1, 100).withColumnRenamed("id", "k")).select(F.col("id").alias("seq"), "k", core.h32(9, F.col("id"), F.col("k")).alias("h")).collect()}
    want, past, count, seq = [], {True: [], False: []}, {True: 0, False: 0}, -1
    for t in range(len(pattern)):
        own = [r for r in rows if r[3] == t]
        for r in own:
            past[r[2]].append(r[:3])
        for r in own:
            seq += 1
            count[r[2]] += 1
            want.append((seq, False, *r[:3]))
            k = 0
            while count[True] != count[False]:
                rare = count[True] < count[False]
                if not past[rare]:
                    break
                k += 1
                pool = past[rare][-history:]
                want.append((seq, True, *pool[h[seq, k] % len(pool)]))
                count[rare] += 1
    found = sorted(tuple(r) for r in tasks.replay_places(specs, 9, history, part).select("place", "seq", "replay", "table_id", "target_column", "is_regression").collect())
    assert found == [(i, *w) for i, w in enumerate(want)]


def test_pack_shards_with_many_tables_in_a_bucket(spark):
    """Small tables by the ten thousand below one target: a window whose frame ends at its last row took minutes here."""
    n = 60_000
    t = spark.range(n).select(F.lit("c").alias("source_chunk"), F.format_string("p%06d", "id").alias("source_path"), F.col("id").cast("string").alias("table_id"), F.lit(1).cast("long").alias("size"))
    assert {r["shard"]: r["count"] for r in shards.pack_shards(t, 50_000).groupBy("shard").count().collect()} == {"shard-c-0000": 50_000, "shard-c-0001": 10_000}


def test_similarities_are_products_of_blocks(spark):
    """Odd vectors have none; both directions without a join of pairs, and no interpreted function for each pair."""
    rows = spark.createDataFrame([(0, "a", [1.0, 2.0]), (1, "b", None), (2, "b", [3.0]), (3, "c", [0.5, None]), (4, "c", [-1.0, 4.0])], "context_id long, label string, vector array<double>")
    asked = rows.select(F.col("context_id").alias("query_id"), "vector", F.lit("k").alias("kept"))
    pairs = embed.pairwise_similarity(asked, rows, "dot", keep=("kept",))
    found = {(r["query_id"], r["context_id"]): r["similarity"] for r in pairs.collect()}
    assert found == {(i, j): {(0, 0): 5.0, (0, 4): 7.0, (4, 0): 7.0, (4, 4): 17.0, (2, 2): 9.0}.get((i, j)) for i in range(5) for j in range(5)}
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert embed.pairwise_similarity(asked, rows.limit(0), "dot").count() == 0
    both = embed.symmetrised_products(spark.createDataFrame([(0, [1.0, 0.0], [2.0, 5.0]), (1, [3.0, 1.0], [7.0, 1.0])], "id long, left array<double>, right array<double>"))
    assert {(r["a"], r["b"]): r["similarity"] for r in both.collect()} == {(0, 0): 2.0, (0, 1): 9.0, (1, 0): 9.0, (1, 1): 22.0}


def test_quantiles_are_those_of_percentile(spark):
    rows = spark.range(3000).select((F.col("id") % 4).cast("string").alias("k"), F.when(F.col("id") % 4 == 3, None).when(F.col("id") % 7 != 0, (F.col("id") * 7919 % 1013) / 3.0 - 99).alias("x"))
    points = [0.02, 0.25, 0.5, 0.98, 1.0]
    rows = rows.withColumn("k", F.when(F.col("k") != "2", F.col("k")))
    found = encode.quantiles(rows, ["k"], "x", points)
    want = rows.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("q"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 4
    assert "percentile(" not in encode.standard_scale(rows.withColumn("role", F.lit("context")), ["k"])._jdf.queryExecution().executedPlan().toString().lower()


def test_cells_of_tasks_are_read_once(spark, tmp_path):
    """The plan of the encoded cells reads what has been written, not the given table once for every branch."""
    spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("double").alias("y"), (F.col("id") * 0.5).alias("x"), F.concat(F.lit("w"), F.col("id") % 5).alias("t")).write.parquet(str(tmp_path / "given"))
    given = to_cells(spark.read.parquet(str(tmp_path / "given")), (F.col("id") % 4).cast("string"), F.col("id"), ["x", "t", "y"])
    specs, encoded = jobs.build_tasks(given, jobs.RunConfiguration(), embed.HashingEncoder(4), 4)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "(id" not in plan and "explode" not in plan.lower() and encoded.count() > 0 and specs.count() > 0


def test_summaries_do_not_depend_on_blocks(monkeypatch):
    """Ids that repeat more often than a block has rows, and vectors of two lengths."""
    x = np.array([[(i * 7 + k * 5) % 11 - 5.0 for k in range(2)] for i in range(24)])
    similarity = lambda a, b: (a @ b[:, ::-1].T * a[:, :1], a @ b[:, ::-1].T * b[:, 0])
    tiles = [(np.array(sorted([*range(8), 3, 3, 3, 3, 5, 6])), x[:14]), (np.arange(100, 110), x[14:])]
    whole = [embed._summarised(t, similarity) for t in (tiles, tiles[:1], tiles[1:])]
    monkeypatch.setattr(embed, "BLOCK", 3)
    assert embed._blocks(np.array([0, 1, 2, 3, 8, 9]), 11) == [(slice(0, 3), slice(0, 3)), (slice(3, 8), slice(3, 4)), (slice(8, 11), slice(4, 6))]
    small = [embed._summarised(t, similarity) for t in (tiles, tiles[:1], tiles[1:])]
    assert [[b.to_pydict() for b in t] for t in small] == [[b.to_pydict() for b in t] for t in whole]


def test_summaries_of_two_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, [0.5, 1.0]), (4, [2.0])], "id long, vector array<double>")
    for tile in (1, 100):
        found = {r["id"]: (r["mean"], r["top"]) for r in embed.symmetrised_summary(rows, lambda a, b: (a @ b.T * a[:, :1], a @ b.T * b[:, 0]), tile).collect()}
        assert found == {1: ((5.0 + 2.5 * 0.75) / 2, 5.0), 3: ((2.5 * 0.75 + 0.625) / 2, 1.875), 2: ((27.0 + 15.0) / 2, 27.0), 4: ((15.0 + 8.0) / 2, 15.0)}
