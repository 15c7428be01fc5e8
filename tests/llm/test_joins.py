"""Brute force against the operators that compare documents or vectors with one another."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from looma.llm import embed_dedup, graph, ngram_join, suffix_dedup
from tests.llm.test_text_operators import EDGE, docs


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(t):
    w = (t or "").encode().lower().split()
    if len(w) >= 5:
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {tuple(w)} if w else set()


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = [" ".join(word() for _ in range(20)) for _ in range(5)]
    base = [[word() for _ in range(60)] for _ in range(6)]
    texts = list(EDGE)
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [f"{rng.choice(line)} {rng.choice(line)}" for _ in range(40)] + [" ".join(word() for _ in range(30)) + " " + line[0] for _ in range(20)]
    return texts


def test_jaccard_components(spark):
    texts = corpus(random.Random(8))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(texts), pairs)
    d = docs(spark, texts).repartition(3)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_documents(d).collect()}
    assert out == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    clash = d.withColumnsRenamed({"score": "gone_id", "ids": "rep"})
    kept = ngram_join.one_of_each(clash)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == set(want)
    odd = d.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    assert ngram_join.join_documents(odd).count() == 0 and ngram_join.join_documents(d.limit(0)).count() == 0


def test_jaccard_rows_that_repeat_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(2, a), (5, a), (5, b), (5, ""), (7, b), (8, None), (8, None), (9, "x"), (9, "x")]
    out = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == [(2, 26, 2), (5, 0, 2), (5, 26, 2), (5, 26, 2), (7, 26, 2), (8, 0, 8), (8, 0, 8), (9, 1, 9), (9, 1, 9)]


@pytest.mark.parametrize("owners", [[0, 0, 3], [5] * 300, list(range(1000)), []])
def test_packed_owners(owners):
    x = np.array(owners, np.int64)
    assert not len(x) or ngram_join._unpacked(ngram_join._packed(x, 1000)).tolist() == owners


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)], [(5, 9), (9, 2), (7, 8), (3, 3)]])
def test_components(spark, edges):
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots(60, edges)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(out) == nodes and all((out[a] == out[b]) == (want[a] == want[b]) for a in nodes for b in nodes)


def removed(rows):
    seen, out = {}, []
    for doc, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if seen.setdefault(b[s : s + 100], (doc, s)) != (doc, s):
                gone[s : s + 100] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((doc, len(b), len(b) - len(kept), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark):
    rng = random.Random(9)
    passage = ["".join(rng.choice("abcdé ") for _ in range(150)) for _ in range(4)]
    texts = [None, "", "short", "ab" * 300, "a" * 500, "a" * 120, "x" * 3000] + ["".join(rng.choice([rng.choice(passage), "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 200)))]) for _ in range(6)) for _ in range(40)]
    d = docs(spark, texts, first=-3).repartition(3)
    rows = [tuple(r) for r in suffix_dedup.remove_repeats(d, texts=False).orderBy("doc_id").collect()]
    assert rows == removed([(i - 3, t) for i, t in enumerate(texts)])
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0 and "kept" in suffix_dedup.remove_repeats(d).columns


def test_repeated_strings_of_rows_that_repeat_an_id(spark):
    rng = random.Random(4)
    p, u, v = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(3))
    rows = [(0, p), (1, p + "zz"), (1, u), (3, v), (3, v), (3, v + v), (4, v)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), texts=False).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in out) == [(0, 150, 0), (1, 150, 0), (1, 152, 150), (3, 150, 0), (3, 150, 0), (3, 300, 150), (4, 150, 150)]


def test_windows_of_one_hash_are_compared(monkeypatch):
    data = np.frombuffer(b"".join(bytes(random.Random(i).choices(b"ab", k=130)) for i in (1, 2, 1)), np.uint8)
    place = np.concatenate([np.arange(31) + 130 * i for i in range(3)])
    want = suffix_dedup._alike(data, place)
    monkeypatch.setattr(suffix_dedup, "rolling", lambda d, k: np.arange(len(d) - k + 1).astype(np.uint64) % 7)
    order, head = suffix_dedup._alike(data, place)
    kinds = lambda o, h: {frozenset(o[h == x].tolist()) for x in set(h.tolist())}
    assert kinds(order, head) == kinds(*want)


@pytest.mark.parametrize("tile", [8192, 64])
def test_vectors(spark, tile):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    for i in range(100, 200):
        x[i] = x[i % 10] + rng.normal(size=16) * 0.15
    x[200:240] = x[0] * np.linspace(0.5, 2, 40)[:, None]
    rows = [(i, [float(a) for a in v], 0, 5) for i, v in enumerate(x)] + [(300, None, 0, 5), (301, [0.0] * 16, 0, 5), (302, [float("nan")] * 16, 0, 5), (303, [None] * 16, 0, 5), (304, [1.0, 2.0], 0, 5), (305, [], 0, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    want = roots(306, list(zip(*np.nonzero(near), strict=True)))
    out = {r["vec_id"]: tuple(r)[1:] for r in embed_dedup.near_duplicates(df, tile=tile).collect()}
    assert out == {i: (int(near[i].sum()) if i < 300 else 0, want[i], want[i] == i) for i in range(306)}
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_rows_without_or_with_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.1]), (3, [0.1, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0, 0.1, 0.0])]
    out = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 2, 1, True)] * 3 + [(2, 1, 1, False), (3, 1, 1, False), (7, 1, 7, True), (8, 1, 7, False)]


def test_vectors_at_the_threshold_do_not_depend_on_their_tile(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(1, 8)), 3000, axis=0) * rng.uniform(0.5, 2, (3000, 1))
    y = embed_dedup._unit(x)
    cosine = np.einsum("ij,ij->i", y[:1000], y[1000:2000])
    ids = np.arange(len(y))
    for threshold in (float(np.median(cosine)), 1.0):
        whole, _, _ = embed_dedup.compare(ids, y, ids, y, np.eye(8), threshold, True)
        want = np.array([np.einsum("ij,ij->i", np.repeat(y[i : i + 1], len(y), 0), y) >= threshold for i in range(0, 3000, 100)])
        assert (whole[::100] == want.sum(1) - want[np.arange(30), np.arange(0, 3000, 100)]).all()
