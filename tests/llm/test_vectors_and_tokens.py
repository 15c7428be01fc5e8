"""Whitening, nearest neighbours and token alignment against brute force."""

import hashlib
import heapq
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from looma.llm import rp_forest, token_align, whiten
from looma.llm.registry import QUERIES
from tests.llm.test_text_operators import EDGE, docs

NONE, NAN, INF = None, float("nan"), float("inf")


def vectors(spark, rows, kind="double"):
    """embeddings with columns whose names clash with those of results."""
    return spark.createDataFrame([(i, v, 0, 7, 8) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, n int, rank int")


def whitened(rows):
    """The definition, with exact fractions up to the eigenvectors."""
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows], object)
    n, total = len(x), x.sum(0)
    y = n * x - total
    v = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return n, (y * y).sum(1), (y.astype(float) / n) @ axes, values, np.trace(v)


def test_whitening_equals_the_definition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 10)) @ rng.normal(size=(10, 10))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (5, x[6].tolist()), (NONE, x[7].tolist())]
    bad = [(900, NONE), (901, [NONE] * 10), (902, [NAN] * 10), (903, [INF] + [0.0] * 9), (904, []), (905, [1.0, 2.0])]
    out = whiten.whiten(vectors(spark, rows + bad).repartition(5)).collect()
    n, deviation, turned, values, trace = whitened(rows)
    assert len(out) == 8 * n and {r["vec_id"] for r in out} == {i for i, _ in rows} and {r["n"] for r in out} == {n}
    assert sorted(r["deviation"] for r in out if r["component"] == 1) == sorted(deviation.tolist()) == sorted(int(r["deviation_exact"]) for r in out if r["component"] == 2)
    by = {(r["vec_id"], r["component"]): r for r in out}
    for k in range(8):
        own = np.array([by[i, k + 1]["whitened"] for i in range(10, 300)])
        want = turned[10:300, k] / values[k] ** 0.5
        assert np.abs(own * np.sign(own @ want) - want).max() < 1e-9 and abs(by[0, k + 1]["explained"] - values[k] / trace) < 1e-12
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e9, 1e300])
def test_square_sums_are_exact_at_every_size(scale):
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.clip(rng.normal(size=(50, 5)) * scale, -whiten.MOST, whiten.MOST)).astype(np.int64) + whiten.SHIFT
    n, total = 10**7, [int(s) for s in x.sum(0)]
    y = whiten.centred(x, n, total)
    assert (y.astype(object) == n * x.astype(object) - np.array(total, object)).all()
    for i, found in enumerate(whiten.square_sums(y)):
        for k, q in enumerate(found):
            z = y[:, i].astype(object) + (y[:, i + k].astype(object) if k else 0)
            assert int(q) == sum(int(a) ** 2 for a in z)


def test_whitening_of_few_or_equal_rows(spark):
    assert whiten.whiten(vectors(spark, [(1, NONE)])).count() == 0
    one = whiten.whiten(vectors(spark, [(1, [1.0, 2.0])])).orderBy("component").collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    line = whiten.whiten(vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(5)], "float")).collect()
    assert {r["whitened"] is None for r in line if r["component"] == 2} == {True} and all(r["identity_error"] < 1e-9 for r in line)
    assert abs(np.std([r["whitened"] for r in line if r["component"] == 1]) - 1) < 1e-9
    huge = whiten.whiten(vectors(spark, [(i, [(-1.0) ** i * 1e300, 0.0]) for i in range(4)])).collect()
    assert {r["deviation"] for r in huge} == {None} and {int(r["deviation_exact"]) for r in huge} == {(4 * 1024 * 2**40) ** 2}


def brute(rows, k):
    """query -> [(score, id)] of the k nearest."""
    own = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    wide = max((len(v) for _, v in own), default=0)
    x = np.array([v + (0.0,) * (wide - len(v)) for _, v in own])
    out = {}
    for (q, _), v in zip(own, x, strict=True):
        if q % rp_forest.EVERY == 0:
            s = np.einsum("ij,ij->i", np.broadcast_to(v, x.shape), x)
            out[q] = sorted((-a, i) for a, (i, _) in zip(s.tolist(), own, strict=True) if i != q)[:k]
    return out


def test_neighbours_of_few_rows_are_all_candidates(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(30, 6)), 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100 + i, x[0].tolist()) for i in range(30)] + [(40, x[3].tolist())] * 3
    bad = [(60, NONE), (80, [0.0] * 6), (140, [NAN] + [1.0] * 5), (160, [NONE] * 6), (NONE, x[1].tolist()), (180, []), (200, [3.0, 1.0])]
    out = rp_forest.nearest(vectors(spark, rows + bad).repartition(4))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert found == brute(rows + bad, 20) and set(found) == {0, 20, 40, 100, 120, 200}
    few = rp_forest.nearest(vectors(spark, rows[:6])).collect()
    assert len(few) == 5 and [r["rank"] for r in few] == [1, 2, 3, 4, 5]
    assert rp_forest.nearest(vectors(spark, bad[:4])).count() == 0 and rp_forest.nearest(vectors(spark, [(20, [1.0])])).count() == 0


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_neighbours_reach_the_recall(spark, spread):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)) + spread * rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)]
    x[1000:1900] = x[7]  # copies of a third
    x *= rng.uniform(0.5, 2, (3000, 1)) if spread else 1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = rp_forest.nearest(vectors(spark, rows).repartition(4), tile=256, recall=0.97).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    want = brute(rows, 20)
    assert found.keys() == want.keys() and all(len(v) == 20 and v == sorted(v) for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_queue_pops_as_a_heap_does():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8))
    forest = rp_forest.Forest(8, float(np.linalg.norm(x, axis=1).max()), 4, trees=3).fit(x)
    r, q = forest.directions(), x[:20] / np.linalg.norm(x[:20], axis=1, keepdims=True)
    for i, popped in enumerate(forest.search(x[:20], r, 9)):
        heap, out = [(0.0, t, 0) for t in range(3)], []
        while len(out) < 9:
            cost, t, node = heapq.heappop(heap)
            if node >= forest.nodes:
                out.append(t * forest.leaves_per_tree + node - forest.nodes)
                continue
            m = rp_forest.SLOPE * 8**0.5 * (r[t, node, :-1] @ q[i] - forest.thresholds[t, node])
            for side, sign in ((1, 1), (2, -1)):
                heapq.heappush(heap, (cost + np.logaddexp(0, sign * m), t, 2 * node + side))
        assert set(out) == set(popped.tolist())
    assert (np.bincount(forest.leaves(x, r)[:, 0], minlength=16) > 20).all()


def aligned(texts):
    """Groups by the sets of ends, links one by one."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = token_align.vocabularies()
    t = token_align.Tokens(path_a, path_b)
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    rows, held = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        data = (" " + (text or "")).encode()
        if b"".join(t.bytes_a[i] for i in x) != data or b"".join(t.bytes_b[i] for i in y) != data:
            x, y = [], []
        ends_a, ends_b = np.cumsum([0] + [len(t.bytes_a[i]) for i in x]), np.cumsum([0] + [len(t.bytes_b[i]) for i in y])
        cuts = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        groups = [(x[at_a[p] : at_a[q]], y[at_b[p] : at_b[q]]) for p, q in zip(cuts, cuts[1:], strict=False)]
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        held.update(set(links))
        rows.append((x, y, groups, links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for x, y, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    letters = "ab the isΣßéÉ'st'll123²½!?.-_  \n\t\r\x1c\x85\xa0 漢字🙂<s>▁"
    texts = [*(t[:3000] if t else t for t in EDGE), " ", "  ", "a ", " a\n", "<|endoftext|> x", "\x00", "ﬁ ½ Å", "many words of one long text, " * 200]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    want = aligned(texts)
    for batch, block in ((token_align.BATCH, token_align.BLOCK), (500, 900)):
        monkeypatch.setattr(token_align, "BATCH", batch)
        monkeypatch.setattr(token_align, "BLOCK", block)
        out = token_align.align(docs(spark, texts).repartition(3))
        assert out.columns == ["doc_id", *COLUMNS] and dict(out.dtypes)["count_sum"] == "bigint"
        assert {r["doc_id"]: tuple(r)[1:] for r in out.collect()} == dict(enumerate(want))
    assert token_align.align(docs(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(NONE, "the cat"), (7, "the cat"), (7, "the cat"), (7, NONE)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, *tuple(r)[1:]) for r in token_align.align(odd).collect()) == sorted((i, *w) for i, w in zip((-1, 7, 7, 7), aligned(["the cat", "the cat", "the cat", NONE]), strict=True))


def test_groups_without_a_common_end_are_counted_by_ids():
    rng = np.random.default_rng(4)
    sizes = [(3, 2), (1, 1), (40, 30), (2, 1), (9, 9)]
    last_a, last_b = np.cumsum([s for s, _ in sizes]) - 1, np.cumsum([s for _, s in sizes]) - 1
    a, b = rng.integers(0, 5, last_a[-1] + 1), rng.integers(0, 4, last_b[-1] + 1)
    doc = np.array([0, 0, 1, 1, 3])
    d, pair, times = token_align.linked(a, b, last_a, last_b, doc, 10)
    want = Counter()
    for g, (p, q) in enumerate(zip(last_a, last_b, strict=True)):
        for i in a[p + 1 - sizes[g][0] : p + 1]:
            for j in b[q + 1 - sizes[g][1] : q + 1]:
                want[int(doc[g]), int(i * 10 + j)] += 1
    assert list(zip(d.tolist(), pair.tolist(), times.tolist(), strict=True)) == [(*k, n) for k, n in sorted(want.items())]


@pytest.mark.parametrize("name", ["op11_whiten", "op12_rp_forest", "op13_token_align"])
def test_queries_run_on_the_given_tables(spark, data, name):
    out = QUERIES[name](spark, data).toPandas()
    if name == "op11_whiten":
        assert len(out) % 8 == 0 and out.identity_error.max() < 1e-4
    elif name == "op12_rp_forest":
        assert set(out.groupby("query_id").size()) == {20}
    else:
        texts = [r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()]
        assert [tuple(r) for r in out.sort_values("doc_id")[list(COLUMNS)].itertuples(index=False)] == aligned(texts)
