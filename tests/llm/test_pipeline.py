"""The pipeline, and every stage on its own input, against plain versions of their decisions."""

import corpus_pipeline as cp
from looma.llm import bpe, toxicity
from looma.llm.common import table, written
from tests.llm.test_joins import roots, shingles


def test_stages(spark, data):
    d = table(spark, data, "documents")
    columns = d.columns
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in d.collect()}
        out = written(stage(spark, d, data), name)
        after = {r["doc_id"]: r for r in out.collect()}
        if name == "toxicity":
            score = toxicity.scorer(toxicity.fit(d, table(spark, data, "labels")))
            ids = sorted(before)
            assert set(after) == {i for i, p in zip(ids, score([before[i] for i in ids]), strict=True) if p < 0.5}
        elif name == "jaccard_join":
            ids = sorted(before)
            sets = [shingles(before[i]) for i in ids]
            pairs = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            assert set(after) == {ids[r] for r in roots(len(ids), pairs)}
        elif name == "decontamination":
            norm = lambda t: " ".join(t.lower().split())
            items = [norm(r["text"]) for r in table(spark, data, "benchmark").collect()]
            leaked = {i for i, t in before.items() if any(x in norm(t) for x in items)}
            assert not leaked & set(after)
        elif name == "pii":
            assert set(after) == set(before) and all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name != "bpe":
            assert out.columns == columns
        d = out
    codec = bpe.Codec(bpe.vocabulary())
    final = {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, data).collect()}
    assert final == {i: len(codec.encode(before[i])) // 4 for i in before}
    assert cp.ORACLE_SQL is None and len(cp.STAGES) == 5
