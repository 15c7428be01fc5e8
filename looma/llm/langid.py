"""Language identification by hierarchical discrimination.

Character n-grams of words (hashed) are averaged over a text. A softmax classifier first gives the family; within it
one-versus-one linear support vector machines (squared hinge) separate its languages by votes. All of it is linear in the
average, so a word carries one number for each classifier, computed once and cached; the weights have a fixed size and go
to the tasks. No text is shuffled.

Training reads a bounded sample: every language, at most `PER_LANG` texts of each (fewer beyond `MAX_TEXTS` in all), in
the order of a hash of the id, read after the ids are chosen; short stretches of them are added, for short texts.
Defined results: a null text or one without letters is `und` with score 0; rows with null lang teach nothing; without any
labelled text everything is `und`; with one language all is that one, score 1. Repeated rows stay; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import class_of, crc_mod, fitting, map_batches, table
from .subword import WordValues, grams

BUCKETS, GRAMS, PER_LANG, MAX_TEXTS, MAX_CHARS = 1 << 13, (1, 2, 3), 250, 16_000, 8_000_000
ASCII_LETTER = re.compile("[A-Za-z]")
SLICE = 200
# Languages (ISO 639-1) of the families; a code that is in none is of the family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr uz",
    "semitic": "am ar he mt",
}


def family(lang: str) -> str:
    base = re.split(r"[-_]", lang.lower())[0]
    return next((f for f, langs in FAMILIES.items() if base in langs.split()), "other")


def has_letters(text: str) -> bool:
    """Whether a code point of the Unicode categories L is in the text."""
    return bool(ASCII_LETTER.search(text) or (not text.isascii() and re.search(f"[{class_of('L')}]", text)))


def counts(texts: list[str]) -> np.ndarray:
    """Average n-gram vectors of texts."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        if chunks := t.lower().split():
            gram, _ = grams(chunks, GRAMS, BUCKETS)
            x[i] = np.bincount(gram, minlength=BUCKETS) / len(gram)
    return x


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-6, steps: int = 100) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge machine by accelerated gradient steps; y is 1 or -1."""
    n = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    scale = 2 * float(np.linalg.norm((x * np.sqrt(n)[:, None]), ord="fro") ** 2) + 2
    w = v = np.zeros(x.shape[1] + 1)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1].astype(np.float32) + v[-1]))
        g = -2 * n * y * slack
        grad = np.append(g.astype(np.float32) @ x + reg * v[:-1], g.sum())
        new = v - grad / scale
        v, w = new + k / (k + 3) * (new - w), new
    return w


def _softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 120) -> np.ndarray:
    n = 1 / (k * np.bincount(y, minlength=k).clip(1)[y])
    scale = 0.5 * float(np.linalg.norm((x * np.sqrt(n)[:, None]), ord="fro") ** 2) + 0.5
    w = v = np.zeros((x.shape[1] + 1, k))
    goal = np.eye(k)[y]
    for i in range(steps):
        z = x @ v[:-1].astype(np.float32) + v[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - goal) * n[:, None]
        new = v - (np.vstack([(d.T.astype(np.float32) @ x).T, d.sum(0)]) + 1e-7 * v) / scale
        v, w = new + i / (i + 3) * (new - w), new
    return w


def train(texts: list[str], langs: list[str], seed: int = 11) -> dict:
    names = sorted(set(langs))
    fams = sorted({family(x) for x in names})
    rng = np.random.default_rng(seed)
    more = []
    for t in texts:
        chunks = t.split()
        for n in (4, 12):
            at = int(rng.integers(0, max(1, len(chunks) - n + 1)))
            more.append(" ".join(chunks[at : at + n]))
    y = np.array([names.index(x) for x in langs] * 1 + [names.index(x) for x in langs for _ in (0, 1)], int)
    x = counts([*texts, *more]) if texts else np.zeros((0, BUCKETS), np.float32)
    keep = x.any(1)
    x, y = x[keep], y[keep]
    spread = x.std(0) + 1e-4 if len(x) else np.ones(BUCKETS)  # rare n-grams count as much as frequent ones
    x /= spread.astype(np.float32)
    norm = float(np.median(np.linalg.norm(x, axis=1))) if len(x) else 1.0
    x /= norm
    fam = np.array([fams.index(family(n)) for n in names], int)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if fam[i] == fam[j]]
    columns = []
    if len(fams) > 1:
        columns += list(_softmax(x, fam[y], len(fams)).T * 4)
    for i, j in pairs:
        own = (y == i) | (y == j)
        columns.append(_svm(x[own], np.where(y[own] == i, 1.0, -1.0)))
    weights = np.stack(columns) if columns else np.zeros((0, BUCKETS + 1))
    weights[:, :-1] /= spread * norm
    return {"names": names, "families": fams, "family": fam.tolist(), "pairs": pairs, "weights": weights.astype(np.float32)}


def decide(model: dict, z: np.ndarray) -> tuple[str, float]:
    """Language and score (0 to 1) from the values of all classifiers."""
    names, fams, fam = model["names"], model["families"], model["family"]
    k = len(fams) if len(fams) > 1 else 0
    p = 1.0
    best = 0
    if k:
        e = np.exp(z[:k] - z[:k].max())
        best = int(e.argmax())
        p = float(e[best] / e.sum())
    members = [i for i, f in enumerate(fam) if f == best]
    won, sure = dict.fromkeys(members, 0.0), dict.fromkeys(members, 1.0)
    for (i, j), m in zip(model["pairs"], z[k:], strict=True):
        if fam[i] == best:
            s = 1 / (1 + np.exp(-4 * float(m)))
            for who, q in ((i, s), (j, 1 - s)):
                won[who] += (q > 0.5) + q / 1000
                sure[who] = min(sure[who], q)
    top = max(members, key=lambda i: (won[i], -i))
    return names[top], min(1.0, max(0.0, p * sure[top]))


def predictor(model: dict):
    """Function of a list of texts -> (languages, scores)."""
    weights = model["weights"].astype(float)

    def compute(chunks: list[str]) -> np.ndarray:
        gram, owner = grams(chunks, GRAMS, BUCKETS)
        return np.stack([*(np.bincount(owner, w[gram], len(chunks)) for w in weights[:, :-1]), np.bincount(owner, minlength=len(chunks))], 1)

    known = WordValues(compute, len(weights) + 1)

    def few(texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for text, at in zip(texts, known.of([(t or "").lower().split() for t in texts]), strict=True):
            if not model["names"] or not text or not has_letters(text):
                out.append(("und", 0.0))
            else:
                total = known.rows[at].sum(0)
                out.append(decide(model, total[:-1] / total[-1] + weights[:, -1]))
        return out

    return lambda texts: [x for i in range(0, len(texts), SLICE) for x in few(texts[i : i + SLICE])]


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> dict:
    """The model from texts and languages of documents whose crc32(doc_id) mod 5 is not 0."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id")) != 0))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return train([], [])
    per_lang, budget = max(1, min(per_lang, MAX_TEXTS // len(n))), max(1, max_chars // len(n))
    # ids whose hash is small, about twice as many of each language as are wanted, then the first of them
    share = F.create_map([x for lang, c in n.items() for x in (F.lit(lang), F.lit(min(1.0, (2 * per_lang + 20) / c)))])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = known.where(F.col("lang").isin(list(n))).withColumn("h", h).where(F.col("h") <= share[F.col("lang")] * float(1 << 30))
    first = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    ids = spark.createDataFrame([(r["doc_id"],) for r in some.withColumn("rn", first).where(F.col("rn") <= per_lang).select("doc_id").collect()], "doc_id long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(ids), "doc_id").where("text is not null and lang is not null")
    sizes = rows.select("doc_id", "lang", F.length("text").alias("n")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).limit(per_lang * len(n)).collect()
    small = spark.createDataFrame([(r["doc_id"],) for r in fitting(sizes, "lang", budget)], "doc_id long")
    few = {r["doc_id"]: (r["text"], r["lang"]) for r in rows.join(F.broadcast(small), "doc_id").withColumn("text", F.substring("text", 1, budget)).collect()}
    order = [i for i in sorted(few) if has_letters(few[i][0])]
    return train([few[i][0] for i in order], [few[i][1] for i in order])


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        run = predictor(shared.value)

        def batch_of(batch: pa.RecordBatch) -> dict:
            found = run(batch.column(1).to_pylist())
            return {"doc_id": batch.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([p for _, p in found], pa.float64())}

        return batch_of

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
