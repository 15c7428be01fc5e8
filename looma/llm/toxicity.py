"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed), so a misspelling never seen shares most vectors with
its model. Word vectors are averaged over windows of a few words into a two-class linear softmax; a text's logit pools its
windows by a soft maximum, so that one insult in a long text is not averaged away. Vectors and softmax are trained jointly
from the labels of texts. With two classes the softmax is a logistic in the difference of its rows, and the mean over a
window is linear, so scoring needs one number for each n-gram; these (a fixed number of buckets) go to the tasks. Training
takes mini-batches of texts and holds vectors only for n-grams of several texts.

Training reads a bounded sample: at most `PER_CLASS` labelled texts of each class and half of `MAX_CHARS` characters a class,
in the order of a hash of the id; texts that do not fit are skipped. One task trains on it, so that the driver holds no
text. Scoring reads every whole text and shuffles none.
Defined results: null and empty texts and texts without words get the score of an empty text, which is below 0.5; null or
repeated labels: nulls are left out, the largest of several counts; without labels of both classes every score is the base
rate, at most 0.49; repeated rows stay; other columns are kept by `reject` and ignored by `score`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fitting, map_batches, table
from .subword import WordValues, core, grams

BUCKETS, DIM, GRAMS, WINDOW = 1 << 19, 8, (3, 4, 5, 6), 5
PER_CLASS, MAX_CHARS = 2000, 6_000_000
SLICE, LEAST_TEXTS, DECAY = 200, 3, 1e-5
EPOCHS, BATCH, LEAST_STEPS, RATE = 8, 200, 100, 0.05


def _pool(z: np.ndarray, starts: np.ndarray, of: np.ndarray, sharp: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft maximum of each text's windows, and the share of each window in it."""
    top = np.maximum.reduceat(z, starts)
    e = np.exp(sharp * (z - top[of]))
    total = np.add.reduceat(e, starts)
    n = np.diff(np.append(starts, len(z)))
    return top + np.log(total / n) / sharp, e / total[of]


def _slips(text: str, rng: np.random.Generator) -> str:
    """The text with one character of most words swapped, doubled or left out: the n-grams that such slips leave whole
    learn to carry the label alone."""
    chunks = text.lower().split()
    kinds, places = rng.integers(0, 4, len(chunks)), rng.random(len(chunks))
    for i, (w, k) in enumerate(zip(chunks, kinds, strict=True)):
        if k and len(w) > 3:
            j = 1 + int(places[i] * (len(w) - 2))
            chunks[i] = w[:j] + ("0" if k == 1 else w[j] * 2 if k == 2 else "") + w[j + 1 :]
    return " ".join(chunks)


def _word_grams(words: list[str], texts_with: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of n-grams that are in LEAST_TEXTS texts or more (those of fewer say nothing about others and stay at
    zero); for every word the places of its n-grams among them, as offsets and values; how many n-grams a word has in all."""
    parts = range(0, len(words), 20_000)
    often = np.zeros(BUCKETS)
    for i in parts:
        gram, owner = grams(words[i : i + 20_000], GRAMS, BUCKETS)
        often += np.bincount(gram, texts_with[i : i + 20_000][owner], BUCKETS)
    buckets = np.flatnonzero(often >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets), dtype=np.int32)
    values, sizes, every = [], [], []
    for i in parts:
        gram, owner = grams(words[i : i + 20_000], GRAMS, BUCKETS)
        n = len(words[i : i + 20_000])
        every.append(np.bincount(owner, minlength=n).astype(np.float32))
        order = np.argsort(owner, kind="stable")
        at = place[gram[order]]
        sizes.append(np.bincount(owner[order][at >= 0], minlength=n))
        values.append(at[at >= 0])
    return buckets, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(values), np.concatenate(every)


class _Batch:
    """Some training texts: their words once each, with their n-grams, and the windows of the texts."""

    def __init__(self, pieces: list[np.ndarray], offsets: np.ndarray, values: np.ndarray, every: np.ndarray):
        n = np.array([len(p) for p in pieces])
        words, self.tokens = np.unique(np.concatenate(pieces), return_inverse=True)
        size = offsets[words + 1] - offsets[words]
        self.gram = values[np.repeat(offsets[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.owner, self.count = np.repeat(np.arange(len(words)), size), every[words]
        # windows: one starts at each word that has WINDOW - 1 followers in its text, or at the first of a shorter text
        wins = np.maximum(n - WINDOW + 1, 1)
        self.starts = np.concatenate([[0], np.cumsum(wins)])[:-1]
        self.of = np.repeat(np.arange(len(n)), wins)
        self.first = np.repeat(np.cumsum(n) - n - self.starts, wins) + np.arange(wins.sum())
        self.width = np.minimum(WINDOW, n)[self.of]

    def windows(self, q: np.ndarray) -> np.ndarray:
        s = np.bincount(self.owner, q[self.gram], len(self.count)) / self.count
        run = np.concatenate([[0], np.cumsum(s[self.tokens])])
        return (run[self.first + self.width] - run[self.first]) / self.width * WINDOW

    def gradient(self, dz: np.ndarray, size: int) -> np.ndarray:
        """Of a loss with derivatives dz by the windows: its derivatives by the n-grams' numbers."""
        dz, n = dz / self.width * WINDOW, len(self.tokens)
        delta = np.bincount(self.first, dz, n + 1) - np.bincount(self.first + self.width, dz, n + 1)
        ds = np.bincount(self.tokens, np.cumsum(delta)[:-1], len(self.count)) / self.count
        return np.bincount(self.gram, ds[self.owner], size)


def train(texts: list[str], labels: list[int], rate: float, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """N-gram scores, bias and scale. rate: the share of label 1 among all labels, to which the bias is set. The texts are
    taken in batches of BATCH, so memory beside their words is that of a batch."""
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    pieces: list[np.ndarray] = []
    marks: list[int] = []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        for version in (text, _slips(text, rng)) if i % 3 == 0 else (text,):
            own = np.array([vocab.setdefault(c, len(vocab)) for w in version.lower().split() if (c := core(w))], np.int32)
            if len(own):
                pieces.append(own)
                marks.append(label)
    if len(set(marks)) < 2:
        return {"q": np.zeros(BUCKETS, np.float32), "bias": float(np.log(min(rate, 0.49) / (1 - min(rate, 0.49)))) if rate > 0 else -4.0, "scale": 1.0}
    texts_with = np.zeros(len(vocab))
    for own in pieces:
        texts_with[np.unique(own)] += 1
    buckets, offsets, values, every = _word_grams(list(vocab), texts_with)
    del vocab
    y = np.array(marks, float)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    test = np.arange(len(y)) % 5 == 0
    train_on = np.flatnonzero(~test)
    steps = max(1, -(-len(train_on) // BATCH))
    size = len(buckets)
    vectors, u, bias = rng.normal(0, 0.1, (size, DIM)).astype(np.float32), rng.normal(0, 0.5, DIM).astype(np.float32), 0.0
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, u, np.zeros(1, np.float32))]
    total, k = max(epochs, LEAST_STEPS // steps) * steps, 0
    while k < total:
        for part in np.array_split(rng.permutation(train_on), steps):
            batch = _Batch([pieces[i] for i in part], offsets, values, every)
            sharp = 0.5 + 4.5 * min(1.0, k / (0.6 * total))
            pooled, share = _pool(batch.windows(vectors @ u), batch.starts, batch.of, sharp)
            d = weight[part] / weight[part].sum() * (1 / (1 + np.exp(-(pooled + bias).clip(-60, 60))) - y[part])
            dq = batch.gradient(d[batch.of] * share, size).astype(np.float32)
            grads = [np.outer(dq, u) + DECAY * vectors, vectors.T @ dq + DECAY * u, np.array([d.sum()], np.float32)]
            k += 1
            for (m, v), g, p in zip(moments, grads, (vectors, u, None), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                step = RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
                if p is None:
                    bias -= float(step[0])
                else:
                    p -= step
    numbers = (vectors @ u).astype(np.float32)
    del vectors, moments
    top = np.concatenate([np.maximum.reduceat(b.windows(numbers), b.starts) for i in range(0, len(pieces), BATCH) if (b := _Batch(pieces[i : i + BATCH], offsets, values, every))])
    q = np.zeros(BUCKETS, np.float32)
    q[buckets] = numbers
    # Platt scaling at the true rate, on the fifth that was not trained on, or on all where that has one class only
    use = test if len(set(y[test])) == 2 else np.ones(len(y), bool)
    w = np.where(y == 1, rate / max(y[use].sum(), 1), (1 - rate) / max((1 - y[use]).sum(), 1)) * use
    goal = np.where(y == 1, 0.999, 0.001)
    best = (np.inf, 1.0, 0.0)
    for a in np.geomspace(0.1, 10, 41):
        low, high = -60.0 * a, 60.0 * a
        for _ in range(40):
            b = (low + high) / 2
            over = w @ (1 / (1 + np.exp(-(a * top + b).clip(-40, 40))) - goal) > 0
            low, high = (low, b) if over else (b, high)
        logit = (a * top + b).clip(-40, 40)
        best = min(best, (float(w @ (np.logaddexp(0, logit) - goal * logit)), a, b))
    _, a, b = best
    return {"q": q, "bias": float(b), "scale": float(a)}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> dict:
    """The model from labels whose crc32(doc_id) mod 5 is not 0. Ids are chosen first, so only their texts are read."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = n.get(1, 0) / max(1, sum(n.values()))
    chosen = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not chosen:
        return train([], [], rate)
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")  # per_class rows of a class at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    budget = max_chars // 2
    sizes = rows.select("doc_id", "toxic", F.length("text").alias("n")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id")).limit(2 * per_class).collect()
    few = spark.createDataFrame([(r["doc_id"],) for r in fitting(sizes, "toxic", budget)], "doc_id long")
    cut = rows.join(F.broadcast(few), "doc_id").withColumn("text", F.substring("text", 1, budget))

    def run(batches):
        """Trains on the sample, which has a bound; only the model's numbers go to the driver."""
        texts = {i: (t, y) for b in batches for i, t, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True)}
        order = sorted(texts)
        model = train([texts[i][0] or "" for i in order], [texts[i][1] for i in order], rate)
        yield pa.RecordBatch.from_pydict({"q": pa.array([model["q"].tobytes()], pa.binary()), "bias": pa.array([model["bias"]]), "scale": pa.array([model["scale"]])})

    model = cut.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "q binary, bias double, scale double").first()
    if model is None:  # no labelled id has a row, and Spark ran no task
        return train([], [], rate)
    return {"q": np.frombuffer(model["q"], np.float32), "bias": model["bias"], "scale": model["scale"]}


def scorer(model: dict):
    """Function of a list of texts -> scores. A word's number is computed once and kept in a bounded cache."""
    q, a, b = model["q"].astype(float), model["scale"], model["bias"]

    def compute(chunks: list[str]) -> np.ndarray:
        found = [core(c) for c in chunks]
        gram, owner = grams(found, GRAMS, BUCKETS)
        value = np.bincount(owner, q[gram], len(found)) / np.maximum(np.bincount(owner, minlength=len(found)), 1)
        return np.stack([value, [1.0 if c else 0.0 for c in found]], 1)

    known = WordValues(compute, 2)

    def few(texts: list[str | None]) -> list[float]:
        out = []
        for at in known.of([(t or "").lower().split() for t in texts]):
            rows = known.rows[at]
            s = rows[rows[:, 1] > 0, 0]
            k = min(WINDOW, len(s))
            run = np.concatenate([[0.0], np.cumsum(s)])
            top = float((run[k:] - run[:-k]).max()) / k * WINDOW if k else 0.0
            p = float(1 / (1 + np.exp(-min(max(a * top + b, -30.0), 30.0))))
            out.append(p if k else min(p, 0.49))
        return out

    return lambda texts: [x for i in range(0, len(texts), SLICE) for x in few(texts[i : i + SLICE])]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        one = scorer(shared.value)
        return lambda batch: {"doc_id": batch.column(0), "score": pa.array(one(batch.column(1).to_pylist()), pa.float64())}

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), make, "doc_id long, score double")


def reject(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the limit; columns stay as they are."""
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        one = scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array([x < limit for x in one(part.column(where).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
