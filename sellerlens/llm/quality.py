"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector derived from its hash. The vector
of a known word is the sum of the index vectors of its neighbours in the
labelled sample; other words share one vector. A document pools its words'
vectors (mean and mean square) with a few token shares. A two-layer network
is trained on these in numpy and its scores are calibrated by a temperature
fitted on rows set apart.

Learning uses a bounded, hash-ordered sample of labelled rows (``FIT_ROWS``
rows) and at most ``VOCABULARY`` words, so what is broadcast has a fixed size.
Words are counted, neighbours added up and texts pooled in tasks over the whole
texts of that sample; the driver gets the words, their sums and the features.
Scoring reads
every whole text, task by task, without any shuffle.

Defined cases: null and empty texts pool to zeros and get the network's score
for that; with no labels to learn from every score is 0.5; repeated rows are
scored each; several labels of a document give their largest; a null doc_id is
never learned from and not held out (its ``held_out`` is false); extra columns
stay out; an empty table gives no rows.
"""

from __future__ import annotations

import operator
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.langid import held_out
from sellerlens.llm.work import cut, ship

FIT_ROWS = 8_000
VOCABULARY = 50_000
LEAST = 3              # occurrences that make a word known
LONGEST = 64           # characters of a word that can be known
DIM = 64
HIDDEN = 32
REACH = 2              # neighbours on either side
TOKEN = re.compile(r"\w+|[^\w\s]+")
PIECE = 1 << 16        # tokens pooled together
STEPS = 2_000          # training steps, whatever the number of rows


def index_vectors(words: list[str], dim: int = DIM, ones: int = 6) -> np.ndarray:
    """Sparse ternary vectors from word hashes."""
    out = np.zeros((len(words), dim), np.float32)
    for i, w in enumerate(words):
        h = xxhash.xxh3_128_intdigest(w.encode("utf-8", "replace"))
        for _ in range(ones):
            out[i, h % dim] += 1 if (h >> 20) & 1 else -1
            h >>= 21
    return out


def with_others(index: np.ndarray) -> np.ndarray:
    """Index vectors with the zero row of the other words before them."""
    return np.concatenate([np.zeros((1, index.shape[1]), index.dtype), index])


def context_sums(texts, ids: dict[str, int], index: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of each word's neighbours to its row of ``total``,
    ``PIECE`` tokens at a time."""
    for text in texts:
        flat, known = [], 0                    # the first ``known`` tokens met their neighbours before
        for w in TOKEN.finditer(text or ""):
            flat.append(ids.get(w.group(), 0))
            if len(flat) == PIECE:
                _add_context(np.array(flat), known, index, total)
                flat, known = flat[-REACH:], REACH
        _add_context(np.array(flat, np.int64), known, index, total)


def _add_context(flat: np.ndarray, known: int, index: np.ndarray, total: np.ndarray) -> None:
    for step in range(1, REACH + 1):
        at = max(known, step)
        left, right = flat[at - step:max(len(flat) - step, 0)], flat[at:]
        for here, there in ((left, right), (right, left)):
            some = np.flatnonzero(there)
            if not len(some):
                continue
            some = some[np.argsort(here[some], kind="stable")]
            h = here[some]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            total[h[first]] += np.add.reduceat(index[there[some]], first, axis=0)


class WordVectors:
    """Vectors of the known words; row 0 stands for all others."""

    def __init__(self, known: list[str], total: np.ndarray):
        """``total``: sums of the neighbours' index vectors, a row a word."""
        self.ids = {w: i + 1 for i, w in enumerate(known)}
        context = np.sign(total) * np.log1p(np.abs(total))
        both = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
                + 0.5 * with_others(index_vectors(known)) / 6 ** 0.5)
        self.vectors = both.astype(np.float32)

    def pool(self, text: str | None) -> np.ndarray:
        """Mean and mean square of the words' vectors, then token shares."""
        t = TOKEN.findall(text or "")
        n = len(t)
        if not n:
            return np.zeros(2 * DIM + 6, np.float32)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in t), np.int64, n)
        s, q = np.zeros(DIM), np.zeros(DIM)
        for k in range(0, n, PIECE):
            v = self.vectors[ids[k:k + PIECE]]
            s += v.sum(0)
            q += np.einsum("ij,ij->j", v, v)
        shares = [sum(map(operator.eq, t[1:], t)), sum(map(str.isupper, t)), n - sum(map(str.isalnum, t)),
                  np.count_nonzero(ids == 0), len(set(t))]
        return np.concatenate([s / n, q / n, np.array(shares) / n, [np.log1p(n) / 8]]).astype(np.float32)


class Scorer:
    """Word vectors, standardisation, two layers, temperature."""

    def __init__(self, words: WordVectors, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.words = words
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        apart = order[:max(1, len(x) // 6)] if len(x) > 20 else order
        use = order[len(x) // 6:] if len(x) > 20 else order
        self.mean, self.scale = x[use].mean(0), x[use].std(0) + 1e-3
        z = (x - self.mean) / self.scale
        self.w1 = r.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN))
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), r.normal(0, 0.2, HIDDEN), np.zeros(1)
        self.temperature = 1.0
        p = [self.w1, self.b1, self.w2, self.b2]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for step in range(1, STEPS + 1):
            i = use[r.integers(0, len(use), 128)]
            a = z[i] @ self.w1 + self.b1
            h = np.maximum(a, 0)
            e = (_sigmoid(h @ self.w2 + self.b2) - y[i]) / len(i)
            back = np.outer(e, self.w2) * (a > 0)
            grads = (z[i].T @ back + 4e-3 * self.w1, back.sum(0), h.T @ e + 4e-3 * self.w2, e.sum(keepdims=True))
            for q, g, mm, vv in zip(p, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.01 * (g * g - vv)
                q -= 0.003 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-8)
        logits, t = self._logits(x[apart]), y[apart]

        def loss(temperature):
            s = np.clip(_sigmoid(logits / temperature), 1e-7, 1 - 1e-7)
            return -(t * np.log(s) + (1 - t) * np.log(1 - s)).mean()

        self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def _logits(self, x):
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, texts) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        return _sigmoid(self._logits(np.stack([self.words.pool(t) for t in texts])) / self.temperature)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """h, doc_id, quality, text (whole) of the first ``rows`` labelled
    documents in hash order that are not held out."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = (known.select(F.xxhash64("doc_id", F.lit("fit")).alias("h"), "doc_id", "quality")
              .orderBy("h", "doc_id").limit(rows))
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return cut(found.join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "quality", "text"), "quality-sample")


def word_vectors(texts: DataFrame) -> WordVectors:
    """Words of the sample (``VOCABULARY`` at most, ``LEAST`` times or more)
    and their neighbours, counted in tasks over whole texts."""
    def count(batches):
        seen = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(w.group() for w in TOKEN.finditer(t) if w.end() - w.start() <= LONGEST)
                if len(seen) > 4 * VOCABULARY:
                    yield pd.DataFrame(list(seen.items()), columns=["w", "n"])
                    seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["w", "n"]).astype({"w": object, "n": np.int64})

    words = (ship(texts).select("text").mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= LEAST).orderBy(F.desc("n"), "w").limit(VOCABULARY).select("w").collect())
    known = [r[0] for r in words]
    told = texts.sparkSession.sparkContext.broadcast(known)                     # ``VOCABULARY`` words at most
    columns = [f"c{i}" for i in range(DIM)]

    def near(batches):
        known = told.value
        ids, index = {w: i + 1 for i, w in enumerate(known)}, with_others(index_vectors(known))
        total = np.zeros((len(known) + 1, DIM))
        for b in batches:
            context_sums(b["text"], ids, index, total)
        some = np.flatnonzero(total.any(1))
        yield pd.DataFrame(total[some], columns=columns).assign(k=some)[["k", *columns]]

    sums = (texts.select("text").mapInPandas(near, ", ".join(["k long", *[f"{c} double" for c in columns]]))
            .groupBy("k").agg(*[F.sum(c).alias(c) for c in columns]))           # whole numbers: any order adds alike
    total = np.zeros((len(known) + 1, DIM))
    got = sums.toPandas()                                                       # ``VOCABULARY`` rows at most
    total[got["k"].to_numpy(np.int64)] = got[columns].to_numpy()
    return WordVectors(known, total)


def features(texts: DataFrame, words: WordVectors, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pooled whole texts and labels of the sample, in hash order."""
    told = ship(texts).sparkSession.sparkContext.broadcast(words)  # VOCABULARY rows at most

    @F.pandas_udf("array<float>")
    def pool(text: pd.Series) -> pd.Series:
        return pd.Series([told.value.pool(t) for t in text])

    got = (texts.select("h", "doc_id", "quality", pool("text").alias("x"))
           .orderBy("h", "doc_id", "x").limit(rows).select("x", "quality").toPandas())     # 134 numbers a row
    return np.stack(got["x"]).astype(np.float32), (got["quality"] != 0).to_numpy(float)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Scorer | None:
    """Learn words and network from the whole texts of ``rows`` labelled rows
    that are not held out."""
    texts = sample(documents, labels, rows)
    if texts.isEmpty():
        return None
    words = word_vectors(texts)
    return Scorer(words, *features(texts, words, rows))


def score(documents: DataFrame, scorer: Scorer | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    told = ship(documents).sparkSession.sparkContext.broadcast(scorer)  # VOCABULARY rows at most

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        s = told.value
        return pd.Series(np.full(len(text), 0.5) if s is None else s.score(list(text)), dtype="float64")

    return (documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), of("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
