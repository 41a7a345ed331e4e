"""Language identification by a small byte-level convolutional network.

Filters of several widths slide over byte embeddings, each filter's maximum
over a window feeds a softmax layer. The network is trained in numpy on the
driver from a bounded, hash-ordered sample of labelled rows (``FIT_ROWS``
windows of ``WINDOW`` bytes); its weights are a few kilobytes. Prediction cuts
every whole text into windows, runs them in batches and averages the windows'
probabilities by their number of bytes.

Defined cases: a null text or one without a letter gets ``und`` and score 0;
with nothing to learn from, so does every text; texts of any length are read
whole; repeated rows are predicted each; a null doc_id is not held out and
not learned from; extra columns stay out; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sellerlens.llm.work import free, ship

FIT_ROWS = 8_000      # labelled rows that are learned from, at most
WINDOW = 256          # bytes of a window
WIDTHS = (2, 3, 4)
FILTERS = 12          # of each width
EMBED = 6
STEPS = 640           # training steps, whatever the number of rows
BATCH = 256           # windows predicted together
UNKNOWN = "und"
# First letter and number of letters of some scripts (fixed values): Greek,
# Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, Hiragana,
# Han, Hangul.
SCRIPTS = ((0x3B1, 25), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x627, 36), (0x904, 54), (0xE01, 46),
           (0x10D0, 33), (0x3041, 83), (0x4E00, 20000), (0xAC00, 11000))


def held_out(doc_id: Column) -> Column:
    """The quarter of documents nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


class ByteNet:
    """Embedding, convolutions, maximum over positions, softmax."""

    def __init__(self, classes: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), np.float32)

    def params(self):
        return [self.embed, *self.filters, *self.shift, self.out, self.bias]

    def _columns(self, x, w):
        e = self.embed[x]
        v = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)          # B, L-w+1, EMBED, w
        return v.transpose(0, 1, 3, 2).reshape(x.shape[0], x.shape[1] - w + 1, w * EMBED)

    def pooled(self, x):
        """Pooled features, with what the backward pass needs."""
        tops, kept = [], []
        for f, s, w in zip(self.filters, self.shift, WIDTHS):
            c = self._columns(x, w)
            y = c @ f
            at = y.argmax(1)
            top = np.take_along_axis(y, at[:, None, :], 1)[:, 0] + s
            tops.append(top)
            kept.append((c, at))
        return np.concatenate(tops, 1), kept

    def predict(self, x):
        """Class probabilities of windows (rows of bytes)."""
        e = self.embed[x].reshape(x.shape[0], -1)                            # B, L * EMBED
        tops = []
        for f, s, w in zip(self.filters, self.shift, WIDTHS):
            v = np.lib.stride_tricks.sliding_window_view(e, w * EMBED, axis=1)[:, ::EMBED]
            y = np.ascontiguousarray(v).reshape(-1, w * EMBED) @ f
            tops.append(y.reshape(x.shape[0], -1, FILTERS).max(1) + s)
        return _softmax(np.maximum(np.concatenate(tops, 1), 0) @ self.out + self.bias)

    def fit(self, x, y, steps=STEPS, batch=64, rate=0.004, seed=2):
        r = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        step = 0
        while step < steps:
            order = r.permutation(len(x))
            for k in range(0, len(x), batch):
                i = order[k:k + batch]
                b = x[i].copy()
                keep = r.integers(24, b.shape[1] + 1, len(b))              # short texts occur too
                b[np.arange(b.shape[1])[None, :] >= keep[:, None]] = 0
                step += 1
                lr = rate * (1 - step / (steps + 1))
                for p, g, mm, vv in zip(self.params(), self._gradients(b, y[i]), m, v):
                    mm *= 0.9
                    mm += 0.1 * g
                    vv *= 0.99
                    vv += 0.01 * g * g
                    p -= lr * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.99 ** step)) + 1e-7)
                self.embed[0] = 0
        return self

    def _gradients(self, x, y):
        top, kept = self.pooled(x)
        h = np.maximum(top, 0)
        p = _softmax(h @ self.out + self.bias)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g_out, g_bias = h.T @ p, p.sum(0)
        g_top = (p @ self.out.T) * (top > 0)
        g_embed = np.zeros_like(self.embed)
        g_f, g_s = [], []
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(WIDTHS):
            c, at = kept[k]
            g = g_top[:, k * FILTERS:(k + 1) * FILTERS]
            best = c[rows, at]                                               # B, FILTERS, w * EMBED
            g_f.append(np.einsum("bf,bfi->if", g, best))
            g_s.append(g.sum(0))
            back = (g[:, :, None] * self.filters[k].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g_embed, x[rows, at + j], back[:, :, j])
        return [g_embed, *g_f, *g_s, g_out, g_bias]


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows of texts: bytes, owner, length."""
    count = [-(-len(d) // WINDOW) for d in data]
    flat = np.zeros(sum(count) * WINDOW, np.uint8)
    at = 0
    for d, c in zip(data, count):
        flat[at:at + len(d)] = np.frombuffer(d, np.uint8)
        at += c * WINDOW
    x = flat.reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(data)), count)
    first = np.cumsum([0, *count[:-1]]) if count else np.empty(0, int)
    length = np.full(len(x), WINDOW)
    for i, (d, c) in enumerate(zip(data, count)):
        if c:
            length[first[i] + c - 1] = len(d) - (c - 1) * WINDOW
    return x, owner, length


def noise(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Windows of no language, a third each: letters of real windows in another
    order (word lengths kept), random Latin letters, letters of foreign scripts."""
    r = np.random.default_rng(seed)
    out = []
    for i, row in enumerate(x):
        text = bytes(row[row > 0]).decode("utf-8", "ignore")
        if i % 3 == 0:
            letters = [c for c in text if c.isalpha()]
            r.shuffle(letters)
            it = iter(letters)
            text = "".join(next(it) if c.isalpha() else c for c in text)
        else:
            first, size = (0x61, 26) if i % 3 == 1 else SCRIPTS[r.integers(len(SCRIPTS))]
            gap = r.integers(3, 12)
            text = "".join(" " if r.integers(gap) == 0 else chr(first + r.integers(size)) for _ in range(WINDOW))
        raw = text.encode()[:WINDOW]
        out.append(np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8))
    return np.stack(out)


def sample(documents: DataFrame, rows: int) -> DataFrame:
    """h, lang, text of ``rows`` rows that are not held out, in hash order. A
    hash threshold from a count keeps what tasks send to little more than that."""
    t = documents.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0)).select(
        F.xxhash64("doc_id", F.lit("fit")).alias("h"), F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    n = t.count()
    if n > 4 * rows:
        t = t.where(F.pmod(F.shiftright("h", 20), F.lit(1 << 30)) < int((1 << 30) * 2.0 * rows / n))
    room = F.greatest(F.length("text") - WINDOW, F.lit(1))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), room.cast("long")).cast("int") + 1
    return t.select("h", "lang", F.substring("text", place, F.lit(WINDOW)).alias("text")).orderBy("h", "lang", "text").limit(rows)


def fit(documents: DataFrame, rows: int = FIT_ROWS, reject: bool = False) -> ByteNet | None:
    """Learn from the texts and languages of rows that are not held out: one
    window at a hashed place of each of the first ``rows`` in hash order (a
    bound of 2 MB on what is learned from; predictions read whole texts). With
    ``reject``, ``und`` is one more class, learned from ``noise``."""
    got = sample(documents, rows).collect()
    classes = sorted({r["lang"] for r in got})
    if not classes:
        return None
    x = np.stack([_windows([r["text"].lower().encode("utf-8", "replace")[:WINDOW] or b" "])[0][0] for r in got])
    y = np.array([classes.index(r["lang"]) for r in got])
    if reject:
        other = noise(x[::3] if len(x) > 300 else x)
        x, y = np.concatenate([x, other]), np.concatenate([y, np.full(len(other), len(classes))])
        classes = [*classes, UNKNOWN]
    return ByteNet(classes).fit(x, y)


def predict_texts(net: ByteNet | None, texts) -> list[tuple[str, float]]:
    out = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    use = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    k = 0
    while k < len(use):
        some, size = [], 0                       # texts whose windows fill some batches
        while k < len(use) and size < 32 * BATCH * WINDOW:
            d = texts[use[k]].lower().encode("utf-8", "replace")
            some.append((use[k], d))
            size += len(d)
            k += 1
        x, owner, length = _windows([d for _, d in some])
        total = np.zeros((len(some), len(net.classes)))
        for at in range(0, len(x), BATCH):
            s = slice(at, at + BATCH)
            np.add.at(total, owner[s], net.predict(x[s]) * length[s, None])
        total /= total.sum(1, keepdims=True)
        for (i, _), p in zip(some, total):
            j = int(p.argmax())
            out[i] = (net.classes[j], float(min(1.0, p[j])))
    return out


def predict(documents: DataFrame, net: ByteNet | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``documents`` and two more, language and score, under
    ``names``, which must be free."""
    told = ship(documents).sparkSession.sparkContext.broadcast(net)  # fixed size

    @F.pandas_udf("struct<l:string,s:double>")
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict_texts(told.value, list(text)), columns=["l", "s"])

    # Not deterministic, as far as Spark knows: else a filter on the result runs
    # the network once more, in a second Python worker of every task.
    of = of.asNondeterministic()
    both, = free(documents.columns, "__p")
    rest = [F.col(f"`{c}`") for c in documents.columns]
    return (documents.select(*rest, of("text").alias(both))
            .select(*rest, F.col(f"{both}.l").alias(names[0]), F.col(f"{both}.s").alias(names[1])))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    p = predict(documents.select("doc_id", "text"), fit(documents))
    return p.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
