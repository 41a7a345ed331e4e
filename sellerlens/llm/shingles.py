"""N-gram Jaccard join: documents whose word-shingle sets overlap enough.

The document by n-gram incidence matrix is multiplied with its transpose in
blocks of n-grams. Two bounds derived from set sizes keep the product sparse:

* a pair can only link if it shares one of the first ``n - ceil(3n/4) + 1``
  n-grams of either set in a common order, so only those columns are formed;
* the overlap counted there plus all that could follow must reach
  ``3(n + m)/7`` (a Jaccard similarity of 3/4), otherwise the pair is dropped.

The order puts n-grams last that many documents share (counted over all
texts), the rest by hash. Equal sets are joined by their digest first and only
one stands for them. Columns of at most ``SMALL`` documents give all their
pairs. Longer columns link every document to one leader, then components are
formed, and only pairs between different components of a column remain; those
are all formed, so no link is lost. Survivors are verified on their texts.

Sets are those of 64-bit n-gram hashes. Words are ``[^\\x20\\x09-\\x0D]+`` of
the text with A-Z lower-cased; a text with fewer words than the n-gram has is
one n-gram; one without words is an empty set and links with nothing.

Defined cases: null text counts as no words; a null doc_id is returned with a
null component and takes no part; rows with the same doc_id are one document,
linked if any of its texts links; an empty table gives an empty result; extra
columns stay out.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.components import components
from sellerlens.llm.work import cut, ship, small_side

WORDS = 5                 # words of a shingle
SMALL = 8                 # documents of a column that gives all its pairs
COMMON_ROWS = 200_000     # common n-grams that are told to every task
CHUNK = 2_000_000         # n-grams counted together in the search for common ones
STARS = 3                 # rounds of leaders before the remaining pairs
FIRST = 16                # columns of a document that tell where a pair is formed
REMEMBERED = 200_000      # word hashes kept by one Python worker

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    # bytes.lower() changes A-Z only, bytes.split() splits at \x20 \x09-\x0D.
    parts = (text or "").encode("utf-8", "replace").lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, n)
    k = min(n, words)
    s = np.full(n - k + 1, 0 if n >= words else n, np.uint64)
    for j in range(k):
        s += h[j:n - k + 1 + j] * (_MIX[j % 5] + np.uint64(2 * (j // 5)))
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    s.sort()
    if len(s) > 1:
        keep = np.empty(len(s), bool)
        keep[0] = True
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        s = s[keep]
    return s


def _texts(documents: DataFrame) -> DataFrame:
    return ship(documents).select(F.col("doc_id").cast("long"), "text")


def common_shingles(documents: DataFrame) -> np.ndarray:
    """N-grams of many documents, the most frequent first chosen, at most
    ``COMMON_ROWS``: they only decide the order of columns, not what links.
    Counted over all texts; each chunk reports what it has three times."""
    def count(batches):
        held, size = [], 0
        for b in batches:
            for t in b["text"]:
                s = shingle_set(t)
                held.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield tell(held)
                    held, size = [], 0
        if held:
            yield tell(held)

    def tell(held):
        s = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, int)
        n = np.diff(np.append(at, len(s)))
        return pd.DataFrame({"g": s[at[n >= 3]].view(np.int64), "n": n[n >= 3].astype(np.int64)})

    c = (ship(documents).select("text").mapInPandas(count, "g long, n long")
         .groupBy("g").agg(F.sum("n").alias("n")).where("n >= 8")
         .orderBy(F.desc("n"), "g").limit(COMMON_ROWS))
    got = np.array([r[0] for r in c.select("g").collect()], np.int64)
    return np.sort(got.view(np.uint64))


def _within(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common) or not len(s):
        return np.zeros(len(s), bool)
    at = np.searchsorted(common, s)
    return common[np.minimum(at, len(common) - 1)] == s


def _remaining(n):
    """Members of a set of size n after its first columns: ceil(3n/4) - 1."""
    return F.floor((3 * n + 3) / 4) - 1


def _needed(n, m):
    return F.floor((3 * (n + m) + 6) / 7)


def prefixes(documents: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, n, digest of the set (k1, k2) and its first columns, the rare
    ones in ``rare``, those of many documents in ``often``."""
    told = documents.sparkSession.sparkContext.broadcast(common)  # COMMON_ROWS numbers at most

    def f(batches):
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                s = shingle_set(t)
                n = len(s)
                k = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                first = n - (3 * n + 3) // 4 + 1 if n else 0
                c = _within(s, told.value)
                rare = s[~c][:first]
                often = s[c][:first - len(rare)]
                rows.append((d, n, int.from_bytes(k[:8], "little", signed=True),
                             int.from_bytes(k[8:], "little", signed=True), rare.view(np.int64), often.view(np.int64)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "k1", "k2", "rare", "often"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return _texts(documents).mapInPandas(
        f, "doc_id long, n long, k1 long, k2 long, rare array<long>, often array<long>")


def _products(entries: DataFrame) -> DataFrame:
    """The blocked product. Rows (g, a, na, b, nb): pairs from short columns;
    entries of long columns with b null; with g null, too, entries of short
    columns (of two documents or more)."""
    def pairs(g, d, n, at, size):
        out = []
        for k in range(2, SMALL + 1):
            first = at[size == k]
            if not len(first):
                continue
            for i in range(k):
                for j in range(i):
                    x, y = first + i, first + j
                    ok = (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])) & (d[x] != d[y])
                    x, y = x[ok], y[ok]
                    swap = d[x] > d[y]
                    lo, hi = np.where(swap, y, x), np.where(swap, x, y)
                    out.append(np.stack([g[lo], d[lo], n[lo], d[hi], n[hi]]))
        return np.concatenate(out, axis=1) if out else np.empty((5, 0), np.int64)

    def half(v, k):
        return pd.arrays.IntegerArray(np.concatenate([v, np.zeros(k, np.int64)]),
                                      np.concatenate([np.zeros(len(v), bool), np.ones(k, bool)]))

    def frame(p, rest, shared):
        k, m = rest.shape[1], shared.shape[1]
        known = np.concatenate([p[0], rest[0]])
        return pd.DataFrame({"g": half(known, m), "a": np.concatenate([p[1], rest[1], shared[1]]),
                             "na": np.concatenate([p[2], rest[2], shared[2]]), "b": half(p[3], k + m), "nb": half(p[4], k + m)})

    def f(batches):
        held = np.empty((3, 0), np.int64)      # the last column so far
        open_long = None                        # its n-gram, if already told as long
        for b in batches:
            m = np.concatenate([held, b[["g", "doc_id", "n"]].to_numpy(np.int64).T], axis=1)
            g = m[0]
            if not len(g):
                continue
            at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            size = np.diff(np.append(at, len(g)))
            last = at[-1]
            held = m[:, last:]
            at, size = at[:-1], size[:-1]
            long = size > SMALL
            if open_long is not None and len(at) and g[at[0]] == open_long:
                long[0] = True
            take = np.repeat(long, size)
            body = m[:, :last]
            p = pairs(body[0], body[1], body[2], at, np.where(long, 0, size))
            rest = body[:, take]
            if held.shape[1] > SMALL or (open_long is not None and held[0, 0] == open_long):
                rest = np.concatenate([rest, held], axis=1)
                open_long = held[0, 0]
                held = held[:, :0]
            else:
                open_long = None
            shared = body[:, np.repeat(~long & (size > 1), size)]
            if shared.shape[1] or rest.shape[1]:
                yield frame(p, rest, shared)
        if held.shape[1] > 1:
            k = held.shape[1]
            p = pairs(held[0], held[1], held[2], np.array([0]), np.array([k]))
            yield frame(p, held[:, :0], held)

    return (ship(entries).repartition("g").sortWithinPartitions("g")
            .mapInPandas(f, "g long, a long, na long, b long, nb long"))


def verify(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are at least 3/4 similar."""
    pairs = cut(pairs.select("a", "b"), "pairs")
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = _texts(documents).join(small_side(ids), "doc_id", "left_semi")
    texts = cut(texts, "texts")
    t = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
         .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a"))

    def f(batches):
        kept: OrderedDict[int, tuple] = OrderedDict()
        total = 0

        def of(d, text):
            nonlocal total
            hit = kept.get(d)
            if hit is not None and hit[0] == text:
                kept.move_to_end(d)
                return hit[1]
            if hit is not None:
                total -= len(kept.pop(d)[1])
            s = shingle_set(text)
            kept[d] = (text, s)
            total += len(s)
            while total > 2_000_000 and len(kept) > 1:
                total -= len(kept.popitem(last=False)[1][1])
            return s

        for b in batches:
            ok = []
            for x, y, tx, ty in zip(b["a"], b["b"], b["ta"], b["tb"]):
                p, q = of(x, tx), of(y, ty)
                m = np.concatenate([p, q])
                m.sort()
                both = int(np.count_nonzero(m[1:] == m[:-1]))
                if both and 7 * both >= 3 * (len(p) + len(q)):
                    ok.append((x, y))
            yield pd.DataFrame(ok, columns=["a", "b"], dtype=np.int64)

    return t.select("a", "b", "ta", "tb").mapInPandas(f, "a long, b long")


def join(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable)."""
    sets = cut(prefixes(documents, common_shingles(documents)), "sets")
    whole = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = cut(whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    member = cut(whole.select("doc_id", "k1", "k2").join(classes, ["k1", "k2"])
                 .where("doc_id <> rep").distinct(), "member")
    # A document stays with those of its texts that stand for their class.
    apart = whole.join(small_side(member.select("doc_id", "k1", "k2")), ["doc_id", "k1", "k2"], "left_anti")
    found = cut(_products(apart.select(F.explode("rare").alias("g"), "doc_id", "n")), "products")
    rest = cut(found.where("b IS NULL AND g IS NOT NULL").select("g", F.col("a").alias("doc_id"), F.col("na").alias("n"))
               .unionByName(apart.select(F.explode("often").alias("g"), "doc_id", "n")), "columns")
    open_ = rest.groupBy("doc_id").agg(F.count("*").alias("r"))
    # t: first columns of a document that others may have, too.
    shared = (found.where("b IS NULL AND g IS NULL").select(F.col("a").alias("doc_id"))
              .unionByName(rest.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("t")))
    rest = cut(rest.join(shared, "doc_id"), "columns")
    counted = cut(found.where("b IS NOT NULL").groupBy("a", "na", "b", "nb").agg(F.count("*").alias("c")), "counted")

    def possible(pairs, overlap):
        """Pairs whose overlap so far and all that can follow suffices: what
        the set whose first columns end earlier still has, at most."""
        most = overlap + F.greatest(_remaining(F.col("na")), _remaining(F.col("nb")))
        return pairs.where(most >= _needed(F.col("na"), F.col("nb")))

    def with_open(pairs):
        p = (pairs.join(open_.select(F.col("doc_id").alias("a"), F.col("r").alias("ra")), "a", "left")
             .join(open_.select(F.col("doc_id").alias("b"), F.col("r").alias("rb")), "b", "left"))
        return possible(p, F.col("c") + F.coalesce(F.least(F.coalesce("ra", F.lit(0)), F.coalesce("rb", F.lit(0))), F.lit(0)))

    tested = cut(with_open(counted).select("a", "b"), "tested")
    links = cut(verify(documents, tested), "links")
    copies = member.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links)
    for turn in range(STARS + 1):
        at = rest.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
            "g", "doc_id", "n", "t", F.coalesce("root", "doc_id").alias("root"))
        # The first leader is the document with the least of its own, as an
        # original among its copies has; later ones go by hash.
        own = (F.col("n") - _remaining(F.col("n")) - F.col("t")) / F.col("n") if turn == 0 else F.lit(0.0)
        heads = at.groupBy("g").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.min(F.struct(own.alias("own"), F.xxhash64(F.lit(turn), "doc_id").alias("h"), "doc_id", "n", "root")).alias("head"))
        mixed = cut(at.join(heads.where("lo < hi"), "g").select("g", "doc_id", "n", "t", "root", "head"), "mixed")
        if mixed.isEmpty():
            break
        if turn < STARS:
            x = mixed.where("root <> head.root").select(
                F.least("doc_id", "head.doc_id").alias("a"), F.greatest("doc_id", "head.doc_id").alias("b"),
                F.when(F.col("doc_id") < F.col("head.doc_id"), F.col("n")).otherwise(F.col("head.n")).alias("na"),
                F.when(F.col("doc_id") < F.col("head.doc_id"), F.col("head.n")).otherwise(F.col("n")).alias("nb"))
            x = x.where("4 * least(na, nb) >= 3 * greatest(na, nb)").distinct()
            x = with_open(x.join(counted.select("a", "b", "c"), ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0))))
        else:
            # A pair is formed in the first column both have, as far as each
            # document's first FIRST columns tell, not once for each column.
            first = mixed.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("g")), 1, FIRST).alias("f"))
            each = cut(mixed.select("g", "doc_id", "n", "t", "root").join(first, "doc_id"), "each")
            l, r = (each.select("g", *[F.col(c).alias(c + s) for c in ("doc_id", "n", "t", "root", "f")]) for s in "ab")
            x = l.join(r, "g").where(
                "doc_ida < doc_idb AND roota <> rootb AND 4 * least(na, nb) >= 3 * greatest(na, nb)"
                " AND coalesce(array_min(array_intersect(fa, fb)) >= g, true)")
            x = possible(x, F.least("ta", "tb")).select(F.col("doc_ida").alias("a"), "na", F.col("doc_idb").alias("b"), "nb").distinct()
            # The overlap in all long columns, from each document's own list.
            own = rest.groupBy("doc_id").agg(F.collect_set("g").alias("gs"))
            x = (x.join(own.select(F.col("doc_id").alias("a"), F.col("gs").alias("ga")), "a")
                 .join(own.select(F.col("doc_id").alias("b"), F.col("gs").alias("gb")), "b")
                 .select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("c2"))
                 .join(counted.select("a", "b", "c"), ["a", "b"], "left"))
            x = possible(x, F.col("c2") + F.coalesce("c", F.lit(0)))
        fresh = cut(x.select("a", "b").join(tested, ["a", "b"], "left_anti"), "fresh")
        tested = cut(tested.unionByName(fresh), "tested")
        new = cut(verify(documents, fresh), "links")
        if not new.isEmpty():
            links = cut(links.unionByName(new), "links")
            roots = components(links)
    roots = components(links.unionByName(copies)) if not copies.isEmpty() else roots
    return (sets.select("doc_id", F.col("n").alias("n_shingles"))
            .join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
