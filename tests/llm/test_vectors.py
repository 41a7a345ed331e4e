"""Vector codes, whitening and packing against brute force."""

import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from sellerlens.llm import codes, packing, vectors, whiten
from sellerlens.llm.queries import WORD_TOKENIZER
from tests.llm import cases

SCHEMA = "vec_id long, embedding array<double>, label string, v string, code string, width string"
SF = "/root/testdata/sf0.01"


def table(spark, vecs, labels=None, ids=None):
    return spark.createDataFrame(
        [(i if ids is None else ids[i], None if x is None else [None if a is None else float(a) for a in x],
          None if labels is None else labels[i], "x", "x", "x") for i, x in enumerate(vecs)], SCHEMA)


def brute_codes(rows, parts=16, entries=64, rounds=2, factor=256):
    """All of it in Python ints. rows: (vec_id, vector, label)."""
    ok = [r for r in rows if r[1] is not None and all(a is not None and math.isfinite(a) for a in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    size = -(-len(ok[0][1]) // parts)
    xs = [[math.floor(Fraction(float(a)) * factor) for a in r[1]] + [0] * (size * parts - len(r[1])) for r in ok]
    books = [[x[p * size:(p + 1) * size] for x in xs[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    def assign():
        return [[nearest(x[p * size:(p + 1) * size], books[p]) for p in range(parts)] for x in xs]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p * size:(p + 1) * size] for x, a in zip(xs, at) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, sums = [], {}
    for r, a in zip(ok, assign()):
        out.append((r[0], "".join(f"{i:02x}" for _, i in a), sum(d for d, _ in a), r[2]))
        sums[r[2]] = sums.get(r[2], 0) + out[-1][2]

    def long(x):
        return x if x < 1 << 63 else None

    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, c, long(e), long(sums[l]), sha) for i, c, e, l in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_codes_against_brute_force(spark):
    r = np.random.default_rng(0)
    vecs = [list(x) for x in r.normal(0, 0.2, (300, 64))]
    vecs[100:180] = [vecs[100]] * 80                                # copies
    labels = [None if i % 7 == 0 else "hot" if i % 3 else f"l{i % 5}" for i in range(300)]
    rows = [(i, x, labels[i]) for i, x in enumerate(vecs)]
    assert got(codes.compress(table(spark, vecs, labels))) == brute_codes(rows)


@pytest.mark.parametrize("length", [1e9, 1e300])
def test_codes_awkward(spark, length):
    r = np.random.default_rng(1)
    vecs = [list(x) for x in r.normal(0, 0.2, (90, 20))]            # 20 is no multiple of 16
    for i in (3, 40, 80):
        vecs[i] = [a * length for a in vecs[i]]
    vecs[5] = [-length] * 20
    vecs += [None, [], [float("nan")] * 20, [float("inf")] + [0.0] * 19, [None] + [0.0] * 19, [1.0], vecs[7], vecs[8]]
    ids = [*range(90), 90, 91, 92, 93, 94, 95, 7, None]
    rows = [(ids[i], x, None) for i, x in enumerate(vecs) if x is None or len(x) == 20]
    assert got(codes.compress(table(spark, vecs, ids=ids))) == brute_codes(rows)


def test_codes_of_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 16, "a") for i in range(3)]
    assert got(codes.compress(table(spark, [x for _, x, _ in few], ["a"] * 3))) == brute_codes(few)
    assert codes.compress(table(spark, [])).count() == 0
    assert codes.compress(table(spark, [None, [float("nan")]])).count() == 0


@pytest.mark.parametrize("bits", [3, 20, 26, 29])
def test_products_of_limbs_are_exact(bits):
    r = np.random.default_rng(bits)
    x, c = (r.integers(-(1 << bits), 1 << bits, (n, 4)) for n in (50, 64))
    assert (codes.exact_products(x, c) == x @ c.T).all()
    assert 4 * (2 ** codes.limb_bits(4) - 1) ** 2 < 2 ** 53
    at, d = codes.nearest_entries(x[:5], np.concatenate([c, c]).astype(object))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x[:5]]
    assert [min(w) for w in want] == d.tolist() and [w.index(min(w)) for w in want] == at.tolist()


def test_hot_and_null_labels_join_beyond_the_broadcast_size(spark, monkeypatch):
    from sellerlens.llm import work
    monkeypatch.setattr(work, "BROADCAST_ROWS", 1)
    big = spark.createDataFrame([(i, None if i % 5 == 0 else "hot" if i % 2 else f"l{i % 900}") for i in range(3000)], "i long, label string")
    side = work.cut(big.groupBy("label").count().selectExpr("label", "`count` AS c", "`count` * 2 AS s"), "side")
    out = work.add_unique(big, side, "label", "c").toPandas()
    count = out.groupby("label", dropna=False).i.transform("count")
    assert len(out) == 3000 and (out.s == 2 * count).all()


def brute_white(vecs, factor=64, shift=1_000_000):
    x = [[math.floor(Fraction(float(a)) * factor) + shift for a in v] for v in vecs]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = [[n * a - b for a, b in zip(r, s)] for r in x]
    d = len(s)
    v = np.array([[sum(r[i] * r[j] for r in y) / n ** 3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    return n, [sum(a * a for a in r) for r in y], v, e[::-1], u[:, ::-1], np.array([[a / n for a in r] for r in y])


@pytest.mark.parametrize("far", [1.0, 1e7, 1e16])
def test_whitening_against_brute_force(spark, far):
    r = np.random.default_rng(4)
    vecs = r.normal(0, 0.3, (400, 40)) @ r.normal(0, 1, (40, 40))
    vecs[:, 3] *= 3
    vecs[7] *= far
    n, deviation, v, e, u, y = brute_white(vecs)
    ids = [None if i == 9 else i for i in range(400)]
    out = whiten.whiten(table(spark, [list(x) for x in vecs], ids=ids)).toPandas()
    assert len(out) == 400 * 32 and set(out.n) == {400} and set(out.component) == set(range(1, 33))
    want = {(ids[i], d if d < 1 << 63 else None) for i, d in enumerate(deviation)}
    exact = whiten.whiten(table(spark, [list(x) for x in vecs], ids=ids)).where("component = 1")
    assert {(r.vec_id, r.deviation) for r in exact.collect()} == want
    if far > 1e6:
        return                                             # nearly all variance on one line
    w = np.full((400, 32), np.nan)
    for i, c, x in zip(out.vec_id.fillna(9).astype(int), out.component, out.whitened):
        w[i, c - 1] = x
    assert np.allclose(np.abs(w), np.abs(y @ u[:, :32] / np.sqrt(e[:32])), rtol=1e-5, atol=1e-6)
    assert np.abs(w.T @ w / n - np.eye(32)).max() <= 1e-4 and set(out.identity_error <= 1e-4) == {True}
    share = out.groupby("component").explained.first()
    assert np.allclose(share, e[:32] / np.trace(v), rtol=1e-6)


def test_whitening_awkward(spark):
    r = np.random.default_rng(5)
    flat = [[1.0, 2.0, float(a), float(a)] for a in r.normal(size=50)]         # one direction only
    more = [None, [], [None] * 4, [float("-inf")] * 4, [1.0]]
    out = whiten.whiten(table(spark, flat + more)).toPandas()
    assert len(out) == 200 and out[out.component > 1].whitened.isna().all()
    assert abs(out[out.component == 1].whitened.std(ddof=0) - 1) < 1e-9 and out.identity_error.max() < 1e-9
    one = whiten.whiten(table(spark, [[1.0, 2.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    assert whiten.whiten(table(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [10, 25, 31, 45, 59])
def test_square_sums_are_exact(bits):
    r = np.random.default_rng(bits)
    x = r.integers(-(1 << bits), 1 << bits, (1024, 5))
    want = [sum(int(a) ** 2 for a in c) for c in x.T]
    assert whiten.square_sums(x) == want == whiten.square_sums(x.astype(object))


def test_sums_in_limbs(spark):
    values = [0, 1, -1, 2 ** 31, -2 ** 32, 2 ** 40 + 5, -(2 ** 62), 2 ** 62]
    for given in (np.array(values, np.int64), [*values[:-1], 3 ** 90, -(3 ** 80)]):
        def f(_):
            yield from vectors.limbs(np.arange(len(given)), given)
        got = vectors.totals(spark.range(0, 4, 1, 4).mapInArrow(f, vectors.SUMS))
        assert got == {i: 4 * int(v) for i, v in enumerate(given) if v}


# -- packing ------------------------------------------------------------------

def check_packed(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def brute_pieces(rows):
    t = Tokenizer.from_file(WORD_TOKENIZER)
    out = []
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4")
            out.append((d, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    return out


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.pack(packing.pieces(docs, WORD_TOKENIZER)).collect()
    want = brute_pieces([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    assert check_packed(out, 4096) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_awkward(spark):
    odd = [(100, "<|endoftext|> a<|startoftext|>b"), (101, "don't İstanbul \x1c\x85 ΑΣ é ½ ﬁ 漢字"), (102, "x" * 9000)]
    docs = cases.documents(spark, odd)
    out = packing.pack(packing.pieces(docs, WORD_TOKENIZER)).collect()
    want = brute_pieces([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    check_packed(out, 4096)
    assert packing.pack(packing.pieces(cases.empty(spark), WORD_TOKENIZER)).count() == 0


def test_packed_ids_read_back(spark):
    docs = cases.documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.cut(packing.pack(packing.pieces(docs, WORD_TOKENIZER, ids=True)), "t")
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    t = Tokenizer.from_file(WORD_TOKENIZER)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in packed.collect():
        s = whole[r.sequence_id]
        mine = s.ids[r.offset:r.offset + r.length]
        assert r.offset in s.starts
        assert mine == [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start:r.start + r.length]


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps.remove(fit)
            gaps.append(fit - x)
    return len(gaps)


@pytest.mark.parametrize("low,high,n", [(1, 100, 900), (30, 52, 600), (1, 12, 900), (51, 100, 200), (34, 34, 100), (1, 1, 500)])
def test_plan_is_as_good_as_best_fit(low, high, n):
    lengths = np.random.default_rng(n).integers(low, high + 1, n)
    counts = np.bincount(lengths, minlength=101)
    p = packing.plan(counts, 100)
    assert p.sequences <= 1.01 * best_fit_decreasing(lengths.tolist(), 100)
    length = np.repeat(np.arange(101), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    seq, offset = p.place(length, rank)

    class Row:
        def __init__(self, s, o, l):
            self.sequence_id, self.offset, self.length = s, o, l

    assert check_packed([Row(*r) for r in zip(seq.tolist(), offset.tolist(), length.tolist())], 100) == p.sequences


def test_plan_of_exact_complements():
    def sequences(*lengths):
        return packing.plan(np.bincount(lengths, minlength=101), 100).sequences

    assert sequences(60, 60, 40, 40) == 2
    assert sequences(60, 38, 22, 18, 62) == 2                # 62 + 38, 60 + 22 + 18
    assert sequences(40, 30, 20, 10) == 1 and sequences(97, 1, 1, 1) == 1
    assert sequences(50, 25, 25, 50, 50, 50) == 3
    # A hot length: the plan's size does not grow with the pieces.
    few, many = (packing.plan(np.bincount([7, 13, 60], minlength=101) * k, 100) for k in (100, 10 ** 12))
    assert len(many.length) <= len(few.length) + 40 and many.sequences == 10 ** 12


def test_hot_length_over_many_tasks(spark):
    t = spark.range(0, 20_000, 1, 16).selectExpr("id", "CAST(IF(id % 3 = 0, 7, 1 + id % 97) AS long) AS length")
    out = packing.pack(t, 100)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(20_000))
    total = sum(r.length for r in rows)
    assert check_packed(rows, 100) <= total / 100 * 1.005 + 1
