"""Labels kept up to date under new entries equal those of a full run."""

import glob
import os
import random

import pytest

from sellerlens import names as N
from sellerlens.operators import income as I
from sellerlens.operators import incomestate as S
from sellerlens.sinks.snapshots import CommitConflict
from tests.conftest import rows
from tests.test_income import EDGE, SCHEMA, entries

COLS = (N.ADJUSTMENT_ID, N.RELATED_ORDER_ID, N.TYPE, N.CLASSIFY, N.PAYDOUBLE, N.ORDER_TYPE, N.ABS_FEES, N.SETTLED_TIME)


def full(spark, triples):
    return sorted(map(str, rows(I.classify_income(entries(spark, triples)), *COLS)))


def kept(spark, base):
    return sorted(map(str, rows(S.read_entries(spark, base), *COLS)))


def test_any_batch_order_equals_a_full_run(spark, tmp_path):
    rnd = random.Random(5)
    given = EDGE + [(rnd.choice(["7", "5"]) + str(rnd.randrange(9)), rnd.choice([None, "hot", "hot", str(rnd.randrange(12))]),
                     rnd.choice(["Order", "Order", "Order", "Fee", None])) for _ in range(60)]
    for turn in range(2):
        rnd.shuffle(given)
        base = str(tmp_path / f"s{turn}")
        cuts = [0, 1, 25, 40, len(given)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            S.add_batch(spark, base, entries(spark, given[a:b]), f"b{i}", buckets=4)
            assert kept(spark, base) == full(spark, given[:b])
    out = S.read_entries(spark, base)
    want = I.classify_income(entries(spark, EDGE))
    assert out.columns == want.columns and [f.dataType for f in out.schema] == [f.dataType for f in want.schema]


def test_a_small_batch_reads_and_rewrites_affected_buckets_only(spark, tmp_path):
    base = str(tmp_path / "s")
    given = [(f"5{i}", f"5{i}", "Order") for i in range(300)] + [("a", "twice", "Order"), ("b", "twice", "Order")]
    first = S.add_batch(spark, base, entries(spark, given), "first", buckets=32)
    assert len(first.touched) == 32 and not first.rewritten
    before = S.read_store(spark, base)

    # Buckets without the batch's IDs are gone from disk: a read of one would fail.
    late = [("x", "57", "Order"), ("c", "twice", "Order")]
    hit = {r[0] for r in entries(spark, late).select(S._bucket(32)).collect()}
    for kind, parts in (("state", {b: (p,) for b, p in before.state.items()}), ("entries", before.entries)):
        for b, ps in parts.items():
            if b not in hit:
                for p in ps:
                    os.rename(f"{base}/data/{p}/{kind}/{S.BUCKET}={b}", f"{base}/data/{p}/{kind}/.away-{b}")
    done = S.add_batch(spark, base, entries(spark, late), "late")
    changed = {r[0] for r in entries(spark, late[:1]).select(S._bucket(32)).collect()}
    assert done.touched == hit and done.rewritten == changed      # "twice" changes no earlier label
    for f in glob.glob(f"{base}/data/*/*/.away-*"):
        os.rename(f, f.replace(".away-", f"{S.BUCKET}="))
    assert kept(spark, base) == full(spark, given + late)
    assert all(S.read_store(spark, base).entries[b] == before.entries[b] for b in set(range(32)) - hit)


def test_repeated_empty_and_conflicting_batches(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "s")
    assert S.read_entries(spark, base) is None
    none = spark.createDataFrame([], SCHEMA)
    assert S.add_batch(spark, base, none, "none", buckets=2).touched == frozenset()
    assert S.read_entries(spark, base) is None
    S.add_batch(spark, base, entries(spark, EDGE), "a")
    S.add_batch(spark, base, entries(spark, EDGE), "a")           # delivered again
    assert kept(spark, base) == full(spark, EDGE)

    stale = S.read_store(spark, base)
    S.add_batch(spark, base, entries(spark, EDGE[:3]), "b")
    monkeypatch.setattr(S, "read_store", lambda *_: stale)
    with pytest.raises(CommitConflict):
        S.add_batch(spark, base, entries(spark, EDGE[3:5]), "c")
    monkeypatch.undo()
    assert kept(spark, base) == full(spark, EDGE + EDGE[:3])
    assert len(rows(S.read_entries(spark, base, 2), N.TYPE)) == len(EDGE)      # an earlier commit stays readable


def test_parts_of_a_bucket_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_PARTS", 2)
    base = str(tmp_path / "s")
    given = [(str(i), "hot", "Order") for i in range(5)]
    for e in given:
        S.add_batch(spark, base, entries(spark, [e]), e[0], buckets=1)
        assert len(S.read_store(spark, base).entries[0]) <= 2
    assert kept(spark, base) == full(spark, given)
