import pytest
from pyspark.sql import functions as F

from sellerlens import catalog
from sellerlens import names as N
from sellerlens.sinks import snapshots, tables as sink
from sellerlens.sources.files import Tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def small(spark):
    """Two versions of the tables that differ in each of them."""
    t = catalog.tables(spark, SF_SMALL)
    cut = Tables(t.orders.limit(50), t.income.limit(40), t.overview.limit(3))
    return cut, \
        Tables(t.orders.limit(70), t.income.limit(60), t.overview.limit(5))


def counts(t):
    return t.orders.count(), t.income.count(), t.overview.count()


def test_readers_keep_their_version(spark, small, tmp_path):
    base = f"file://{tmp_path}/store"
    assert snapshots.latest(spark, base) is None and snapshots.read_snapshot(spark, base) is None
    first = snapshots.write_snapshot(spark, small[0], base)
    pinned = snapshots.read_snapshot(spark, base)
    second = snapshots.write_snapshot(spark, small[1], base)
    assert (first.number, second.number) == (1, 2) and snapshots.latest(spark, base) == second
    assert counts(pinned) == (50, 40, 3) and counts(snapshots.read_snapshot(spark, base)) == (70, 60, 5)
    assert counts(snapshots.read_snapshot(spark, base, 1)) == (50, 40, 3)
    assert snapshots.read_snapshot(spark, base, 9) is None
    assert pinned.orders.columns == small[0].orders.columns and N.ORDER_MONTH in pinned.orders.columns
    assert snapshots.drop_old(spark, base) == [first.version]
    assert snapshots.read_snapshot(spark, base, 1) is None and counts(snapshots.read_snapshot(spark, base)) == (70, 60, 5)


@pytest.mark.parametrize("dies_at", ["income", "overview", "commit"])
def test_a_writer_that_dies_leaves_the_last_version(spark, small, tmp_path, monkeypatch, dies_at):
    base = f"file://{tmp_path}/store"
    snapshots.write_snapshot(spark, small[0], base)
    boom = F.raise_error(F.lit("the writer dies")).cast("string")
    if dies_at == "commit":
        def write_and_die(*a, **k):
            sink.write_tables(*a, **k)
            raise RuntimeError("the writer dies")
        monkeypatch.setattr(snapshots, "write_tables", write_and_die)
        bad = small[1]
    else:
        broken = getattr(small[1], dies_at)
        broken = broken.withColumn(broken.columns[0], boom)
        bad = Tables(small[1].orders, *[broken if k == dies_at else getattr(small[1], k) for k in ("income", "overview")])
    with pytest.raises(Exception, match="the writer dies"):
        snapshots.write_snapshot(spark, bad, base)
    monkeypatch.undo()
    assert counts(snapshots.read_snapshot(spark, base)) == (50, 40, 3)
    after = snapshots.write_snapshot(spark, small[1], base)
    assert after.number == 2 and counts(snapshots.read_snapshot(spark, base)) == (70, 60, 5)
    assert len(snapshots.drop_old(spark, base, keep=2)) == 1           # what the dead writer left


def test_two_writers_at_once(spark, small, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/store"
    real = snapshots.write_tables

    def slow(tables, path, mode):
        monkeypatch.setattr(snapshots, "write_tables", real)
        snapshots.write_snapshot(spark, small[1], base)                # the other one is faster
        return real(tables, path, mode=mode)

    monkeypatch.setattr(snapshots, "write_tables", slow)
    with pytest.raises(snapshots.CommitConflict):
        snapshots.write_snapshot(spark, small[0], base)
    assert counts(snapshots.read_snapshot(spark, base)) == (70, 60, 5)


def test_the_last_version_cannot_be_dropped(spark, tmp_path):
    with pytest.raises(ValueError):
        snapshots.drop_old(spark, f"file://{tmp_path}", keep=0)
    assert snapshots.drop_old(spark, f"file://{tmp_path}") == []
