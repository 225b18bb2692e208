import pytest
from pyspark.sql import functions as F

from equigauge.sinks.cells import CellStore

KEYS = ("code", "year")


def roll_up(df):
    return df.groupBy(*KEYS).agg(
        F.count("*").alias("cases"), F.sum("cost").cast("decimal(38,2)").alias("cost"), F.sum("days").alias("days")
    )


def records(spark, rows):
    return spark.createDataFrame(rows, "code string, year int, cost decimal(12,2), days long")


def batch(spark, i, n=30):
    from decimal import Decimal

    return records(
        spark,
        [(None if k % 7 == 0 else f"c{k % (3 + i)}", 2019 + k % 2, Decimal(k) / 4, None if k % 5 == 0 else k) for k in range(n)],
    )


def rows(df):
    return sorted(map(tuple, df.select("code", "year", "cases", "cost", "days").collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return CellStore(spark, str(tmp_path / "cells"), roll_up, KEYS)


def test_batches_add_up_to_one_roll_up(spark, store):
    every = batch(spark, 0)
    store.add(every, 0)
    assert rows(store.read()) == rows(roll_up(every))
    for i in (1, 2):
        store.add(batch(spark, i), i)
        store.add(batch(spark, i), i)
        every = every.union(batch(spark, i))
        assert rows(store.read()) == rows(roll_up(every))
    assert store.fold() == 0 and store.fold() is None
    assert rows(store.read()) == rows(roll_up(every))
    # A batch that the base holds is not counted again.
    store.add(batch(spark, 1), 1)
    store.add(batch(spark, 5), 5)
    assert store.batches() == {0, 1, 2, 5} and store.folded() == {0, 1, 2}
    every = every.union(batch(spark, 5))
    assert rows(store.read()) == rows(roll_up(every))
    assert store.fold() == 1 and rows(store.read()) == rows(roll_up(every))
    assert store.read().dtypes == roll_up(every).dtypes


def test_interrupted_folds_change_nothing(spark, store, monkeypatch):
    store.add(batch(spark, 0), 0)
    store.fold()
    store.add(batch(spark, 1), 1)
    want = rows(roll_up(batch(spark, 0).union(batch(spark, 1))))
    with monkeypatch.context() as m:
        m.setattr(CellStore, "_merged", lambda self, tables: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.fold()
    assert store.folded() == {0} and rows(store.read()) == want
    # The new version is complete, but its parts could not be deleted.
    monkeypatch.setattr("equigauge.sinks.cells.delete_folder", lambda *a: None)
    assert store.fold() == 1
    assert rows(store.read()) == want and store.fold() is None


def test_empty_store_and_empty_batch(spark, store):
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.fold() is None
    store.add(batch(spark, 0).limit(0), 0)
    assert store.read().count() == 0 and store.batches() == {0}


def test_only_the_new_batch_is_read(spark, store, tmp_path):
    """The plan of an addition scans the records of its batch, that of a fold cells alone."""
    for i in (0, 1):
        batch(spark, i).write.parquet(str(tmp_path / f"records-{i}"))
        store.add(spark.read.parquet(str(tmp_path / f"records-{i}")), i)
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    scanned = {f for f in store.read().inputFiles()}
    assert plan.count("Relation") == 2 and all("/parts/batch=" in f for f in scanned)
