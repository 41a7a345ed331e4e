"""CSV files that one task each reads stay small."""

import os

from sellerlens.session import scratch_path
from sellerlens.sinks.csv import read_csv, write_csv
from tests.conftest import rows


def test_csv_files_are_bounded_whatever_a_task_holds(spark):
    df = spark.range(0, 1000, 1, 1).selectExpr("id", "concat(' a\n\"', id, '\" ') AS text")
    path = write_csv(df, scratch_path(spark, "test-csv"), rows_per_file=150)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 7
    assert sorted(rows(read_csv(spark, path, df.schema, multi_line=True))) == sorted(rows(df))
