"""CSV output (SNK-1), written in parallel by the executors.

Options follow a pandas ``to_csv(index=False)``: header row, comma,
quotes only where needed, spaces at the ends of a text kept, a quote inside a field doubled (``""``), null
and empty text both written as an empty field, UTF-8, ``\\n`` line ends,
timestamps as ``yyyy-MM-dd HH:mm:ss``. Remaining differences: booleans
print ``true``/``false``, large doubles ``1.0E20``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
    "encoding": "UTF-8",
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "dateFormat": "yyyy-MM-dd",
}


# A file with line breaks in fields is read by one task, so a task that writes
# more rows than this begins another file.
ROWS_PER_FILE = 200_000


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE) -> str:
    """Write ``df`` as a folder of CSV part files (of ``rows_per_file`` rows at
    most, one or more per task) at ``path``."""
    df.write.mode(mode).options(**CSV_OPTIONS).option("maxRecordsPerFile", rows_per_file).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Read CSV written by :func:`write_csv` back with a known schema.

    ``multi_line`` reads fields that hold line breaks; a file is then one
    task, so large data should be in many files, as :func:`write_csv` makes them.
    """
    return spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line).schema(schema).csv(path)
