"""JSON output: each part file is one array document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _array(batches):
    before = "["
    for b in batches:
        rows = b.column(0).to_pylist()
        if rows:
            yield pa.RecordBatch.from_pydict({"value": [before + rows[0], *["," + r for r in rows[1:]]]})
            before = ","
    yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write ``df`` as UTF-8 array documents, one a task, the form that
    ``sources.jsonarray`` reads; null fields are left out. Returns ``path``."""
    (df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
       .mapInArrow(_array, "value string").write.mode(mode).text(path))
    return path
