"""Ordered scans: all rows of a document, in order, by one Python function."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a batch that is given back.
BATCH_ROWS = 1000


def scan_documents(rows: DataFrame, scan: Callable[[list[dict]], Iterable[dict]], schema: str | StructType, key: str = "doc_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """What scan() makes of each document's rows, which it gets as dictionaries in order.

    Rows are dealt out by the key and sorted in each task, and stream through Python in Arrow batches: a task holds one
    document at a time. A document whose key is null is one document.
    """
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    made = to_arrow_schema(kind)

    def run(batches):
        held: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] != held[0][key]:
                    out.extend(scan(held))
                    held = []
                held.append(row)
                if len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=made)
                    out = []
        if held:
            out.extend(scan(held))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=made)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)
