"""Ordered folds over sorted rows, for rules that no window function expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 50_000


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence, start: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Rows of equal keys pass in order through one fold. ``start()`` gives (step, end) for each key: ``step(row)`` and ``end()``
    return lists of result rows. Rows are hashed by key, sorted (spilling to disk) and streamed in Arrow batches, so neither a group nor a
    partition has to fit into memory, and there is no cost per group. Values pass as Python objects, so integers of any size stay as they are."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)
    ordered = df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step, end = None, None, None
        out: list = []

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or row[:n] != current[0]:
                    if end is not None:
                        out += end()
                    current = (row[:n],)
                    step, end = start()
                out += step(row)
                if len(out) > SLICE:
                    yield batch_of(out)
                    out = []
        if end is not None:
            out += end()
        yield batch_of(out)

    return ordered.mapInArrow(run, schema)
