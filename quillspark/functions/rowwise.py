"""Columns that a Python function works out from a row's own columns, in Arrow batches: no row leaves its partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def added(rows: DataFrame, inputs: tuple[str, ...], f: Callable, kind: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns of kind ("name type, ..."): the tuple that f(*inputs) gives for a row, nulls where it gives None. The columns in drop go."""
    new = [x.split() for x in kind.split(",")]
    names = rows.columns
    kept = [i for i, n in enumerate(names) if n not in drop]
    at, schema = [names.index(n) for n in inputs], rows.select(*[names[i] for i in kept]).schema
    for n, k in new:
        schema = schema.add(n, DataType.fromDDL(k))
    none = (None,) * len(new)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            done = [none if (x := f(*r)) is None else x for r in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            cols = list(zip(*done, strict=True)) if done else [()] * len(new)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c, KINDS[k]) for c, (_, k) in zip(cols, new, strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
