"""Order-dependent folds: every group's rows in order, with a state carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.operators.relational import spread


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], result: str, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple]], reads: list[str]) -> DataFrame:
    """The rows with the columns that ``step`` gives each: ``step(state, values of reads) -> (state, values of result)``.

    Rows are dealt by the keys and sorted within their tasks; batches stream through, and only the state of the present group is held, so a
    group of any size needs no more memory than a row. Null keys are a group of their own. ``order`` must decide all ties that matter.
    """
    names, schema = rows.columns, rows.schema.simpleString()[7:-1]
    key_at, read_at = [names.index(k) for k in keys], [names.index(c) for c in reads]
    added = [part.split()[0] for part in result.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in read_at]
            groups = zip(*[batch.column(i).to_pylist() for i in key_at], strict=True)
            out: list[list] = [[] for _ in added]
            for key, *values in zip(groups, *columns, strict=True):
                if key != held or state is None:
                    held, state = key, start()
                state, given = step(state, tuple(values))
                for column, value in zip(out, given, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]], [*names, *added])

    kinds = [_arrow(part.split()[1]) for part in result.split(", ")]
    return spread(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{schema}, {result}")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[kind]
