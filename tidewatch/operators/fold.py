"""Sequential folds per symbol, or per stretch of a symbol, over ordered rows, in bounded memory.

Rows are partitioned by their key and sorted inside partitions by the JVM, which spills; Python then sees Arrow batches of a
key one after another and keeps only the fold's state, so a symbol with very many rows is never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.shipping import ship

#: A fold: start() -> state, step(state, row as tuple of the read columns) -> output tuples, and end(state) -> those behind the last row.
Start = Callable[[], Any]
Step = Callable[[Any, tuple], list[tuple]]
End = Callable[[Any], list[tuple]]


def values(column: pa.Array) -> list:
    """Python values of a column; structs inside lists as tuples, which are far cheaper to make than dictionaries, and numbers by way
    of NumPy, which makes no object for each in between."""
    if pa.types.is_list(column.type) and (pa.types.is_struct(column.type.value_type) or not column.null_count):
        inner = column.flatten()
        each = list(zip(*(values(inner.field(k)) for k in range(inner.type.num_fields)), strict=True)) if pa.types.is_struct(inner.type) else values(inner)
        out, at = [], 0
        for n in values(column.value_lengths().fill_null(0)):
            out.append(each[at : at + n])
            at += n
        return out
    if not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def keys_of(b: pa.RecordBatch, by: Sequence[str]) -> Iterator[tuple]:
    """The key of each row; texts, of which sorted rows have few, are made once each."""
    columns = []
    for c in by:
        column = b.column(c)
        if pa.types.is_string(column.type) and not column.null_count:
            coded = column.dictionary_encode()
            names = coded.dictionary.to_pylist()
            columns.append([names[i] for i in values(coded.indices)])
        else:
            columns.append(values(column))
    return zip(*columns, strict=True)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _folding(by: tuple[str, ...], read: list[str], start: Start, step: Step, schema: T.StructType, end: End | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        last, state = None, None
        out: list[tuple] = []
        for b in batches:
            for key, row in zip(keys_of(b, by), zip(*(values(b.column(c)) for c in read), strict=True), strict=True):
                if key != last:
                    if end and last:
                        out += [(last[0], *x) for x in end(state)]
                    last, state = key, start()
                for x in step(state, row):
                    out.append((key[0], *x))
            if out:
                yield batch_of(out, arrow)
                out = []
        if end and last:
            out = [(last[0], *x) for x in end(state)]
            if out:
                yield batch_of(out, arrow)

    return run


def fold(rows: DataFrame, order: list[str], read: list[str], start: Start, step: Step, out: str, by: tuple[str, ...] = ("symbol",), end: End | None = None) -> DataFrame:
    """``symbol`` and the columns of ``out``, from one pass over each symbol's rows in ``order``; ``by`` may cut symbols further."""
    ship(rows.sparkSession)
    schema = T.StructType([T.StructField("symbol", T.StringType()), *T.StructType.fromDDL(out).fields])
    columns = list(dict.fromkeys([*by, *order, *read]))
    dealt = rows.select(*columns).repartition(*by).sortWithinPartitions(*by, *order)
    return dealt.mapInArrow(_folding(by, read, start, step, schema, end), schema)
