"""Folds over sorted rows, for what depends on all rows before: one pass of the workers over each partition, row by row.

Rows are dealt out by document and sorted; a fold sees them one after the other and starts anew with each document, so neither
a task nor the driver ever holds a document's rows, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Takes a row's input columns, gives its new columns. A fresh one is made for each document.
Step = Callable[..., tuple]
#: Takes a row's input columns, or none at the end of a document; gives rows.
Emit = Callable[..., Iterable[tuple]]


def _schema(columns: str | StructType) -> StructType:
    return columns if isinstance(columns, StructType) else StructType.fromDDL(columns)


def _starts(keys: pa.Array) -> list[int]:
    """Where runs of equal keys begin; nulls are equal. For structs, where those of any field do."""
    if not len(keys):
        return []
    columns = [keys.field(k) for k in range(keys.type.num_fields)] if pa.types.is_struct(keys.type) else [keys]
    if any(pa.types.is_nested(c.type) for c in columns) or pa.types.is_struct(keys.type) and keys.null_count:
        return list(range(len(keys)))
    begins = np.zeros(len(keys), bool)
    for c in columns:
        ends = np.asarray(pc.run_end_encode(c).run_ends)
        begins[ends[:-1]] = True
    begins[0] = True
    return np.flatnonzero(begins).tolist()


def add_columns(rows: DataFrame, order: str, inputs: list[str], start: Callable[[], Step], added: str, key: str = "doc_id") -> DataFrame:
    """``rows`` with the columns ``added`` (DDL), computed by a fold over ``inputs`` in the order of ``order``; columns of those names are replaced."""
    new = _schema(added)
    kept = rows.drop(*new.names) if set(new.names) & set(rows.columns) - set(inputs) else rows
    staged = kept.select("*", *(F.col(c).alias(f"_in{k}") for k, c in enumerate([key, *inputs])))
    n, arrow = len(kept.columns), to_arrow_schema(new)
    names = [*(c for c in kept.columns if c not in new.names), *new.names]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for part in parts:
            keys, *values = (c.to_pylist() for c in part.columns[n:])
            out = []
            for doc, *own in zip(keys, *values, strict=True):
                if step is None or doc != last:
                    last, step = doc, start()
                out.append(step(*own))
            made = [pa.array([r[k] for r in out], arrow.field(k).type) for k in range(len(arrow))]
            own = [c for c, name in zip(part.columns[:n], part.schema.names, strict=False) if name not in new.names]
            yield pa.RecordBatch.from_arrays([*own, *made], names)

    schema = StructType([*(f for f in kept.schema.fields if f.name not in new.names), *new.fields])
    return staged.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(batches, schema)


def emitted(rows: DataFrame, order: str, inputs: list[str], start: Callable[[], Emit], out: str | StructType, key: str = "doc_id", size: int = 4096) -> DataFrame:
    """What a fold gives for each row and at the end of each document, after the key: ``out`` names the columns (DDL or a type) behind it."""
    fields = _schema(out)
    schema = StructType([rows.schema[key], *fields.fields])
    arrow = to_arrow_schema(schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step, found = None, None, []
        seen: list[tuple[object, int]] = []  # keys, and how many rows were found up to the end of each

        def full() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [[] for _ in fields]
            ends = [n for _, n in seen] + [len(found)]
            docs = pa.array([*(doc for doc, _ in seen), last], arrow.field(0).type)
            docs = docs.take(pa.array(np.repeat(np.arange(len(ends)), np.diff([0, *ends]))))
            found.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([docs, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

        for part in parts:
            values = [c.to_pylist() for c in part.columns[1:]]
            starts = _starts(part.column(0))
            for at, end in zip(starts, [*starts, part.num_rows][1:], strict=True):
                doc = part.column(0)[at].as_py()
                if step is None or doc != last:
                    if step is not None:
                        found += step()
                        seen.append((last, len(found)))
                    last, step = doc, start()
                for own in zip(*(v[at:end] for v in values), strict=True):
                    found += step(*own)
                    if len(found) >= size:
                        yield full()
        if step is not None:
            found += step()
        yield full()

    return rows.select(key, *inputs, F.col(order).alias("_order")).repartition(F.col(key)).sortWithinPartitions(key, "_order").drop("_order").mapInArrow(batches, schema)
