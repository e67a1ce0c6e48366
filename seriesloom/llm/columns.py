"""Column names that may be anything, and columns that Arrow functions add to a table."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows whose new columns a worker holds at a time, and bytes of their texts if there is more than one.
ROWS, BYTES = 512, 1 << 22


def named(column: str) -> Column:
    """The column of exactly that name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def spare(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, in either case: those wanted, with as many underscores more as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def array(values: Iterable, kind: pa.DataType) -> pa.Array:
    """An array without nulls of numbers, bytes or lists of numbers; ``pa.array`` would load pandas into each worker, about 25 MB."""
    values = list(values)
    if not (pa.types.is_list(kind) or pa.types.is_binary(kind)):
        return pa.Array.from_buffers(kind, len(values), [None, pa.py_buffer(np.array(values, str(kind)))])
    ends = np.cumsum([0, *map(len, values)])
    if ends[-1] >= 1 << 31:
        raise OverflowError("a column of a batch holds 2 GB")
    offsets = pa.py_buffer(ends.astype(np.int32))
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(values), [None, offsets, pa.py_buffer(b"".join(values))])
    flat = np.concatenate(values) if values and isinstance(values[0], np.ndarray) else np.array(list(chain.from_iterable(values)))
    inner = pa.Array.from_buffers(kind.value_type, len(flat), [None, pa.py_buffer(flat.astype(str(kind.value_type)))])
    return pa.Array.from_buffers(kind, len(values), [None, offsets], children=[inner])


def give_back() -> None:
    """What is free in this worker goes back to the system: workers outlive their tasks, and their memory is the executor's too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, at most ROWS at a time and at most BYTES of the string or binary column ``at``, or one row that has more."""
    for whole in batches:
        if not whole.num_rows:
            continue
        column = whole.column(at)
        width = "int64" if column.type in (pa.large_string(), pa.large_binary()) else "int32"
        ends, first = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1], 0
        while first < whole.num_rows:
            fit = int(np.searchsorted(ends, int(ends[first]) + BYTES, "right")) - 1
            stop = min(max(fit, first + 1), first + ROWS, whole.num_rows)
            yield whole.slice(first, stop - first)
            first = stop
        del whole, column, ends
        give_back()


def extended(df: DataFrame, source: str, fields: Sequence[T.StructField], task: Callable[[], Callable[[pa.Array], list[pa.Array]]], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` without the columns ``drop`` and with ``fields`` at the end, which take the place of columns of their names.

    ``task`` runs once in each task and returns what makes the new columns of a
    batch from the column ``source``.  All other columns pass through untouched,
    and the text crosses to Python once.
    """
    gone = {*drop, *(f.name for f in fields)}
    keep = [k for k, c in enumerate(df.columns) if c not in gone]
    at, names = df.columns.index(source), [f.name for f in fields]
    kept = [df.schema.fields[k] for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = task()
        for b in slices(batches, at):
            new = make(b.column(at))
            schema = pa.schema([*[b.schema.field(k).with_name(f.name) for k, f in zip(keep, kept, strict=True)], *[pa.field(n, x.type) for n, x in zip(names, new, strict=True)]])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *new], schema=schema)
            del b, new  # before the next batch is read
        del make
        give_back()

    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # mapInArrow looks columns up by names, which may be no identifiers
    return plain.mapInArrow(run, T.StructType([*kept, *fields]))


def raw(x: pa.Scalar) -> bytes:
    """The bytes of a string or binary cell; null is empty."""
    return x.as_buffer().to_pybytes() if x.is_valid else b""
