"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of output are handed back to Spark in batches of about this size.
FLUSH_BYTES = 8 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once.

    Catalyst may inline an alias into each of its uses, also into lambda
    bodies that run per element; a lambda variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _weight(v) -> int:
    """About the bytes that a value takes, nested ones by their content."""
    if v is None or isinstance(v, (bool, int, float)):
        return 32
    if hasattr(v, "nbytes"):
        return 100 + v.nbytes
    if isinstance(v, dict):
        return 200 + sum(map(_weight, v.values()))
    if isinstance(v, (list, tuple)):
        return 60 + sum(map(_weight, v))
    return 60 + len(v)


def flat_map(df: DataFrame, make: Callable[[], Callable[..., Iterator[tuple]]],
             schema: T.StructType) -> DataFrame:
    """Apply a Python function row by row inside Arrow batches.

    ``make()`` runs once per task and returns ``fn(*row) -> iterable of
    output tuples``.  One input row is turned into Python objects at a time
    and output is flushed in small batches, so a task holds one Arrow batch
    and one row's work whatever the texts' lengths.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                for row in fn(*(c[i].as_py() for c in columns)):
                    out.append(row)
                    size += sum(map(_weight, row))
                    if size >= FLUSH_BYTES:
                        yield flush()
                        out.clear()
                        size = 0
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def flat_columns(df: DataFrame, make: Callable[[], Callable[..., list | None]],
                 schema: T.StructType) -> DataFrame:
    """Like ``flat_map``, for functions that return whole columns for a row:
    Arrow or numpy arrays of one length, or None for no output."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        held: list[list[pa.Array]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(c) for c in zip(*held)], schema=arrow)

        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                out = fn(*(c[i].as_py() for c in columns))
                if out is None:
                    continue
                out = [a if isinstance(a, pa.Array) else pa.array(a, f.type)
                       for a, f in zip(out, arrow)]
                held.append(out)
                size += sum(a.nbytes for a in out)
                if size >= FLUSH_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return df.mapInArrow(run, schema)


def stream(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Pass each partition's rows, in order, through one generator."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield from zip(*(c.slice(i, 256).to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for row in rows(given(batches)):
            out.append(row)
            size += sum(map(_weight, row))
            if size >= FLUSH_BYTES:
                yield flush()
                out.clear()
                size = 0
        if out:
            yield flush()

    return df.mapInArrow(run, schema)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_column(df: DataFrame, source: str, make: Callable[[], Callable], field: T.StructField,
                  rows: int = 128) -> DataFrame:
    """``df`` with a column computed from ``source``; the other columns pass
    through as Arrow arrays.  ``make()`` runs once per task and returns a
    function from an Arrow array of at most ``rows`` values to the new ones."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(field.dataType)
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            names = [*batch.schema.names, field.name]
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                new = fn(part.column(at))
                new = new if isinstance(new, pa.Array) else pa.array(new, kind)
                yield pa.RecordBatch.from_arrays([*part.columns, new], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, field]))
