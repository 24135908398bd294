"""User-supplied functions over rows: extractors, predictors and rewards, with errors, deadlines and times by row.

`apply` runs a function in an Arrow map, so rows stay in their partitions and nothing is shuffled.  A row whose call raises, overruns its deadline
or gives a value that does not fit the declared type has a null result and an error text; all other rows are as they would be
without it.  `register` makes the same function a table function for SQL.
"""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, is_dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, LongType, StringType, StructField, StructType

from ..workers import ship

ERROR_CHARS = 500


class Overrun(BaseException):
    """Raised inside a call at its deadline; not an Exception, so that the call cannot take it for one of its own."""


@dataclass(frozen=True)
class UserFunction:
    """What a user supplies.

    call     a function of one row's inputs, or with batch of pyarrow arrays of many rows' inputs (giving a value for each)
    returns  DDL of a value: a scalar, a struct, or an array of structs for several rows out; structs are dicts, tuples or dataclasses
    deadline seconds for a row, None for none.  A call in Python code is stopped there; one inside a C library when it comes back
    files    Python files or archives that the workers need
    batch    A batch that fails or takes longer than deadline times its rows is called again row by row, so that only bad rows fail
    """

    call: Callable
    returns: str
    deadline: float | None = None
    files: tuple[str, ...] = ()
    batch: bool = False


def value_type(fn: UserFunction) -> DataType:
    return DataType.fromDDL(f"value {fn.returns}")["value"].dataType


def send(spark: SparkSession, fn: UserFunction) -> None:
    """Give the workers this package and the function's files."""
    ship(spark)
    for f in fn.files:
        spark.sparkContext.addPyFile(f)


def _plain(value: object) -> object:
    """Dataclasses as dicts, at any place of lists."""
    if is_dataclass(value) and not isinstance(value, type):
        return asdict(value)
    return [_plain(v) for v in value] if isinstance(value, list | tuple) and not hasattr(value, "_fields") else value


def fitted(value: object, kind: DataType) -> object:
    """value in the shape of a type, or TypeError: structs with unknown or too few fields do not fit."""
    value = _plain(value)
    if value is None:
        return None
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise TypeError(f"expected a list, got {type(value).__name__}")
        return [fitted(v, kind.elementType) for v in value]
    if isinstance(kind, StructType):
        if isinstance(value, list | tuple):
            if len(value) != len(kind):
                raise TypeError(f"expected {len(kind)} fields, got {len(value)}")
            value = dict(zip(kind.names, value, strict=True))
        if not isinstance(value, dict):
            raise TypeError(f"expected a struct, got {type(value).__name__}")
        if unknown := sorted(set(value) - set(kind.names)):
            raise TypeError(f"unknown fields: {', '.join(unknown)}")
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, DoubleType) and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, StringType) and not isinstance(value, str) or isinstance(kind, DoubleType) and not isinstance(value, float) or isinstance(kind, LongType) and (not isinstance(value, int) or isinstance(value, bool)):
        raise TypeError(f"expected {kind.simpleString()}, got {type(value).__name__}")
    return value


def _stop(*_) -> None:
    raise Overrun


def within(deadline: float | None, call: Callable, *inputs: object) -> object:
    """The value of a call, or TimeoutError at its deadline."""
    if deadline is None:
        return call(*inputs)
    late = TimeoutError(f"no result within {deadline:g} s")
    if threading.current_thread() is not threading.main_thread():  # no signals here: the wait ends, the call goes on unseen
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(call, *inputs).result(deadline)
        except TimeoutError:
            raise late from None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    before = signal.signal(signal.SIGALRM, _stop)
    try:
        signal.setitimer(signal.ITIMER_REAL, max(deadline, 1e-6))
        try:
            return call(*inputs)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
    except Overrun:
        raise late from None
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def guarded(fn: UserFunction, kind: DataType, arrow: pa.DataType, inputs: tuple) -> tuple[object, str | None, float]:
    """(value, error, seconds) of one row."""
    began = time.monotonic()
    try:
        value = fitted(within(fn.deadline, fn.call, *inputs), kind)
        pa.array([value], arrow)
        return value, None, time.monotonic() - began
    except Exception as e:  # one bad row must not take the others with it
        return None, f"{type(e).__name__}: {e}"[:ERROR_CHARS], time.monotonic() - began


def _of_batch(fn: UserFunction, kind: DataType, arrow: pa.DataType, inputs: list[pa.Array]) -> list[tuple]:
    n = len(inputs[0])
    began = time.monotonic()
    try:
        got = within(None if fn.deadline is None else fn.deadline * n, fn.call, *inputs)
        values = got.to_pylist() if isinstance(got, pa.Array | pa.ChunkedArray) else list(got)
        if len(values) != n:
            raise TypeError(f"{len(values)} values for {n} rows")
        values = [fitted(v, kind) for v in values]
        pa.array(values, arrow)
        return [(v, None, (time.monotonic() - began) / n) for v in values]
    except Exception as e:
        if n == 1:
            return [(None, f"{type(e).__name__}: {e}"[:ERROR_CHARS], time.monotonic() - began)]
        return [_of_batch(fn, kind, arrow, [x.slice(i, 1) for x in inputs])[0] for i in range(n)]


def apply(df: DataFrame, fn: UserFunction, inputs: list[str], out: str = "result") -> DataFrame:
    """df with out, out_error (null if all went well) and out_seconds; a null in the inputs reaches the function as None."""
    names = [out, f"{out}_error", f"{out}_seconds"]
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in names}:
        raise ValueError(f"columns are taken: {', '.join(sorted(clash))}")
    if missing := [c for c in inputs if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    kind = value_type(fn)
    schema = StructType([*df.schema, StructField(out, kind), StructField(names[1], StringType()), StructField(names[2], DoubleType())])
    added = to_arrow_schema(StructType(schema.fields[-3:]))
    send(df.sparkSession, fn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in inputs]
            if not len(batch):
                rows = []
            elif fn.batch:
                rows = _of_batch(fn, kind, added.field(0).type, columns)
            else:
                rows = [guarded(fn, kind, added.field(0).type, x) for x in zip(*[c.to_pylist() for c in columns], strict=True)]
            new = [pa.array([r[i] for r in rows], added.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def rows_out(applied: DataFrame, keep: list[str], out: str = "result", position: str = "pos") -> DataFrame:
    """One row for each element of array results: keep, position and the element's fields; failed and empty rows give none."""
    each = applied.select(*keep, F.posexplode(out).alias(position, "__e"))
    return each.select(*keep, position, "__e.*")


def register(spark: SparkSession, name: str, fn: UserFunction) -> None:
    """Make fn a table function: SELECT ... FROM t, LATERAL name(t.text).

    Array results give a row for each element, others one; every row carries `error`, and a failed call gives one row of nulls with it.
    """
    kind = value_type(fn)
    element = kind.elementType if isinstance(kind, ArrayType) else kind
    fields = element.fields if isinstance(element, StructType) else [StructField("value", element)]
    arrow = to_arrow_schema(StructType([StructField("v", kind)])).field(0).type
    send(spark, fn)
    row_fn = fn if not fn.batch else UserFunction(lambda *x: fn.call(*[pa.array([v]) for v in x])[0].as_py(), fn.returns, fn.deadline)

    class Rows:
        def eval(self, *inputs):
            value, error, _ = guarded(row_fn, kind, arrow, inputs)
            if error is not None:
                yield (*[None] * len(fields), error)
                return
            for v in (value or []) if isinstance(kind, ArrayType) else [value]:
                yield (*(v.values() if isinstance(v, dict) else [v]), None)

    spark.udtf.register(name, F.udtf(Rows, returnType=StructType([*fields, StructField("error", StringType())])))


def outcomes(applied: DataFrame, by: list[str], out: str = "result") -> DataFrame:
    """Calls, failures, failures at the deadline and seconds, by group."""
    error = F.col(f"{out}_error")
    return applied.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if(error.isNotNull()).alias("failed"), F.count_if(F.coalesce(error.startswith("TimeoutError"), F.lit(False))).alias("late"), F.sum(f"{out}_seconds").alias("seconds"),
    )
