"""Reductions: typed built-in ones with identities, user-defined ones in two phases, folds and top-k."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.ranges import block_of, col

BITS = {"short": 16, "int": 32, "long": 64}
REAL = ("float", "double")
#: What a maximum over no values is where the smallest positive number stands in for it.
TINY = {"float": 1.401298464324817e-45, "double": 4.9e-324}


def wrapped(total: Column, bits: int) -> Column:
    """An exact decimal total as a two's complement integer of so many bits."""
    half = F.lit(str(1 << (bits - 1))).cast("decimal(38,0)")
    span = F.lit(str(1 << bits)).cast("decimal(38,0)")
    return (F.pmod(total.cast("decimal(38,0)") + half, span) - half).cast({16: "short", 32: "int", 64: "long"}[bits])


#: The largest finite numbers of both real types.
LARGEST = {"float": 3.4028234663852886e38, "double": 1.7976931348623157e308}


def identity(op: str, kind: str, compat: bool = False) -> Any:
    """What a reduction of no values gives. ``compat``: maxima of real numbers start at the smallest positive one."""
    if op in ("and", "or"):
        return op == "and"
    if op in ("sum", "prod"):
        return (0.0 if kind in REAL else 0) if op == "sum" else (1.0 if kind in REAL else 1)
    if kind in REAL:
        if compat:
            return TINY[kind] if op == "max" else LARGEST[kind]
        return float("-inf") if op == "max" else float("inf")
    top = (1 << (BITS[kind] - 1)) - 1
    return -top - 1 if op == "max" else top


def reduction(op: str, value: Column | str, kind: str = "long", wrap: bool = False, compat: bool = False) -> Column:
    """An aggregate column: ``op`` is and, or, sum, prod, max or min over values of type ``kind``.

    Nulls are skipped; NaN never wins a maximum or minimum; no values give the identity. Sums of
    integers are long and fail on overflow, or with ``wrap`` wrap around in the width of ``kind``.
    ``prod`` of integers is computed in double precision, which is exact to 2 ** 53, and fails beyond
    (see :func:`exact_product` and :func:`product_by`, which wrap around).
    """
    v = col(value)
    none = F.lit(identity(op, kind, compat))
    if op == "and":
        return F.coalesce(F.bool_and(v), none)
    if op == "or":
        return F.coalesce(F.bool_or(v), none)
    if op == "sum" and kind in BITS:
        return wrapped(F.coalesce(F.sum(v.cast("decimal(20,0)")), F.lit(0)), BITS[kind]) if wrap else F.coalesce(F.sum(v.cast("long")), F.lit(0).cast("long"))
    if op == "sum":
        return F.coalesce(F.sum(v.cast(kind)), none.cast("double")).cast(kind)
    if op == "prod":
        product = F.coalesce(F.product(v.cast("double")), F.lit(1.0))
        return product if kind in REAL else F.when(F.abs(product) <= float(1 << 53), product.cast("long")).otherwise(F.raise_error(F.lit("product beyond 2 ** 53: use exact_product or product_by")).cast("long"))
    if kind in REAL:
        v = F.when(~F.isnan(v), v)
    best = F.max(v) if op == "max" else F.min(v)
    if compat and kind in REAL and op == "max":
        return F.greatest(F.coalesce(best, none), none).cast(kind)
    return F.coalesce(best, none.cast(kind)).cast(kind)


def reduce_frame(df: DataFrame, **reductions: Column) -> DataFrame:
    """One row with the named reductions; partial results are combined before the shuffle."""
    return df.agg(*[c.alias(name) for name, c in reductions.items()])


def exact_product(df: DataFrame, value: Column | str, bits: int = 64) -> int:
    """The product of integers, wrapped to ``bits``: one partial product a task comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.ones(1, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                total *= np.multiply.reduce(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(total)], ["p"])

    product = 1
    for row in df.select(col(value).cast("long")).mapInArrow(run, "p long").collect():
        product = product * row.p % (1 << 64)
    product %= 1 << bits
    return product - (1 << bits) if product >> (bits - 1) else product


def product_by(df: DataFrame, value: Column | str, *by: str, bits: int = 64) -> DataFrame:
    """(by, product): each group's product of integers, wrapped to ``bits``. A task multiplies what it has of a group,
    and those partial products, a row a task, are multiplied again where the group meets."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, int] = {}
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
            for key, v in zip(keys, batch.column("product").to_pylist(), strict=True):
                found[key] = found.get(key, 1) * (1 if v is None else v) % (1 << 64)
        if found:
            columns = [pa.array(x) for x in zip(*found, strict=True)]
            signed = [p - (1 << 64) if p >> 63 else p for p in found.values()]
            yield pa.RecordBatch.from_arrays([*[c.cast(batch.schema.field(n).type) for c, n in zip(columns, by, strict=True)], pa.array(signed, pa.int64())], [*by, "product"])

    def again(rows: pa.Table) -> pa.Table:
        product = 1
        for v in rows.column("product").to_pylist():
            product = product * v % (1 << bits)
        return rows.slice(0, 1).set_column(len(by), "product", pa.array([product - (1 << bits) if product >> (bits - 1) else product], pa.int64()))

    own = df.select(*by, col(value).cast("long").alias("product"))
    return own.mapInArrow(first, own.schema).groupBy(*by).applyInArrow(again, own.schema)


class Reducer(ABC):
    """A user-defined reduction. States must be picklable; ``merge`` must be associative and commutative."""

    @abstractmethod
    def zero(self) -> Any:
        """A fresh state."""

    @abstractmethod
    def reduce(self, state: Any, row: Any) -> Any:
        """The state after one more row."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """One state for two."""

    def result(self, state: Any) -> Any:
        return state


class FoldReducer(Reducer):
    """A reducer made of functions."""

    def __init__(self, zero: Callable[[], Any], reduce: Callable, merge: Callable, result: Callable = lambda s: s):
        self._zero, self._reduce, self._merge, self._result = zero, reduce, merge, result

    def zero(self) -> Any:
        return self._zero()

    def reduce(self, state: Any, row: Any) -> Any:
        return self._reduce(state, row)

    def merge(self, a: Any, b: Any) -> Any:
        return self._merge(a, b)

    def result(self, state: Any) -> Any:
        return self._result(state)


def reduce_with(df: DataFrame, reducer: Reducer, *columns: str, fan_in: int = 64) -> Any:
    """``reducer`` over the rows (dicts of ``columns``): a state a task, merged in groups of ``fan_in``
    on the executors until so few are left that the driver merges them."""

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = reducer.zero()
        for batch in batches:
            for row in batch.to_pylist():
                state = reducer.reduce(state, row)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["s"])

    def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = reducer.zero()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                state = reducer.merge(state, pickle.loads(s))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["s"])

    states = (df.select(*columns) if columns else df).mapInArrow(first, "s binary")
    parts = df.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        states = states.repartition(parts).mapInArrow(again, "s binary")
    state = reducer.zero()
    for row in states.collect():
        state = reducer.merge(state, pickle.loads(bytes(row.s)))
    return reducer.result(state)


def team_reduction(df: DataFrame, reduced: DataFrame) -> DataFrame:
    """Every row of ``df`` with the one row of ``reduced``, as when all members of a team get the result."""
    return df.join(F.broadcast(reduced.limit(1)), F.lit(True), "left")


def fold(df: DataFrame, zero: Column | None, step: Callable[[Column, Column], Column], *values: str, order: str = "idx") -> DataFrame:
    """An ordered fold that needn't be associative: one row ``result``.

    With ``zero`` steps take the state and a struct of ``values``. Without it they take two values of
    the one column named, the first element is where it starts, and an empty list gives null. The
    values are gathered in one place, in order, so this is for lists that fit there; associative
    folds are reductions, or :func:`fold_in_levels` where the order matters.
    """
    rows = F.array_sort(F.collect_list(F.struct(order, *values)))
    if zero is not None:
        return df.agg(F.aggregate(rows, zero, step).alias("result"))
    plain = df.agg(F.transform(rows, lambda x: x[values[0]]).alias("v"))
    return plain.select(F.aggregate(F.slice("v", 2, F.greatest(F.size("v"), F.lit(1))), F.get("v", F.lit(0)), step).alias("result"))


#: Blocks of indices that a level of a fold puts together.
FAN = 256


def fold_in_levels(df: DataFrame, step: Callable[[Column, Column], Column], value: str, order: str = "idx") -> DataFrame:
    """An ordered fold of ``value`` by a step that is associative: one row ``result``, null for an empty list.

    Blocks of ``FAN`` indices are folded, then ``FAN`` blocks in order, and so on, so that no task gathers the list and
    a step on long values is taken few times. A null index comes last; of equal ones the lesser value comes first.
    """
    idx = F.col(order).cast("long")
    rows = df.select(idx.alias("k"), F.col(value).alias("v"))
    low, high = rows.agg(F.min("k"), F.max("k")).first()
    width = 1
    while True:
        last = low is None or high // width - low // width < FAN
        width *= FAN
        by = [] if last else [block_of("k", width).alias("b")]
        at = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"), F.col("v").alias("v"))
        values = F.transform(F.array_sort(F.collect_list(at)), lambda x: x["v"])
        plain = rows.groupBy(*by).agg(F.min("k").alias("k"), values.alias("v"))
        done = F.aggregate(F.slice("v", 2, F.greatest(F.size("v"), F.lit(1))), F.get("v", F.lit(0)), step)
        if last:
            return plain.select(done.alias("result"))
        rows = plain.select("k", done.alias("v"))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first ``k`` rows in an order: each task keeps ``k``, no full sort."""
    return df.orderBy(*order).limit(k)
