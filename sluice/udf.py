"""User-defined scalar, aggregate and table functions: a registry with signatures and counters.

A registered function can be called by name on the driver, and from SQL text and DataFrames on the executors. Scalar
functions run on Arrow batches, aggregates as grouped-aggregate pandas functions, table functions as Spark UDTFs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from sluice.errors import ArgumentError, DuplicateName, NotRegistered

#: Parameter types and the Python types that they accept; None fits any.
ACCEPTS: dict[str, tuple[type, ...]] = {
    "null": (), "boolean": (bool,), "int": (int,), "float": (float, int), "string": (str,), "bytes": (bytes, bytearray),
    "row": (tuple, list), "table": (list,), "any": (object,),
}
SPARK_TYPES = {"boolean": "boolean", "int": "bigint", "float": "double", "string": "string", "bytes": "binary"}


@dataclass(frozen=True)
class Signature:
    params: tuple[str, ...]
    returns: str = "any"
    variadic: bool = False

    def check(self, args: Sequence[Any]) -> None:
        if len(args) < len(self.params) if self.variadic else len(args) != len(self.params):
            raise ArgumentError(f"{len(args)} arguments; the function takes {len(self.params)}{' or more' if self.variadic else ''}")
        for i, a in enumerate(args):
            kind = self.params[min(i, len(self.params) - 1)] if self.params else "any"
            if a is None or kind == "any":
                continue
            if not isinstance(a, ACCEPTS[kind]) or (isinstance(a, bool) and kind in ("int", "float")):
                raise ArgumentError(f"argument {i + 1} is {type(a).__name__}, not {kind}")


@dataclass
class Metrics:
    calls: int = 0
    errors: int = 0
    seconds: float = 0.0
    slowest: float = 0.0

    @property
    def success_rate(self) -> float:
        return 1.0 if not self.calls else (self.calls - self.errors) / self.calls

    @property
    def mean_seconds(self) -> float:
        return self.seconds / self.calls if self.calls else 0.0


@dataclass
class ScalarUDF:
    name: str
    signature: Signature
    body: Callable[..., Any]

    def __call__(self, *args: Any) -> Any:
        self.signature.check(args)
        return self.body(*args)

    def register(self, spark: SparkSession) -> None:
        body = self.body
        spark.udf.register(self.name, F.udf(lambda *a: body(*a), SPARK_TYPES[self.signature.returns], useArrow=True))


class Aggregate:
    """State of an aggregate function: subclass it."""

    def accumulate(self, *values: Any) -> None:
        raise NotImplementedError

    def finalize(self) -> Any:
        raise NotImplementedError


@dataclass
class AggregateUDF:
    name: str
    signature: Signature
    factory: Callable[[], Aggregate]

    def __call__(self, rows: Iterable[Sequence[Any]]) -> Any:
        state = self.factory()
        for r in rows:
            r = r if isinstance(r, (tuple, list)) else (r,)
            self.signature.check(r)
            state.accumulate(*r)
        return state.finalize()

    def register(self, spark: SparkSession) -> None:
        import pandas as pd

        factory = self.factory

        def run(*columns: pd.Series) -> Any:
            state = factory()
            for row in zip(*columns):
                state.accumulate(*[None if x is None or x != x else x for x in row])
            return state.finalize()

        kind = SPARK_TYPES[self.signature.returns]
        names = [f"a{i}" for i in range(len(self.signature.params))]
        # pandas functions read their number of columns from the signature, so it is spelt out
        grouped = {1: lambda a0: run(a0), 2: lambda a0, a1: run(a0, a1), 3: lambda a0, a1, a2: run(a0, a1, a2)}[len(names)]
        grouped.__annotations__ = {n: pd.Series for n in names} | {"return": {"bigint": int, "double": float, "string": str, "boolean": bool, "binary": bytes}[kind]}
        spark.udf.register(self.name, F.pandas_udf(grouped, kind))


@dataclass
class TableUDF:
    name: str
    signature: Signature
    schema: StructType | str
    body: Callable[..., Iterable[Sequence[Any]]]

    def __call__(self, *args: Any) -> list[tuple]:
        self.signature.check(args)
        return [tuple(r) for r in self.body(*args)]

    def register(self, spark: SparkSession) -> None:
        body = self.body

        class Run:
            def eval(self, *args: Any):
                yield from (tuple(r) for r in body(*args))

        schema = _parse_datatype_string(self.schema) if isinstance(self.schema, str) else self.schema
        spark.udtf.register(self.name, F.udtf(Run, returnType=schema))


Function = ScalarUDF | AggregateUDF | TableUDF


@dataclass
class Registry:
    spark: SparkSession | None = None
    functions: dict[str, Function] = field(default_factory=dict)
    counters: dict[str, Metrics] = field(default_factory=dict)

    def register(self, function: Function) -> None:
        if function.name in self.functions:
            raise DuplicateName(function.name)
        if self.spark is not None:
            function.register(self.spark)
        self.functions[function.name] = function
        self.counters[function.name] = Metrics()

    def unregister(self, name: str) -> None:
        if name not in self.functions:
            raise NotRegistered(name)
        del self.functions[name], self.counters[name]
        if self.spark is not None:
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def list(self) -> list[str]:
        return sorted(self.functions)

    def metrics(self, name: str) -> Metrics:
        if name not in self.counters:
            raise NotRegistered(name)
        return self.counters[name]

    def call(self, name: str, *args: Any) -> Any:
        if name not in self.functions:
            raise NotRegistered(name)
        m, began = self.counters[name], time.perf_counter()
        m.calls += 1
        try:
            return self.functions[name](*args)
        except Exception:
            m.errors += 1
            raise
        finally:
            took = time.perf_counter() - began
            m.seconds += took
            m.slowest = max(m.slowest, took)


def truthy(value: Any) -> bool:
    """What a trigger's condition takes for true: non-zero numbers, non-empty text, bytes and tables, True."""
    return bool(value)
