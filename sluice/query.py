"""The query builder: parameters, one row, an optional row, a scalar, an execution."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, Row

from sluice.errors import NoRows, ParameterError, TooManyRows, TypeMismatch
from sluice.plans.text import numbered_to_named

if TYPE_CHECKING:
    from sluice.engine import Engine


class Statement:
    """SQL text and its parameters: $1, $2 ... in turn, or :name; not both."""

    def __init__(self, engine: Engine, sql: str):
        self._engine, self._sql, self._positional, self._named = engine, sql, [], {}

    def bind(self, value: Any):
        self._positional.append(value)
        return self

    def param(self, name: str, value: Any):
        self._named[name] = value
        return self

    def _resolved(self) -> tuple[str, dict[str, Any]]:
        if self._positional and self._named:
            raise ParameterError("positional and named parameters in one statement")
        sql, most = numbered_to_named(self._sql)
        if most != len(self._positional):
            raise ParameterError(f"{len(self._positional)} values for {most} parameters")
        return sql, {f"p{i}": v for i, v in enumerate(self._positional, 1)} or self._named

    def df(self) -> DataFrame:
        sql, args = self._resolved()
        return self._engine.sql(sql, args)


def decoded(row: Row, kind: type | None) -> Any:
    """A row as a tuple, dict or dataclass; columns go to fields by name."""
    if kind is None or kind is Row:
        return row
    if kind is dict:
        return row.asDict(recursive=True)
    if dataclasses.is_dataclass(kind):
        values = {k.lower(): v for k, v in row.asDict(recursive=True).items()}
        missing = [f.name for f in dataclasses.fields(kind) if f.name.lower() not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if missing:
            raise TypeMismatch(f"no column for {missing}")
        return kind(**{f.name: values[f.name.lower()] for f in dataclasses.fields(kind) if f.name.lower() in values})
    if kind is tuple:
        return tuple(row)
    if len(row) == 1:
        return scalar(row[0], kind)
    raise TypeMismatch(f"a row of {len(row)} columns is no {kind.__name__}")


def scalar(value: Any, kind: type | None) -> Any:
    if kind is None or value is None:
        return value
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise TypeMismatch(f"{type(value).__name__} is no {kind.__name__}")
    return value


class Query(Statement):
    def __init__(self, engine: Engine, sql: str, kind: type | None = None):
        super().__init__(engine, sql)
        self._kind = kind

    def fetch_all(self) -> list:
        return [decoded(r, self._kind) for r in self.df().collect()]

    def fetch_first(self):
        row = self.df().first()
        return None if row is None else decoded(row, self._kind)


class QueryOne(Query):
    def fetch(self):
        """The only row; none or several are errors."""
        rows = self.df().limit(2).collect()
        if not rows:
            raise NoRows(self._sql)
        if len(rows) > 1:
            raise TooManyRows(self._sql)
        return decoded(rows[0], self._kind)


class QueryOptional(Query):
    def fetch(self):
        return self.fetch_first()


class QueryScalar(Query):
    def fetch(self):
        """The first row's first value, of exactly the wanted type."""
        row = self.df().first()
        if row is None:
            raise NoRows(self._sql)
        return scalar(row[0], self._kind)


class Execute(Statement):
    def run(self) -> int:
        """Runs a statement; returns the number of rows it changed, or a query's number of rows."""
        sql, args = self._resolved()
        return self._engine.execute_statement(sql, args)


class Prepared:
    """A statement with ? markers."""

    def __init__(self, engine: Engine, sql: str):
        self._engine, self.sql = engine, sql

    def execute(self, params: Sequence[Any] = ()) -> DataFrame:
        return self._engine.sql(self.sql, list(params))


class PlanCache:
    """Prepared statements by text; the least used goes first. Counts hits and misses."""

    def __init__(self, size: int = 128):
        self.size, self._all, self.hits, self.misses = size, {}, 0, 0

    def get(self, engine: Engine, sql: str) -> Prepared:
        if sql in self._all:
            self.hits += 1
            self._all[sql][1] += 1
        else:
            self.misses += 1
            if len(self._all) >= self.size:
                del self._all[min(self._all, key=lambda k: self._all[k][1])]
            self._all[sql] = [Prepared(engine, sql), 1]
        return self._all[sql][0]

    def stats(self) -> dict[str, int]:
        return {"entries": len(self._all), "hits": self.hits, "misses": self.misses}
