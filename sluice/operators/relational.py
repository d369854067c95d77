"""Projection, filter, join, aggregation, sort, limit and the small helpers around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def project(df: DataFrame, items: Sequence[str | Column | tuple[str | Column, str]]) -> DataFrame:
    """Expressions with aliases; an expression without one is named col_i by its place."""
    out = []
    for i, item in enumerate(items):
        if isinstance(item, tuple):
            out.append(_c(item[0]).alias(item[1]))
        elif isinstance(item, str) and item in df.columns:
            out.append(F.col(item))
        else:
            out.append(_c(item).alias(f"col_{i}"))
    return df.select(*out)


def select_where(df: DataFrame, items: Mapping[str, str | Column], predicate: str | Column, keep: Sequence[str] | None = None) -> DataFrame:
    """SELECT with a WHERE that may name the aliases. A column of the input wins over an alias of the same name."""
    fresh = {a: _c(e) for a, e in items.items() if a.lower() not in {c.lower() for c in df.columns}}
    shadowed = {a: _c(e).alias(a) for a, e in items.items() if a not in fresh}
    rows = df.withColumns(fresh).where(_c(predicate))
    return rows.select(*[shadowed.get(a, F.col(a)) for a in items], *(keep or ()))


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join over pairs of columns; null keys match nothing. ``how`` is inner, left, right, full, cross, semi or anti."""
    if how == "cross":
        return left.crossJoin(right)
    condition = None
    for a, b in on:
        part = left[a] == right[b]
        condition = part if condition is None else condition & part
    return left.join(right, condition, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def adaptive_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", limit_bytes: int = 64 << 20) -> DataFrame:
    """Equi-join that broadcasts the right side only if the optimizer's size estimate is within ``limit_bytes``.

    Beyond it the join shuffles, and adaptive execution splits skewed keys.
    """
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= limit_bytes else right, list(on), how)


def hash_aggregate(df: DataFrame, by: Sequence[str | Column], aggregates: Mapping[str, str | Column], having: str | Column | None = None) -> DataFrame:
    """GROUP BY with named aggregates and an optional HAVING over their names."""
    out = df.groupBy(*[_c(b) for b in by]).agg(*[_c(e).alias(a) for a, e in aggregates.items()])
    return out if having is None else out.where(_c(having))


def global_aggregate(df: DataFrame, aggregates: Mapping[str, str | Column]) -> DataFrame:
    """Aggregates over all rows: one row, also for no rows."""
    return df.agg(*[_c(e).alias(a) for a, e in aggregates.items()])


def distinct_estimate(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """Estimated number of distinct values, in constant memory."""
    return df.agg(F.approx_count_distinct(column, error).alias("estimate"))


def sort(df: DataFrame, keys: Sequence[tuple[str | Column, bool] | tuple[str | Column, bool, bool]]) -> DataFrame:
    """Sorts by (expression, ascending[, nulls first]); nulls come first in both directions unless told otherwise."""
    out = []
    for key in keys:
        c, up, first = _c(key[0]), key[1], key[2] if len(key) > 2 else True
        out.append({(True, True): c.asc_nulls_first, (True, False): c.asc_nulls_last, (False, True): c.desc_nulls_first, (False, False): c.desc_nulls_last}[up, first]())
    return df.orderBy(*out)


def sort_key_value(df: DataFrame, key: str = "key") -> DataFrame:
    return df.orderBy(F.col(key).asc())


def limit_offset(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; either may be missing."""
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def top_n_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group; the plan limits groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def filter_mask(df: DataFrame, column: str, threshold, mask: str = "mask") -> DataFrame:
    """Each row with whether its value is above the threshold; null is not."""
    return df.withColumn(mask, F.coalesce(F.col(column) > threshold, F.lit(False)))


def filter_greater(df: DataFrame, column: str, threshold) -> DataFrame:
    return df.where(F.col(column) > threshold)


def tier_merge(delta: DataFrame, base: DataFrame, aggregates: Mapping[str, str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates over two tiers of one table: each is aggregated partially where it lies, and the parts are merged."""
    both = delta.unionByName(base, allowMissingColumns=True)
    return hash_aggregate(both, list(by), aggregates) if by else global_aggregate(both, aggregates)


def shard(df: DataFrame, n: int, by: Sequence[str] = (), kind: str = "round_robin") -> DataFrame:
    """Deals rows to ``n`` partitions: round robin, by hash of the columns, or by their ranges."""
    if kind == "round_robin":
        return df.repartition(n)
    if not by:
        raise ValueError(f"{kind} needs columns")
    return df.repartition(n, *by) if kind == "hash" else df.repartitionByRange(n, *by)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join for keys of which one holds much of the left side: its rows are dealt over ``salts`` partitions.

    The right side is repeated ``salts`` times, so it should be the smaller one. Joins that keep unmatched rows of the
    right side would repeat them and are refused.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} joins cannot be salted")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
