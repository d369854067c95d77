"""Scalar functions whose meaning differs from Spark's function of the same name. All are Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that Unicode knows, for ``trim_space``.
_UNICODE_SPACE = r"[\s\u0085   -     　]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def byte_length(s) -> Column:
    """LENGTH in bytes of UTF-8."""
    return F.octet_length(_c(s))


def concat_skip_null(*parts) -> Column:
    """CONCAT that leaves nulls out and is never null."""
    return F.concat_ws("", *[_c(p).cast("string") for p in parts])


def trim_space(s) -> Column:
    """TRIM of any white space, not only spaces."""
    return F.regexp_replace(F.regexp_replace(_c(s), f"^{_UNICODE_SPACE}", ""), f"{_UNICODE_SPACE}$", "")


def int_div(a, b) -> Column:
    """Division of integers, towards zero; division by zero raises."""
    return ((_c(a) - _c(a) % _c(b)) / _c(b)).cast("bigint")


def epoch_now() -> Column:
    """NOW() as seconds since the epoch."""
    return F.unix_timestamp()


def round_half_away(x, digits: int = 0) -> Column:
    return F.round(_c(x), digits)


def ceil_double(x) -> Column:
    return F.ceil(_c(x)).cast("double")


def floor_double(x) -> Column:
    return F.floor(_c(x)).cast("double")


#: name in SQL -> the expression's text, for ``register``
SQL_BODIES = {
    "byte_length": ("s STRING", "INT", "octet_length(s)"),
    "concat_skip_null": ("a STRING, b STRING", "STRING", "concat_ws('', a, b)"),
    "trim_space": ("s STRING", "STRING", rf"regexp_replace(regexp_replace(s, r'^{_UNICODE_SPACE}', ''), r'{_UNICODE_SPACE}$', '')"),
    "int_div": ("a BIGINT, b BIGINT", "BIGINT", "a div b"),
    "epoch_now": ("", "BIGINT", "unix_timestamp()"),
}


def register(spark) -> None:
    """Makes the functions callable from SQL text."""
    for name, (params, kind, body) in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
