"""Type names of CREATE TABLE, and schemas as JSON."""

from __future__ import annotations

import re

from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

#: Spellings whose meaning differs from Spark's: INT has 64 bits, REAL is a double, all text is STRING.
ALIASES = {
    "int": "bigint", "integer": "bigint", "real": "double", "float": "double", "text": "string", "bool": "boolean",
}
_SIZED_TEXT = re.compile(r"(var)?char(acter)?( varying)?\s*(\(\s*\d+\s*\))?", re.IGNORECASE)
_CONSTRAINT = re.compile(r"\s+(primary\s+key|not\s+null|null|unique|default\s+.+|references\s+.+|check\s*\(.+\))\s*", re.IGNORECASE | re.DOTALL)


def data_type(spelling: str) -> DataType:
    """The Spark type of a column definition's type, without its constraints."""
    name = _CONSTRAINT.sub(" ", f" {spelling.strip()} ").strip().lower()
    if _SIZED_TEXT.fullmatch(name):
        name = "string"
    name = re.sub(r"^(int|integer)\s*\(\s*\d+\s*\)$", "bigint", name)
    return _parse_datatype_string(ALIASES.get(name, name))


def to_json(schema: StructType) -> str:
    return schema.json()


def from_json(text: str) -> StructType:
    import json

    return StructType.fromJson(json.loads(text))


def nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
