"""Mutable tables kept as immutable Parquet commits under a manifest."""

from sluice.store.keyvalue import KeyValueTable
from sluice.store.table import Table

__all__ = ["KeyValueTable", "Table"]
