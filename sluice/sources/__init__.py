"""Readers and writers: Parquet, Arrow IPC, encrypted columns, and small files through Hadoop's file systems."""

from sluice.sources.files import Files
from sluice.sources.formats import (
    ipc_bytes,
    ipc_frame,
    load_cache,
    parquet_schema,
    persist_cache,
    read_encrypted,
    read_parquet,
    rekey,
    write_encrypted,
    write_parquet,
)

__all__ = [
    "Files", "ipc_bytes", "ipc_frame", "load_cache", "parquet_schema", "persist_cache", "read_encrypted", "read_parquet",
    "rekey", "write_encrypted", "write_parquet",
]
