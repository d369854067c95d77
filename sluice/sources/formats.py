"""Parquet with codecs, Arrow IPC bytes, a disk cache, and Parquet whose values are encrypted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.errors import EngineError

#: Codec names and what Spark writes for them; brotli has no codec here and becomes zstd.
CODECS = {"none": "uncompressed", "uncompressed": "uncompressed", "snappy": "snappy", "lz4": "lz4_raw", "zstd": "zstd", "brotli": "zstd", "gzip": "gzip"}


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def parquet_schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", level: int | None = None, mode: str = "errorifexists", bloom: tuple[str, ...] = ()) -> None:
    """``bloom`` names columns that get a membership filter, which scans with an equality consult."""
    if codec.lower() not in CODECS:
        raise EngineError(f"unknown codec {codec}")
    writer = df.write.mode(mode).option("compression", CODECS[codec.lower()])
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def ipc_bytes(df: DataFrame) -> bytes:
    """A bounded result as an Arrow IPC stream; the whole of it passes through the driver."""
    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def ipc_frame(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def persist_cache(df: DataFrame, path: str) -> DataFrame:
    """Writes a table for ``load_cache`` and reads it back cached."""
    df.write.mode("overwrite").parquet(path)
    return load_cache(df.sparkSession, path)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).cache()


def _key(key: bytes | str):
    key = key.encode() if isinstance(key, str) else key
    if len(key) not in (16, 24, 32):
        raise EngineError("a key has 16, 24 or 32 bytes")
    return F.lit(key)


#: Timestamps keep their microseconds in sealed rows.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_encrypted(df: DataFrame, path: str, key: bytes | str, aad: str = "", mode: str = "errorifexists") -> None:
    """Each row as one AES-GCM sealed value beside the clear schema; executors seal their own rows."""
    sealed = df.select(F.aes_encrypt(F.to_json(F.struct("*"), {"ignoreNullFields": "false"} | _EXACT), _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad)).alias("sealed"))
    sealed.select(F.col("sealed").alias("sealed", metadata={"schema": df.schema.json()})).write.mode(mode).parquet(path)


def read_encrypted(spark: SparkSession, path: str, key: bytes | str, aad: str = "") -> DataFrame:
    """The rows of ``write_encrypted``; a wrong key or context raises when rows are read."""
    import json

    df = spark.read.parquet(path)
    if not is_encrypted(df):
        raise EngineError(f"{path} is not encrypted")
    schema = StructType.fromJson(json.loads(df.schema["sealed"].metadata["schema"]))
    opened = F.aes_decrypt("sealed", _key(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")
    return df.select(F.from_json(opened, schema, _EXACT).alias("r")).select("r.*")


def is_encrypted(df: DataFrame) -> bool:
    return df.columns == ["sealed"] and "schema" in df.schema["sealed"].metadata


def rekey(spark: SparkSession, path: str, target: str, old: bytes | str, new: bytes | str, aad: str = "") -> None:
    """Writes an encrypted table anew under another key."""
    write_encrypted(read_encrypted(spark, path, old, aad), target, new, aad)
