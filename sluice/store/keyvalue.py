"""A keyed table as a log of versions: key, value, commit_ts, seq, deleted.

Each commit appends; nothing is changed in place. A read takes, for each key, the newest version at or before its
timestamp by one aggregate (map-side combined, so a key's history never meets in memory), and drops tombstones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from sluice.store.table import Table

SCHEMA = StructType([
    StructField("key", BinaryType()), StructField("value", BinaryType()), StructField("commit_ts", LongType()),
    StructField("seq", LongType()), StructField("deleted", BooleanType()),
])


def visible(log: DataFrame, read_ts: int | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """key, value, commit_ts of each key's newest version at or before ``read_ts``, without deleted keys."""
    rows = log if read_ts is None else log.where(F.col("commit_ts") <= read_ts)
    last = rows.groupBy(key).agg(F.max_by(F.struct(value, "commit_ts", "deleted"), F.struct("commit_ts", "seq")).alias("v"))
    return last.where(~F.col("v.deleted")).select(key, F.col(f"v.{value}").alias(value), F.col("v.commit_ts").alias("commit_ts"))


def valid_at(batches: DataFrame, ts: int, begin: str = "begin_ts", end: str = "end_ts") -> DataFrame:
    """Versioned batches that are visible at ``ts``: begun by then, and not ended or ended later."""
    return batches.where((F.col(begin) <= ts) & (F.col(end).isNull() | (F.col(end) > ts)))


def survivors(log: DataFrame, watermark: int, keep: int = 1, key: str = "key") -> DataFrame:
    """The versions that garbage collection leaves.

    A version older than the watermark goes once a newer version is visible at the watermark, unless it is among the
    key's ``keep`` newest; a tombstone that is all that is visible at the watermark goes too.
    """
    from pyspark.sql import Window

    newest = Window.partitionBy(key).orderBy(F.desc("commit_ts"), F.desc("seq"))
    old = F.when(F.col("commit_ts") <= watermark, F.struct("commit_ts", "seq"))
    ranked = log.withColumns({"_n": F.row_number().over(newest), "_base": F.max(old).over(Window.partitionBy(key))})
    superseded = (F.col("commit_ts") <= watermark) & (F.struct("commit_ts", "seq") < F.col("_base"))
    dead = (F.col("commit_ts") <= watermark) & (F.struct("commit_ts", "seq") == F.col("_base")) & F.col("deleted") & (F.col("_n") == 1)
    return ranked.where(~((F.coalesce(superseded, F.lit(False)) & (F.col("_n") > keep)) | F.coalesce(dead, F.lit(False)))).drop("_n", "_base")


class KeyValueTable:
    def __init__(self, spark: SparkSession, root: str, name: str, create: bool = True):
        from sluice.errors import TableNotFound

        self.spark = spark
        try:
            self.table = Table(spark, root, name)
        except TableNotFound:
            if not create:
                raise
            self.table = Table.create(spark, root, name, SCHEMA)

    def log(self) -> DataFrame:
        return self.table.df()

    def append(self, rows: list[tuple[bytes, bytes | None, int, int, bool]]) -> int:
        """One commit of versions."""
        return self.table.append(self.spark.createDataFrame([tuple(map(_cell, r)) for r in rows], SCHEMA)) if rows else 0

    def snapshot(self, read_ts: int | None = None) -> DataFrame:
        return visible(self.log(), read_ts)

    def get(self, key: bytes, read_ts: int | None = None) -> bytes | None:
        row = visible(self.log().where(F.col("key") == F.lit(key)), read_ts).first()
        return None if row is None else bytes(row["value"])

    def gc(self, watermark: int, keep: int = 1) -> int:
        before = self.table.count()
        self.table.overwrite(survivors(self.log(), watermark, keep))
        return before - self.table.count()

    def gc_estimate(self, watermark: int, keep: int = 1) -> int:
        return self.table.count() - survivors(self.log(), watermark, keep).count()


def _cell(x):
    return bytearray(x) if isinstance(x, bytes) else x
