"""Helpers that the corpus operators share: table access, shared scratch space, word arrays."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a worker turns into arrays at a time; bounds its memory whatever the batch holds.
SLICE_BYTES = 4 << 20

UINT = np.uint64
_LIBC = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or an own one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluice-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # nothing reads this step's shuffles again, but Spark deletes them only after the driver has collected their plan
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` has made, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def by_content(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what finds a row again in any later scan: h1 and h2 (128 bits of the text's hash), d (its id).

    Positions would not do: how files are split into partitions depends on the executors that are there.
    """
    one = F.col("doc_id").cast("long")
    return docs.select(one.alias("doc_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.coalesce(one, F.lit(-1)).alias("d"))


def texts_of(docs: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``name``, text: the texts of ``wanted``, distinct texts given as name, h1, h2 and d of one row that has it."""
    found = pruned(docs.select("h1", "h2", "d", "text"), "h1", wanted.select("h1")).join(wanted, ["h1", "h2", "d"])
    return found.groupBy("h1", "h2", "d", name).agg(F.first("text").alias("text")).select(name, "text")  # repeated rows are one


def pruned(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``wanted`` (a column of that name), and a few others, without a shuffle.

    A Bloom filter with one hash: ``bits`` is its size whatever the input's, so at most bits / 64 numbers are broadcast.
    When it fills up more rows pass; the join that follows sees to the rest.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at, slot, filled = (free_name(df, n) for n in ("_at", "_slot", "_filled"))
    one = F.lit(1).cast("long")
    filter_ = wanted.select(place(F.col(key)).alias(at)).groupBy(F.floor(F.col(at) / 64).cast("long").alias(slot)).agg(
        F.bit_or(F.call_function("shiftleft", one, (F.col(at) % 64).cast("int"))).alias(filled)
    )
    probed = df.withColumn(at, place(F.col(key))).withColumn(slot, F.floor(F.col(at) / 64).cast("long")).join(F.broadcast(filter_), slot)
    hit = F.call_function("shiftrightunsigned", F.col(filled), (F.col(at) % 64).cast("int")).bitwiseAND(one) == 1
    return probed.where(hit).drop(at, slot, filled)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first variant of it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[int, str, int]]:
    """Up to ``per_class`` labelled texts of each class, never held-out ones, picked by a hash of the id.

    The bound is the documented parameter of both classifiers; the sample is the same on each run.
    """
    marks = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    ranked = []
    for y in (0, 1):
        ranked.append(marks.where(F.col("_y") == y).orderBy(F.xxhash64(F.col("_id")), "_id").limit(per_class))
    picked = F.broadcast(ranked[0].unionAll(ranked[1]))
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t"))
        .where(F.col("_t").isNotNull())
        .join(picked, "_id")
        .groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
        .collect()
    )
    return sorted((r["_id"], r["_t"], r["_y"]) for r in rows)


def binaries(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a worker for later stages, and with it what its allocators hold."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(texts: Sequence[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; a longer text has a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def text_ranges(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text, without making objects of them."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def split_words(texts: Sequence[bytes | None]) -> tuple[list[bytes], np.ndarray]:
    """All words (runs without ASCII white space) of some texts, and each text's number of words."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            ws = t.split()
            counts[i] = len(ws)
            flat += ws
    return flat, counts


def encode_words(flat: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word as the index of its spelling, and the spellings."""
    if not flat:
        return np.zeros(0, np.int64), []
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def hash_words(flat: list[bytes], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    codes, spellings = encode_words(flat)
    table_ = np.fromiter((xxhash.xxh3_64_intdigest(s, seed) for s in spellings), UINT, len(spellings))
    return table_[codes] if len(spellings) else np.zeros(0, UINT)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the SplitMix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + UINT(0x9E3779B97F4A7C15)
        x = (x ^ (x >> UINT(30))) * UINT(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> UINT(27))) * UINT(0x94D049BB133111EB)
        return x ^ (x >> UINT(31))


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within a text: hash, text's index, position of the first word."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    if len(words) < width:
        return np.zeros(0, UINT), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(words) - width + 1, UINT)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ words[k : k + len(h)]) * UINT(0x9FB21C651E98DF25)
            h ^= h >> UINT(29)
    owner = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(len(words)) - starts[owner]
    ok = pos[: len(h)] + width <= counts[owner[: len(h)]]
    return mix(h[ok]), owner[: len(h)][ok], pos[: len(h)][ok]


def complete_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of a partition that is sorted by integer ``keys``, cut so that no group is split: rows, groups' starts.

    Holds one batch and the group that it ends in; callers bound the size of a group.
    """
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [rb.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != rb.column(k)[0].as_py() for k in keys):
            yield _with_starts(held, keys)
            held = []
        if len(changes):
            last = int(changes[-1])
            yield _with_starts([*held, rb.slice(0, last)], keys)
            held = [rb.slice(last)]
        else:
            held.append(rb)
    if held:
        yield _with_starts(held, keys)


def _with_starts(parts: list[pa.RecordBatch], keys: Sequence[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(parts).combine_chunks()
    cols = [t.column(k).to_numpy() for k in keys]
    changed = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return t, np.concatenate([[0], np.flatnonzero(changed) + 1])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the component's smallest node), for all nodes but the roots.

    Large star and small star in turn: each step is one aggregate and one join, so no node's neighbours meet in one
    task, and the number of steps is logarithmic in the components' size.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("s"), F.col("u").alias("t")).unionAll(edges.select(F.col("u").alias("s"), F.col("v").alias("t")))
        large = large.where("t > s").join(low.withColumnRenamed("u", "s"), "s").select(F.col("t").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
