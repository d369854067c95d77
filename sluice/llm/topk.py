"""Exact top-k by inner product: a three-phase uniform threshold.

A score is a sum over slices of the vectors. Each slice of a vector is a row of its own, and a task sees one slice only:
it knows a candidate's partial score there, never its score.

1. For each query and slice the ``k`` best partial scores are gathered: the local lists. The exact scores of the
   candidates on them are looked up; the k-th best is a safe cutoff, as k candidates reach it.
2. The cutoff, one number a query, goes to the slices' tasks. A candidate that reaches it has a partial score of at
   least cutoff / slices in some slice, so each list gives only its entries from there on. What is known of a
   candidate, with just less than that share for each slice in which it was not seen, bounds its score.
3. Of the candidates whose bound reaches the cutoff, those that were not seen in all slices have their scores looked
   up; the best k a query are ranked.

A query with fewer candidates than k has no cutoff, and needs none: its lists hold all of them.

Queries and candidates are dealt to blocks, and each pair of blocks of one slice (a cell) is one group, so no group grows
with the input. Candidates are sent once to each of the queries' blocks, twice in all: every query meets every row.

Defined results: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
repeated rows are candidates, and queries, each by itself, and only a query's own row is not its candidate; vectors of
another length than the query's are not its candidates; a query with fewer candidates than k returns them all; ties go
to the smaller vec_id; components beyond what keeps scores within 38 digits (about 10**18) count as that bound, and a
score beyond 64 bits is ranked by its value and given as the nearest 64-bit number; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import written

K, SLICES = 10, 2
QUERY_BLOCK, BLOCK = 2048, 4096
#: Queries of a block that are multiplied at a time.
_AT_ONCE = 256
_LONGS = (1 << 63) - 1


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, _v (each component x as floor(1024 * x)) of each usable row."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(finite)
    scaled = lambda x: F.greatest(F.least(F.lit(1024.0) * x.cast("double"), F.lit(9e18)), F.lit(-9e18))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(scaled(x)).cast("long")).alias("_v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: 64-bit numbers, or Python's if those are too small."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _numbers(x: np.ndarray, wide: bool) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in x], pa.decimal128(38)) if wide else pa.array(x.astype(np.int64))


def _matrix(t: pa.Table) -> np.ndarray:
    column = t.column("_p").combine_chunks()
    return column.flatten().to_numpy().reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0), np.int64)


def sliced(vectors: DataFrame) -> DataFrame:
    """_id, vec_id, _d (the vector's length), _s (the slice), _p (its components): one row for each slice."""
    d = F.size("_v")
    at = lambda s: F.floor(d * s / SLICES).cast("int")
    parts = F.array(*[F.struct(F.lit(s).alias("_s"), F.slice("_v", at(s) + 1, at(s + 1) - at(s)).alias("_p")) for s in range(SLICES)])
    return vectors.select("_id", "vec_id", d.alias("_d"), F.explode(parts).alias("_x")).select("_id", "vec_id", "_d", "_x._s", "_x._p")


def _cells(queries: DataFrame, parts: DataFrame, n_query_blocks: int, n_blocks: int, pick: Callable, wide: bool) -> DataFrame:
    """_q, _s, _c, vec_id, part: the entries that ``pick`` takes of each query's partial scores in a cell."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        a, b, own, ids = _matrix(q), _matrix(c), q.column("_id").to_numpy(), c.column("_id").to_numpy()
        limits = q.column("_least").to_pylist()
        rows, cols, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, object if wide else np.int64)]
        for x in range(0, len(own) if len(ids) else 0, _AT_ONCE):
            block = products(a[x : x + _AT_ONCE], b)
            for i, part in enumerate(block, x):
                at = pick(part, np.flatnonzero(ids != own[i]), limits[i])
                rows.append(np.full(len(at), i))
                cols.append(at)
                found.append(part[at])
        i, j = np.concatenate(rows), np.concatenate(cols)
        s = np.full(len(i), q.column("_s")[0].as_py() if len(own) else 0, np.int32)
        return pa.table({"_q": own[i], "_s": s, "_c": ids[j], "vec_id": c.column("vec_id").to_numpy()[j], "part": _numbers(np.concatenate(found), wide)})

    block = lambda n, name: F.pmod(F.xxhash64("_id"), F.lit(n)).alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    q = queries.select("*", block(n_query_blocks, "_qb")).select("*", every(n_blocks, "_cb"))
    c = parts.select(*[F.col(x).alias(x) for x in parts.columns], block(n_blocks, "_cb")).select("*", every(n_query_blocks, "_qb"))
    key = ("_d", "_s", "_qb", "_cb")
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(run, f"_q long, _s int, _c long, vec_id long, part {_kind(wide)}")


def _kind(wide: bool) -> str:
    return "decimal(38,0)" if wide else "long"


def _best(k: int) -> Callable:
    def pick(part: np.ndarray, free: np.ndarray, _) -> np.ndarray:
        n = min(k, len(free))
        return free[np.argsort(-part[free], kind="stable")[:n]] if part.dtype == object else free[np.argpartition(-part[free], n - 1)[:n]] if n else free

    return pick


def _from(part: np.ndarray, free: np.ndarray, least) -> np.ndarray:
    return free[part[free] >= int(least)]


def _resolved(pairs: DataFrame, vectors: DataFrame, wide: bool) -> DataFrame:
    """_q, _c, vec_id, score: exact scores of pairs, looked up."""
    one = F.lit(0).cast(_kind(wide))
    c = vectors.select(F.col("_id").alias("_c"), "vec_id", F.col("_v").alias("_cv"))
    q = vectors.select(F.col("_id").alias("_q"), F.col("_v").alias("_qv"))
    product = lambda x, y: x.cast(_kind(wide)) * y
    score = F.aggregate(F.zip_with("_qv", "_cv", product), one, lambda s, x: (s + x).cast(_kind(wide)))
    return pairs.select("_q", "_c").join(c, "_c").join(q, "_q").select("_q", "_c", "vec_id", score.alias("score"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_q").orderBy(F.desc("score"), "vec_id", "_c")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Phases:
    """The phases' results as tables: ``lists``, ``first`` (their exact scores), ``cutoffs``, ``entries``, ``open``, ``found``."""

    def __init__(self, rows: DataFrame, every: int, k: int, query_block: int, block: int):
        vectors = integer_vectors(rows)
        most = vectors.agg(F.max(F.size("_v")), F.max(F.array_max(F.transform("_v", lambda x: F.abs(x))))).first()
        length, largest = int(most[0] or 0), int(most[1] or 0)
        wide = length * largest**2 >= _LONGS
        bound = math.isqrt((10**38 - 1) // max(1, length))
        if wide:
            vectors = vectors.withColumn("_v", F.transform("_v", lambda x: F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))))
        self.vectors = vectors = written(vectors.withColumn("_id", F.monotonically_increasing_id()), "topk-vectors")
        parts = written(sliced(vectors), "topk-slices")
        queries = parts.where(F.col("vec_id") % every == 0)
        self.n_queries, self.n_vectors = queries.where("_s = 0").count(), vectors.count()
        sizes = max(1, -(-self.n_queries // query_block)), max(1, -(-self.n_vectors // block))
        # phase one: local lists, and a cutoff from what is on them
        found = _cells(queries.withColumn("_least", F.lit(None).cast(_kind(wide))), parts, *sizes, _best(k), wide)
        best = Window.partitionBy("_q", "_s").orderBy(F.desc("part"), "_c")
        self.lists = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n"), "topk-lists")
        self.first = written(_ranked(_resolved(self.lists.select("_q", "_c").distinct(), vectors, wide), k), "topk-first")
        self.cutoffs = self.first.where(F.col("rank") == k).select("_q", F.col("score").alias("cutoff"))
        # phase two: entries from the cutoff's share on
        share = F.ceil(F.col("cutoff") / SLICES) if wide else F.expr(f"cutoff div {SLICES} + int(cutoff > 0 AND cutoff % {SLICES} != 0)")
        limits = self.cutoffs.select("_q", "cutoff", share.cast(_kind(wide)).alias("_least"))
        asking = queries.join(limits.select(F.col("_q").alias("_id"), "_least"), "_id")
        self.entries = written(_cells(asking, parts, *sizes, _from, wide), "topk-entries")
        known = self.entries.groupBy("_q", "_c").agg(F.sum("part").cast(_kind(wide)).alias("known"), F.count("*").alias("seen"), F.first("vec_id").alias("vec_id"))
        reach = F.col("known") + (SLICES - F.col("seen")) * (F.col("_least") - 1)
        held = written(known.join(limits, "_q").where(reach >= F.col("cutoff")).select("_q", "_c", "vec_id", "known", "seen", "cutoff"), "topk-held")
        # phase three: what is left open
        self.open = held.where(F.col("seen") < SLICES).select("_q", "_c")
        whole = held.where(F.col("seen") == SLICES).select("_q", "_c", "vec_id", F.col("known").alias("score"))
        few = self.first.drop("rank").join(self.cutoffs, "_q", "left_anti")
        self.found = _ranked(few.unionByName(whole).unionByName(_resolved(self.open, vectors, wide)), k)


def _as_long(score: Column) -> Column:
    return F.greatest(F.least(score, F.lit(_LONGS)), F.lit(-_LONGS - 1)).cast("long")


def top_k(rows: DataFrame, every: int = 100, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose id ``every`` divides."""
    phases = Phases(rows, every, k, query_block, block)
    ids = phases.vectors.select(F.col("_id").alias("_q"), F.col("vec_id").alias("query_id"))
    return phases.found.join(ids, "_q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", _as_long(F.col("score")).alias("score"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.r AS q, c.r AS c, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.r <> c.r
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""
