"""Mixing sources to target weights by pivotal dependent rounding.

A source's rows share one expected number of copies, target / source size. Its whole part is taken outright; the
fractions are rounded by the pivotal method: two rows meet, and mass moves between them, up or down at random, so
that fraction times size keeps its sum and its expectation, until one fraction is 0 or 1. The row that stays
fractional meets the next. Rows are dealt to chunks of bounded size; each chunk leaves at most one fractional row,
and these residuals meet in a reduction tree with a bounded fan-in until one is left a source, which is rounded at
random like the others. Large rows meet first, so that the last one tends to be small; a source's taken words differ
from its target by less than that row's size.

Every random number is a hash of the row's id, text and source, so reruns agree, and so do copies of a row in a
different order. Rows that agree in these three are copies.

Defined results: null and empty texts have size 0 and take 0 words (their copies are rounded like the others'); a
null source is a source of its own, last in order; sources without words have target 0; repeated rows are rows of
their own; an empty table gives an empty result; other columns are ignored by ``mixing_plan`` and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import binaries, free_name, written
from sluice.llm.common import mix as scramble

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
CHUNK_ROWS = 1024
FAN_IN = 256
#: Copies of one row that a task makes.
COPIES = 1 << 16


def count_words(docs: DataFrame, keep: list[str], size: str = "size") -> DataFrame:
    """``keep`` columns, the text's number of words, and a hash of the row for random draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n = pa.array([len(t.split()) if t else 0 for t in binaries(rb.column("_text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in keep), n], names=[*keep, size])

    schema = docs.select(*keep).schema.add(size, "long")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Each source's target words: all words shared by weight, no source above ``cap`` times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, mass = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / mass for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def _unit(x: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers of [0, 1) from hashes."""
    with np.errstate(over="ignore"):
        return (scramble(x.astype(np.uint64) ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions in the given order. Returns them, all 0 or 1 but one, and that one's index (-1: none).

    ``size`` weighs the mass: what one row gains in fraction times size, the other loses. Rows of size 0 carry no
    mass and are rounded by themselves.
    """
    out, held = part.astype(float).copy(), -1
    for i in range(len(out)):
        p = out[i]
        if size[i] <= 0:
            out[i] = float(draw[i] < p)
            continue
        if p <= 1e-12 or p >= 1 - 1e-12:
            out[i] = round(p)
            continue
        if held < 0:
            held = i
            continue
        q, a, b = out[held], float(size[held]), float(size[i])
        up = min((1 - q) * a, p * b)  # mass that can move from i to held
        down = min(q * a, (1 - p) * b)  # and back
        to_held = draw[i] * (up + down) < down
        move = up if to_held else -down
        q, p = q + move / a, p - move / b
        q = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
        p = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
        out[held], out[i] = q, p
        if q in (0.0, 1.0):
            held = i if p not in (0.0, 1.0) else -1
    return out, held


_ROUNDED = "doc_id long, _a long, _b long, _src string, size long, _part double, _chunk long"


def _rounding(level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_a", "_b"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        draw = _unit(pdf["_a"].to_numpy().view(np.uint64) + np.arange(len(pdf), dtype=np.uint64), 7 + level)
        pdf["_part"], _ = pivot(pdf["size"].to_numpy(), pdf["_part"].to_numpy(), draw)
        return pdf

    return run


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes of id, text and source: rows that share both are copies of each other."""
    cols = [F.col(c) for c in ("doc_id", "text", "source")]
    return [F.xxhash64(F.lit(seed), *cols, *[c.isNull() for c in cols]) for seed in (1, 2)]


def _each(counted: DataFrame) -> DataFrame:
    """A row for each of ``_n`` copies, told apart by ``_i``. Many copies of one row are dealt to several tasks."""
    blocks = counted.where(F.col("_n") > COPIES).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(COPIES).cast("long"))))
    hot = blocks.repartition("_a", "_from").withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + (COPIES - 1))))).drop("_from")
    return counted.where(F.col("_n") <= COPIES).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).unionByName(hot)


def _rounded(docs: DataFrame, weights: tuple[float, ...], cap: float, chunk_rows: int, fan_in: int) -> DataFrame:
    """doc_id, row hashes, size, source_size, target, copies of each row.

    Collects one row a source: their number is the length of the mix's own recipe. The recipe is joined without a hint,
    so that it is broadcast only if Spark finds it small enough.
    """
    spark = docs.sparkSession
    a, b = _row_hashes(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("_a"), b.alias("_b"), F.col("source").cast("string").alias("_src"), "text")
    sized = written(count_words(base, ["doc_id", "_a", "_b", "_src"]), "mixing-sizes")
    totals = {r["_src"]: (int(r["s"] or 0), int(r["n"])) for r in sized.groupBy("_src").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    goal = targets({s: v[0] for s, v in totals.items()}, weights, cap) if totals else {}
    chunks = {s: max(1, -(-v[1] // chunk_rows)) for s, v in totals.items()}
    recipe = spark.createDataFrame(
        [(s, v[0], float(goal[s]), float(goal[s] / v[0]) if v[0] else 0.0, chunks[s]) for s, v in totals.items()],
        "_s string, source_size long, target double, _p double, _chunks long",
    )
    on = F.col("_src").eqNullSafe(F.col("_s"))
    counted = sized.groupBy("doc_id", "_a", "_b", "_src", "size").agg(F.count("*").alias("_n"))
    live = _each(counted).join(recipe, on).select(
        "doc_id", "_a", "_b", "_src", "size",
        (F.col("_p") - F.floor("_p")).alias("_part"),
        F.pmod(F.xxhash64("_a", "_b", "_i"), F.col("_chunks")).alias("_chunk"),
    )
    most, level, done = max(chunks.values(), default=1), 0, []
    while True:
        step = live.groupBy("_src", "_chunk").applyInPandas(_rounding(level), _ROUNDED)
        step = written(step, "mixing-level")
        fractional = (F.col("_part") > 0) & (F.col("_part") < 1)
        done.append(step.where(~fractional).withColumn("_extra", F.col("_part").cast("long")))
        live = step.where(fractional)
        if most <= 1:
            break
        most, level = -(-most // fan_in), level + 1
        live = live.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("long"))
    drawn = F.pmod(F.xxhash64(F.lit(3), "_a", "_b"), F.lit(1 << 30)) / float(1 << 30)
    done.append(live.withColumn("_extra", (drawn < F.col("_part")).cast("long")))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionAll(more)
    copies = (F.floor("_p") + F.col("_extra")).cast("long")
    return rows.join(recipe, on).select("doc_id", "_a", "_b", "size", "source_size", "target", copies.alias("copies"))


def mixing_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: one row for each row of ``docs``."""
    rows = _rounded(docs, weights, cap, chunk_rows, fan_in)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, all columns kept.

    Rows that agree in id, text and source are one another's copies: one of them stands for all and is repeated as often
    as they are together.
    """
    plan = _rounded(docs, weights, cap, chunk_rows, fan_in)
    counts = written(plan.groupBy("_a", "_b").agg(F.sum("copies").alias("_n"), F.count("*").alias("_rows")).where("_n > 0"), "mixing-copies")
    ka, kb, n, rows, one = (free_name(docs, c) for c in ("_mix_a", "_mix_b", "_mix_n", "_mix_rows", "_mix_one"))
    counts = counts.select(F.col("_a").alias(ka), F.col("_b").alias(kb), F.col("_n").alias(n), F.col("_rows").alias(rows))
    a, b = _row_hashes(docs)
    keyed = docs.withColumns({ka: a, kb: b}).join(counts, [ka, kb])
    parts = [keyed.where(F.col(rows) == 1)]
    if not counts.where(F.col(rows) > 1).isEmpty():
        repeated = keyed.where(F.col(rows) > 1)
        firsts = repeated.groupBy(ka, kb).agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in repeated.columns if c not in (ka, kb)])
        parts.append(firsts.select(*[F.col(f"`{c}`") for c in repeated.columns]))
    out = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return out.withColumn(one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
