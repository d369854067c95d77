"""Quality rules as a short-circuit cascade.

Each rule rejects texts. On a bounded sample the operator measures, for every rule, its cost (seconds a text,
without what earlier rules have computed) and its selectivity (share of texts that it rejects), and orders the
rules by rejection per cost. A text that one rule rejects is not shown to the later ones. The order changes the
work, never the verdict.

Defined results: a null text counts as empty; an empty text has zero counts, fails the word-count rule and is not
kept; repeated rows each get a row; an empty table gives an empty result; other columns are ignored, so their
names may clash with the output's.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import binaries, encode_words, slices, split_words, window_hashes

SYMBOLS = b"#*$%&|<>"
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_NOT_IN_WORDS = _SPACES + bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
WINDOW = 5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def repeat_words(codes: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a run of ``width`` words found at least twice in it."""
    spelled = (codes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h, owner, pos = window_hashes(spelled, counts, width)
    covered = np.zeros(len(codes) + 1, np.int64)
    if len(h):
        starts = np.concatenate([[0], np.cumsum(counts)])
        at = starts[owner] + pos
        order = np.lexsort((h, owner))
        same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        a, b = at[order][:-1][same], at[order][1:][same]
        if any((codes[a + k] != codes[b + k]).any() for k in range(width)):  # two runs with one hash: compare the runs
            runs = np.stack([owner, *(codes[at + k] for k in range(width))], axis=1)
            _, inverse, found = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
            hit = at[found[inverse.reshape(-1)] > 1]
        else:
            hit = np.unique(np.concatenate([a, b]))
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
    ends = np.cumsum(counts)
    return inside[ends] - inside[ends - counts]


class Batch:
    """Some texts and the statistics that rules have asked for so far."""

    def __init__(self, texts: Sequence[bytes], known: dict[str, np.ndarray] | None = None, words=None):
        self.texts, self._known, self._words = list(texts), known or {}, words

    def narrow(self, keep: np.ndarray) -> Batch:
        words = self._words
        if words is not None:
            words = (words[0][np.repeat(keep, words[1])], words[1][keep])
        return Batch([t for t, k in zip(self.texts, keep) if k], {n: v[keep] for n, v in self._known.items()}, words)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        if self._words is None:
            flat, counts = split_words(self.texts)
            self._words = encode_words(flat)[0], counts
        return self._words

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = np.asarray(getattr(self, f"_{name}")(), np.int64)
        return self._known[name]

    def _n_words(self):
        return self.words()[1]

    def _word_chars(self):
        return [len(t.translate(None, _NOT_IN_WORDS)) for t in self.texts]

    def _n_symbols(self):
        return [len(t) - len(t.translate(None, SYMBOLS)) for t in self.texts]

    def _lines(self):
        return [[x for x in t.split(b"\n") if x.strip(_SPACES)] for t in self.texts]

    def _n_lines(self):
        return [len(x) for x in self._lines()]

    def _n_dup_lines(self):
        return [len(x) - len(set(x)) for x in self._lines()]

    def _n_repeat_words(self):
        return repeat_words(*self.words())

    def _n_capitals(self):
        return [len(t) - len(t.translate(None, _CAPITALS)) for t in self.texts]

    def _n_digits(self):
        return [len(t) - len(t.translate(None, _DIGITS)) for t in self.texts]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Batch], np.ndarray]


#: The contract's own two rules.
BASE_RULES = (
    Rule("too_few_words", lambda b: b["n_words"] < 10),
    Rule("repeated_runs", lambda b: 100 * b["n_repeat_words"] > 20 * b["n_words"]),
)
#: The rules that the method adds. All compare whole numbers, so SQL gives the same verdicts.
METHOD_RULES = (
    Rule("symbols", lambda b: 10 * b["n_symbols"] > b["n_words"]),
    Rule("short_words", lambda b: b["word_chars"] < 2 * b["n_words"]),
    Rule("long_words", lambda b: b["word_chars"] > 15 * b["n_words"]),
    Rule("repeated_lines", lambda b: 100 * b["n_dup_lines"] > 30 * b["n_lines"]),
    Rule("capitals", lambda b: 2 * b["n_capitals"] > b["word_chars"]),
    Rule("digits", lambda b: 2 * b["n_digits"] > b["word_chars"]),
)


@dataclass(frozen=True)
class Estimate:
    rule: str
    cost: float
    selectivity: float

    @property
    def worth(self) -> float:
        return self.selectivity / max(self.cost, 1e-9)


def estimate(texts: Sequence[bytes], rules: Sequence[Rule], known: Sequence[str] = ()) -> list[Estimate]:
    """Cost and selectivity of each rule, each on a fresh batch in which only ``known`` statistics exist."""
    out = []
    for rule in rules:
        batch = Batch(texts)
        for name in known:
            batch[name]
        began = time.perf_counter()
        rejected = rule.rejects(batch)
        out.append(Estimate(rule.name, (time.perf_counter() - began) / max(1, len(texts)), float(np.mean(rejected)) if len(texts) else 0.0))
    return out


def ordered(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> tuple[Rule, ...]:
    worth = {e.rule: e.worth for e in estimates}
    return tuple(sorted(rules, key=lambda r: (-worth[r.name], r.name)))


def cascade(batch: Batch, rules: Sequence[Rule]) -> np.ndarray:
    """True for each text that no rule rejects; a rejected text is not evaluated again."""
    alive = np.arange(len(batch.texts))
    for rule in rules:
        if not len(alive):
            break
        keep = ~rule.rejects(batch)
        if not keep.all():
            alive, batch = alive[keep], batch.narrow(keep)
    kept = np.zeros(max(len(alive) and alive.max() + 1, 0), bool)
    kept[alive] = True
    return kept


def _kept(batch: Batch, rules: Sequence[Rule]) -> np.ndarray:
    out = np.zeros(len(batch.texts), bool)
    found = cascade(batch, rules)
    out[: len(found)] = found
    return out


def sample_texts(docs: DataFrame, n: int) -> list[bytes]:
    """At most ``n`` texts by a hash of the id: the sample on which costs are measured.

    The ids are picked first, so that only the picked texts travel.
    """
    ids = docs.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(n)
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(ids), "_id", "left_semi").limit(n).collect()
    return [(r["text"] or "").encode() for r in rows]


def plan(docs: DataFrame, rules: Sequence[Rule], known: Sequence[str] = (), sample_rows: int = 256) -> tuple[Rule, ...]:
    return ordered(rules, estimate(sample_texts(docs, sample_rows), rules, known))


def quality_statistics(docs: DataFrame, rules: Sequence[Rule] = METHOD_RULES, sample_rows: int = 256) -> DataFrame:
    """Statistics and verdict of each row; the base rules come first, the method's in the measured order."""
    names = [r.name for r in plan(docs, rules, BASE, sample_rows)]
    by_name = {r.name: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = [by_name[n] for n in names]
        for rb in batches:
            texts = binaries(rb.column("text"))
            for a, b in slices(texts):
                batch = Batch([t or b"" for t in texts[a:b]])
                base = [batch[n] for n in BASE]
                failed = np.logical_or.reduce([r.rejects(batch) for r in BASE_RULES])
                kept = ~failed
                kept[kept] = _kept(batch.narrow(~failed), order)
                columns = [rb.column("doc_id")[a:b], *(pa.array(x) for x in base), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def quality_filter(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + METHOD_RULES, sample_rows: int = 256) -> DataFrame:
    """The rows that no rule rejects, with all their columns; every statistic is computed only when a rule needs it."""
    order = plan(docs, rules, (), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = binaries(rb.column("text"))
            for a, b in slices(texts):
                yield rb.slice(a, b - a).filter(pa.array(_kept(Batch([t or b"" for t in texts[a:b]]), order)))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, ws[i] || chr(1) || ws[i+1] || chr(1) || ws[i+2] || chr(1) || ws[i+3] || chr(1) || ws[i+4] AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), st AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines,
         length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals,
         length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits
  FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_capitals > word_chars OR 2 * n_digits > word_chars) AS kept
FROM v
"""
