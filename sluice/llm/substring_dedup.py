"""Substring deduplication by collinear chaining.

Seeds are hashed runs of ``SEED`` words, thinned by winnowing: of any ``WINNOW`` runs in a row the least hash is kept, so
that two texts with a long passage in common share seeds. In periodic text a seed recurs every few words; such a run is
thinned and its seeds are numbered, so that the k-th meets the k-th of another run. Seeds that stand in different texts are joined; of a shared
seed's places the first and the last text's are its pivots, and each other place is matched with those, so a seed that
thousands of texts share gives two matches a place and never pairs. Only stretches in which shared seeds follow one
another are matched; a short line that many texts share makes none.

The matches of two texts are chained: a chain ascends in both texts, a seed adds to its score and the distance to the
previous one in both texts costs, and a Fenwick tree over the second text's positions gives each match its best
predecessor. Chains are aligned word by word: extended at both ends while most words agree, and kept if they span at
least 50 words whose longest common subsequence covers 0.8 of the longer side. A chain that bridges too much to be one
passage is split at its gaps, and its parts are aligned.

What the pivots do not explain is matched once more, among itself and in another order of the texts: by seed, and by
runs of 2 and of 4 seeds that follow one another, so that the pivots of a longer run are texts that share more of it than
a clause that is frequent elsewhere. What is left is settled exactly: every run of 50 words of a stretch that no passage
covers is looked up by its hash among the runs of all stretches. The shared seeds that still lie in no passage are matched
with all texts, not with pivots: every text that shares two seeds near such a place, as far apart as a chain spans at
least and up to ``APART`` words, is compared by the words beside both. Texts that may have a new passage there are chained and
aligned, on the seeds within ``REACH`` words. The comparisons grow with the square of the number of texts that share a clause
of that length; chains are made for few of them. The number of passes does not depend on the data.

Defined results: null and empty texts have no passages; texts of fewer than 50 words have none; equal texts of at
least 50 words are one passage as a whole; a passage repeated only within one text is none; rows that share an id are
told apart, repeated rows each get their rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import SLICE_BYTES, UINT, binaries, by_content, complete_groups, forget, give_back, hash_words, mix, pruned, split_words, text_ranges, texts_of, window_hashes, written

SEED, WINNOW = 5, 8
#: Least words of a passage; share of its words that have to agree; words between shared seeds that end a stretch.
PASSAGE, AGREE, BREAK = 50, 0.8, 30
#: Least words that shared seeds span. In an exact passage it is PASSAGE - 2 * (WINNOW - 1) or more; edited ones have fewer.
LEAST_SPAN = 28
#: Seeds in a row by which the second pass matches.
RUNS = (1, 2, 4)
#: Score of a seed, and the cost of a word of distance in either text.
GAIN, GAP = 6.0, 0.15
MARGIN = 40


def winnow(h: np.ndarray, owner: np.ndarray, pos: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Which hashes are least in some window of ``width`` hashes of one text."""
    n = len(h)
    if not n:
        return np.zeros(0, bool)
    low = h.copy()
    for s in range(1, min(width, n)):
        low[: n - s] = np.where(owner[s:] == owner[: n - s], np.minimum(low[: n - s], h[s:]), low[: n - s])
    count = np.bincount(owner)[owner]
    whole = (pos + width <= count) | (pos == 0)
    chosen = np.zeros(n, bool)
    for s in range(min(width, n)):
        chosen[s:] |= whole[: n - s] & (owner[s:] == owner[: n - s]) & (h[s:] == low[: n - s])
    return chosen


def numbered(h: np.ndarray, owner: np.ndarray, pos: np.ndarray, width: int = WINNOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thins seeds that recur within ``BREAK`` words, as in periodic text, to one in ``width`` words.

    The k-th of such a run becomes a seed of its own, so that it meets the k-th of another text's run and not all.
    """
    order = np.lexsort((pos, h, owner))
    h, owner, pos = h[order], owner[order], pos[order]
    if not len(h):
        return h, owner, pos
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(pos) > BREAK)])
    start = np.flatnonzero(new)
    nth = (pos - np.repeat(pos[start], np.diff(np.concatenate([start, [len(pos)]])))) // width
    keep = new | np.concatenate([[True], nth[1:] != nth[:-1]])
    h = np.where(nth > 0, mix(h ^ mix(nth.astype(UINT))), h)[keep]
    owner, pos = owner[keep], pos[keep]
    order = np.lexsort((pos, owner))
    return h[order], owner[order], pos[order]


_SEEDED = "_row long, doc_id long, h1 long, h2 long, d long, n long, seeds array<long>, at array<int>"


def _seeded(docs: DataFrame) -> DataFrame:
    """Each row's number of words and seeds, and a number for the row, which holds once this is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b in text_ranges(rb.column("text")):
                flat, counts = split_words(binaries(rb.column("text").slice(a, b - a)))
                h, owner, pos = window_hashes(hash_words(flat), counts, SEED)
                keep = winnow(h, owner, pos)
                h, owner, pos = numbered(h[keep], owner[keep], pos[keep])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]), pa.int32())
                names = ["_row", "doc_id", "h1", "h2", "d"]
                yield pa.RecordBatch.from_arrays(
                    [*(rb.column(c)[a:b] for c in names), pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(pos.astype(np.int32)))],
                    names=[*names, "n", "seeds", "at"],
                )
                give_back()

    return docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, _SEEDED)


def _runs(places: DataFrame) -> DataFrame:
    """The places (seed, t, pos) by the runs of RUNS seeds they stand in: ``seed`` is the run's hash and the place in it.

    Each place of a run is a row, so all of them meet the same pivot; seeds more than ``BREAK`` words apart make no run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in complete_groups(batches, ["t"]):
            t, pos, seed = g.column("t").to_numpy(), g.column("pos").to_numpy(), g.column("seed").to_numpy().view(UINT)
            near = (t[1:] == t[:-1]) & (np.diff(pos) <= BREAK)
            for n in RUNS:
                m = len(t) - n + 1
                if m <= 0:
                    continue
                h, whole = np.full(m, n, UINT), np.ones(m, bool)
                for k in range(n):
                    h = mix(h ^ seed[k : k + m])
                for k in range(n - 1):
                    whole &= near[k : k + m]
                for k in range(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(mix(h ^ UINT(k))[whole].view(np.int64)), pa.array(t[k : k + m][whole]), pa.array(pos[k : k + m][whole])], names=["seed", "t", "pos"]
                    )

    return places.select("seed", "t", "pos").repartition("t").sortWithinPartitions("t", "pos").mapInArrow(run, "seed long, t long, pos int")


def _pivoted(places: DataFrame, turn: int = 0) -> DataFrame:
    """The places of seeds that stand in different texts, beside the seed's first and last; each turn orders texts anew.

    One shuffle and one sort of the places: most seeds stand in one text, so an aggregate to join with would be as large
    as the places. Spark spills a seed's places beyond a few thousand.
    """
    order = [F.xxhash64("t", F.lit(turn)), "t", "pos"] if turn else ["t", "pos"]
    whole = Window.partitionBy("seed").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {f"{end}_{c}": at(c).over(whole) for end, at in (("lo", F.first), ("hi", F.last)) for c in ("t", "pos")}
    return places.select("seed", "t", "pos").withColumns(ends).where("lo_t <> hi_t")


def _stretches(shared: DataFrame) -> DataFrame:
    """The matches (t, pos, p, q) of shared seeds that lie in long enough stretches; the stretch is named by its start."""
    rows = shared.select("seed", "t", "pos", F.col("lo_t").alias("p1"), F.col("lo_pos").alias("q1"), F.col("hi_t").alias("p2"), F.col("hi_pos").alias("q2"))
    rows = rows.repartition("t").distinct().sortWithinPartitions("t", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in complete_groups(batches, ["t"]):
            text, pos, seed, p1, q1, p2, q2 = (t.column(c).to_numpy() for c in ("t", "pos", "seed", "p1", "q1", "p2", "q2"))
            new = np.concatenate([[True], (text[1:] != text[:-1]) | (np.diff(pos) > BREAK)])
            run_ = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(pos)]]) - 1
            keep = (pos[last] + SEED - pos[first] >= LEAST_SPAN)[run_]
            start = pos[first][run_]
            for p, q in ((p1, q1), (p2, q2)):
                use = keep & (p != text)
                yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (text, pos, seed, start, p, q)], names=["t", "pos", "seed", "start", "p", "q"])

    return rows.mapInArrow(run, "t long, pos int, seed long, start int, p long, q int")


def chains(x: Sequence[int], y: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """Best chains of matches sorted by x: each as first x, last x, first y, last y; no match is in two."""
    return [(x[c[0]], x[c[-1]], y[c[0]], y[c[-1]]) for c in linked(x, y)]


def linked(x: Sequence[int], y: Sequence[int]) -> list[list[int]]:
    """The same chains, each as its matches."""
    n = len(x)
    levels = sorted(set(y))
    tree = [(-1e18, -1)] * (len(levels) + 1)  # best (score + gap credit, match) of a prefix of levels
    score, back = [0.0] * n, [-1] * n
    waiting: list[int] = []  # matches of the current x: they may not precede one another
    for i in range(n):
        if waiting and x[waiting[0]] != x[i]:
            for j in waiting:
                _raise(tree, bisect_left(levels, y[j]) + 1, (score[j] + GAP * (x[j] + y[j]), j))
            waiting = []
        best, k = (-1e18, -1), bisect_left(levels, y[i])  # levels below y[i]
        while k > 0:
            if tree[k] > best:
                best = tree[k]
            k &= k - 1
        gained = best[0] - GAP * (x[i] + y[i])
        score[i], back[i] = (GAIN + gained, best[1]) if gained > 0 else (GAIN, -1)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        chain = [i]
        used[i] = True
        while back[chain[-1]] >= 0 and not used[back[chain[-1]]]:
            chain.append(back[chain[-1]])
            used[chain[-1]] = True
        j = chain[-1]
        if x[i] + SEED - x[j] >= LEAST_SPAN and y[i] + SEED - y[j] >= LEAST_SPAN // 2:
            out.append(chain[::-1])
    return out


def _raise(tree: list, k: int, value: tuple[float, int]) -> None:
    while k < len(tree):
        if value > tree[k]:
            tree[k] = value
        k += k & -k


_CHAINED = "t long, p long, x0 int, x1 int, y0 int, y1 int, xs array<int>, ys array<int>"


def _linked_rows(t: int, p: int, x: list[int], y: list[int]) -> list[tuple]:
    """The chains of two texts' matches, sorted by x."""
    if not x or x[-1] + SEED - x[0] < LEAST_SPAN:
        return []
    return [(t, p, x[c[0]], x[c[-1]], y[c[0]], y[c[-1]], [x[i] for i in c], [y[i] for i in c]) for c in linked(x, y)]


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())), _CHAINED)


def _chained(matches: DataFrame) -> DataFrame:
    """The chains of each pair of texts, with their matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts in complete_groups(batches, ["t", "p"]):
            t, p = g.column("t").to_numpy(), g.column("p").to_numpy()
            x, y = g.column("pos").to_pylist(), g.column("q").to_pylist()
            rows = []
            for s, e in zip(starts, [*starts[1:], g.num_rows]):
                rows += _linked_rows(t[s], p[s], x[s:e], y[s:e])
            if rows:
                yield _chain_batch(rows)

    return matches.select("t", "p", "pos", "q").repartition("t", "p").sortWithinPartitions("t", "p", "pos", "q").mapInArrow(run, _CHAINED)


def common_subsequence(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """Length of the longest common subsequence, one bit a word of ``b``."""
    bits: dict[bytes, int] = {}
    for i, w in enumerate(b):
        bits[w] = bits.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _extension(a: Sequence[bytes], b: Sequence[bytes]) -> tuple[int, int]:
    """How far two sequences run together from their starts: words of each, while matches outweigh differences."""
    i = j = 0
    best, score, at = 0, 0, (0, 0)
    while i < len(a) and j < len(b) and score > best - 8:
        if a[i] == b[j]:
            score, i, j = score + 1, i + 1, j + 1
        elif i + 1 < len(a) and a[i + 1] == b[j]:
            score, i = score - 2, i + 1
        elif j + 1 < len(b) and a[i] == b[j + 1]:
            score, j = score - 2, j + 1
        else:
            score, i, j = score - 3, i + 1, j + 1
        if score > best:
            best, at = score, (i, j)
    return at


def aligned(a: Sequence[bytes], b: Sequence[bytes], ax: tuple[int, int], by: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """The chain's passage in both word lists after extension, or None if too short or too different."""
    l, m = _extension(a[: ax[0]][::-1], b[: by[0]][::-1])
    r, s = _extension(a[ax[1] :], b[by[1] :])
    x0, x1, y0, y1 = ax[0] - l, ax[1] + r, by[0] - m, by[1] + s
    n, k = x1 - x0, y1 - y0
    if min(n, k) < PASSAGE or min(n, k) < AGREE * max(n, k):
        return None
    left, right = a[x0:x1], b[y0:y1]
    if left != right and common_subsequence(left, right) < AGREE * max(n, k):
        return None
    return x0, x1, y0, y1


def passages(a: Sequence[bytes], b: Sequence[bytes], xs: Sequence[int], ys: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """The passages of a chain of matches: as a whole, or else of the parts that its gaps leave.

    A chain may bridge what the texts do not share. One that does not align is cut wherever ``BREAK`` words have no
    match, and a part that does not align at its largest gap, down to single matches: extension gives an exact
    passage from any of its matches. An end that agrees in less than half of what differs up to it is tried by itself,
    so a clause beyond other words is not drawn in. Matches inside a passage already found are not tried again.
    """
    out: list[tuple[int, int, int, int]] = []
    worth = []
    for k in range(1, len(xs)):
        left, right = a[xs[k - 1] + SEED : xs[k]], b[ys[k - 1] + SEED : ys[k]]
        worth.append(len(left) if left == right else 3 * common_subsequence(left, right) - 2 * max(len(left), len(right)))
    step = [min(SEED, xs[k] - xs[k - 1]) for k in range(1, len(xs))]
    gaps = [max(xs[i] - xs[i - 1], ys[i] - ys[i - 1]) for i in range(1, len(xs))]
    open_ = [(0, len(xs))]
    while open_:
        i, j = open_.pop()
        if any(x0 <= xs[i] and xs[j - 1] + SEED <= x1 and y0 <= ys[i] and ys[j - 1] + SEED <= y1 for x0, x1, y0, y1 in out):
            continue
        cut, gain = 0, SEED
        for k in range(i + 1, j):
            if gain + worth[k - 1] < 0:
                cut = k
                break
            gain += worth[k - 1] + step[k - 1]
        else:
            gain = SEED
            for k in range(j - 1, i, -1):
                if gain + worth[k - 1] < 0:
                    cut = k
                    break
                gain += worth[k - 1] + step[k - 1]
        if cut:
            open_ += [(cut, j), (i, cut)]
            continue
        got = aligned(a, b, (xs[i], xs[j - 1] + SEED), (ys[i], ys[j - 1] + SEED))
        if got:
            out.append(got)
        elif j - i > 1:
            cuts = [k for k in range(i + 1, j) if gaps[k - 1] > BREAK] or [max(range(i + 1, j), key=lambda k: gaps[k - 1])]
            open_ += reversed(list(zip([i, *cuts], [*cuts, j])))
    return out


def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with all their ranges: k, lo, hi, words from MARGIN before ``lo`` to MARGIN after ``hi``, and where those begin."""
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
    for rb in batches:
        keys, ranges = rb.column("k").to_numpy(), rb.column("ranges")
        for a, b in text_ranges(rb.column("text")):
            rows, size = [], 0
            for k, t, wanted in zip(keys[a:b].tolist(), binaries(rb.column("text").slice(a, b - a)), ranges.slice(a, b - a)):
                words = t.split()
                lo, hi = (wanted.values.field(c).to_pylist() for c in ("lo", "hi"))
                for x, y in zip(lo, hi):
                    start = max(0, x - MARGIN)
                    rows.append((k, x, y, b" ".join(words[start : y + SEED + MARGIN]), start))
                    size += len(rows[-1][3])
                    if size > SLICE_BYTES:  # near copies of a long text ask for nearly all of it, each by other ends
                        yield _batch(rows, types, _CUT)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, types, _CUT)
            give_back()


_CUT = "k long, lo int, hi int, words binary, first int"


def _cut(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The words that the chains span in their texts, each range once.

    A worker gets a text once, beside its ranges: were it beside each chain, a batch would hold it thousands of times.
    """
    ends = F.array(*(F.struct(F.col(k).alias("k"), F.col(lo).alias("lo"), F.col(hi).alias("hi")) for k, lo, hi in (("t", "x0", "x1"), ("p", "y0", "y1"))))
    ranges = found.select(F.inline(ends)).groupBy("k").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    return ranges.join(texts.select(F.col("t").alias("k"), "text"), "k").select("k", "ranges", "text").mapInArrow(cuts, _CUT)


def _batch(rows: list[tuple], types: Sequence[pa.DataType], schema: str) -> pa.RecordBatch:
    """Rows as a batch with the names of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[x.split()[0] for x in schema.split(", ")])


_ALIGNED = "t long, p long, x0 int, x1 int, y0 int, y1 int"


def _passages(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The chains whose alignment is a passage: text, partner, and the places in both."""
    words = _cut(found, texts)

    def side(k: str, lo: str, hi: str, out: str) -> DataFrame:
        return words.select(F.col("k").alias(k), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("words").alias(out), F.col("first").alias(f"{out}_from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for rb in batches:
            for s, e in text_ranges(rb.column("a")):
                c = {n: rb.column(n).slice(s, e - s).to_pylist() for n in rb.schema.names}
                rows = []
                for i in range(e - s):
                    af, bf = c["a_from"][i], c["b_from"][i]
                    for x0, x1, y0, y1 in passages(c["a"][i].split(), c["b"][i].split(), [x - af for x in c["xs"][i]], [y - bf for y in c["ys"][i]]):
                        rows.append((c["t"][i], c["p"][i], x0 + af, x1 + af, y0 + bf, y1 + bf))
                if rows:
                    yield _batch(rows, types, _ALIGNED)
                del c
                give_back()

    return found.join(side("t", "x0", "x1", "a"), ["t", "x0", "x1"]).join(side("p", "y0", "y1", "b"), ["p", "y0", "y1"]).mapInArrow(run, _ALIGNED)


def _explained(chained: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """t, start, stop, p: the passages that these chains align to, for both texts of each; ``texts`` gives those it is asked for."""
    chained = written(chained, "substring-chains")
    side = lambda t, lo, hi, p: F.struct(F.col(t).alias("t"), F.col(lo).alias("start"), F.col(hi).alias("stop"), F.col(p).alias("p"))
    words = texts(chained.select("t").unionAll(chained.select(F.col("p").alias("t"))).distinct())
    found = written(_passages(chained, words).select(F.inline(F.array(side("t", "x0", "x1", "p"), side("p", "y0", "y1", "t")))), "substring-spans")
    forget(chained)
    return found


def _merged(spans: DataFrame) -> DataFrame:
    """t, start, stop, p: each text's passages, overlapping ones as one, with the partner of the longest.

    A text's spans are first reduced to one for each start, so a text that meets thousands still has few.
    """
    longest = spans.groupBy("t", "start").agg(F.max(F.struct("stop", "p")).alias("m")).select("t", "start", "m.stop", "m.p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in complete_groups(batches, ["t"]):
            rows: list[list[int]] = []
            size = 0
            for t, a, b, p in zip(*(g.column(c).to_pylist() for c in ("t", "start", "stop", "p"))):
                if rows and rows[-1][0] == t and a < rows[-1][2]:
                    if b - a > size:
                        rows[-1][3], size = p, b - a
                    rows[-1][2] = max(rows[-1][2], b)
                else:
                    rows.append([t, a, b, p])
                    size = b - a
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), types)], names=["t", "start", "stop", "p"])

    return longest.repartition("t").sortWithinPartitions("t", "start").mapInArrow(run, "t long, start int, stop int, p long")


def _uncovered(matches: DataFrame, spans: DataFrame) -> DataFrame:
    """t, pos, seed: the matched places that no passage covers."""
    covered = _merged(spans).select("t", "start", "stop")
    return matches.select("t", "pos", "seed").distinct().alias("m").join(
        covered.alias("c"), (F.col("m.t") == F.col("c.t")) & (F.col("m.pos") >= F.col("c.start")) & (F.col("m.pos") < F.col("c.stop")), "left_anti"
    )


_WINDOWS = "t long, pos int, h long"


def _windows(stretched: DataFrame, covered: bool) -> DataFrame:
    """The runs of PASSAGE words that may repeat, by hash: those inside a passage that is known, or the others.

    ``stretched`` has t, text, stretches (first and last shared seed) and known (passages). A repeated run lies within
    its stretch but for the words that winnowing leaves at both ends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids = rb.column("t").to_numpy()
            stretches, known = rb.column("stretches").to_pylist(), rb.column("known").to_pylist()
            for a, b in text_ranges(rb.column("text"), 1 << 20):
                flat, counts = split_words(binaries(rb.column("text").slice(a, b - a)))
                h, owner, pos = window_hashes(hash_words(flat), counts, PASSAGE)
                first = np.searchsorted(owner, np.arange(b - a + 1))
                use = np.zeros(len(h), bool)
                for i in range(b - a):
                    at, mine = pos[first[i] : first[i + 1]], use[first[i] : first[i + 1]]
                    inside = np.zeros(len(at), bool)
                    for s in stretches[a + i]:
                        mine |= (at >= s["lo"] - (WINNOW - 1)) & (at + PASSAGE <= s["hi"] + SEED + WINNOW - 1)
                    for s in known[a + i] or []:
                        inside |= (at >= s["start"]) & (at + PASSAGE <= s["stop"])
                    mine &= inside if covered else ~inside
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][owner[use]]), pa.array(pos[use].astype(np.int32)), pa.array(h[use].view(np.int64))], names=["t", "pos", "h"])

    return stretched.mapInArrow(run, _WINDOWS)


def _exact(matches: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """t, start, stop, p: the runs of PASSAGE words outside known passages that another text has too."""
    ends = matches.groupBy("t", "start").agg(F.max("pos").alias("hi"))
    stretched = ends.groupBy("t").agg(F.collect_list(F.struct(F.col("start").alias("lo"), "hi")).alias("stretches"))
    stretched = stretched.join(known.groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("known")), "t", "left")
    reach = WINNOW - 1
    whole = F.forall("stretches", lambda s: F.exists("known", lambda k: (k["start"] <= F.greatest(s["lo"] - reach, F.lit(0))) & (k["stop"] >= s["hi"] + SEED + reach)))
    rows = written(
        texts.join(stretched, "t").select("t", "text", "stretches", "known", F.coalesce(whole, F.lit(False)).alias("whole")),
        "substring-stretches",
    )
    fresh = written(_windows(rows.where("not whole").drop("whole"), False), "substring-windows")
    partners = pruned(_windows(rows.drop("whole"), True), "h", fresh)
    ends = fresh.select("h", "t").unionAll(partners.select("h", "t")).groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi")
    partner = F.when(F.col("lo") == F.col("t"), F.col("hi")).otherwise(F.col("lo"))
    found = written(fresh.join(ends, "h").select("t", F.col("pos").alias("start"), (F.col("pos") + PASSAGE).alias("stop"), partner.alias("p")), "substring-exact")
    forget(rows, fresh)
    return found


def _keys(owner: np.ndarray, pos: np.ndarray, seed: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an owner's sorted places ``least`` to ``most`` words apart: first, second, and a hash of both seeds."""
    first, second, k = [], [], 1
    while k < len(pos):
        d = pos[k:] - pos[:-k]
        within = (owner[k:] == owner[:-k]) & (d <= most)
        if not within.any():
            break
        i = np.flatnonzero(within & (d >= least))
        first.append(i)
        second.append(i + k)
        k += 1
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, second))
    seed = seed.view(UINT)
    return i, j, mix(mix(seed[i]) ^ seed[j]).view(np.int64)


#: Words around an uncovered place from which its chain's other seeds are taken.
REACH = BREAK + LEAST_SPAN
#: Words between two seeds by which texts meet: the ends of what spans less than LEAST_SPAN, and the next seed within REACH.
APART = REACH + LEAST_SPAN - SEED


def _near(places: DataFrame) -> DataFrame:
    """Of the places (t, pos, seed, fresh) those with an uncovered one within ``REACH``, by stretches (start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in complete_groups(batches, ["t"]):
            t, pos, fresh = (g.column(c).to_numpy() for c in ("t", "pos", "fresh"))
            at = np.arange(len(t))
            before, after = np.maximum.accumulate(np.where(fresh, at, 0)), np.minimum.accumulate(np.where(fresh, at, len(t) - 1)[::-1])[::-1]
            near = fresh.copy()
            for other in (before, after):
                near |= fresh[other] & (t[other] == t) & (np.abs(pos[other] - pos) <= REACH)
            g, t, pos = g.filter(pa.array(near)), t[near], pos[near]
            if not len(t):
                continue
            first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (np.diff(pos) > BREAK)]))
            sizes = np.diff(np.concatenate([first, [len(t)]]))
            wide = np.repeat(pos[first + sizes - 1] + SEED - pos[first] >= LEAST_SPAN, sizes)
            yield from g.append_column("start", pa.array(np.repeat(pos[first], sizes))).filter(pa.array(wide)).to_batches()

    return places.select("t", "pos", "seed", "fresh").repartition("t").sortWithinPartitions("t", "pos").mapInArrow(run, "t long, pos int, seed long, fresh boolean, start int")


def _sought(matches: DataFrame, open_: DataFrame) -> DataFrame:
    """t, pos, seed, fresh, start: the uncovered places (fresh) and those near them."""
    known = matches.join(open_.select("t").distinct(), "t", "left_semi").select("t", "pos", "seed").distinct()
    known = known.join(open_.withColumn("fresh", F.lit(True)), ["t", "pos", "seed"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    return written(_near(known), "substring-sought")


def _holding(sought: DataFrame, seeded: DataFrame, holders: DataFrame) -> DataFrame:
    """t, seed, pos: all places of the seeds of ``sought``."""
    own = seeded.select(F.col("_row").alias("t"), F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("t", F.col("s.seeds").alias("seed"), F.col("s.at").alias("pos"))
    # inner joins with distinct keys: the optimizer pushes semi joins below the filter's join, so all places would be shuffled
    own = pruned(own, "seed", sought.select("seed")).join(sought.select("seed").distinct(), "seed")
    return written(own.join(holders.select("t"), "t").select("t", "seed", "pos"), "substring-places")


#: A row of a key: its text, whether it is sought (tells), both seeds' places, the known passage that holds both, and hashes of the words before the first and after the second.
_HELD = "key long, t long, tells int, i int, j int, lo int, hi int, before binary, after binary"
_HELD_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(2 * MARGIN + 4), pa.binary(2 * MARGIN + 4))


def _words_beside(wanted: DataFrame) -> DataFrame:
    """The rows of texts (t, text, keys, known) as ``_HELD``: ``MARGIN`` words each way, as many as an alignment extends over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, keys, known = rb.column("t").to_numpy(), rb.column("keys"), rb.column("known").to_pylist()
            for a, b in text_ranges(rb.column("text")):
                flat, counts = split_words(binaries(rb.column("text").slice(a, b - a)))
                words, first = word_marks(hash_words(flat)), np.concatenate([[0], np.cumsum(counts)])
                for n, (tells, i, j, key) in enumerate(_listed(keys.slice(a, b - a))):
                    order = np.lexsort((-tells, j, i, key))  # a place that tells is held as well: one row
                    tells, i, j, key = (x[order] for x in (tells, i, j, key))
                    one = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
                    tells, i, j, key = (x[one] for x in (tells, i, j, key))
                    mine = np.concatenate([np.zeros(MARGIN + 2, np.uint16), words[first[n] : first[n + 1]], np.zeros(MARGIN + 2 + SEED, np.uint16)])
                    spans = sorted((s["start"], s["stop"]) for s in known[a + n] or [])
                    starts, stops = (np.array([-1, *x], np.int32) for x in zip(*spans)) if spans else (np.array([-1], np.int32),) * 2
                    at = np.searchsorted(starts, i, side="right") - 1
                    held = stops[at] >= j + SEED
                    lo, hi = np.where(held, starts[at], np.iinfo(np.int32).max), np.where(held, stops[at], -1)
                    step = np.arange(MARGIN, dtype=np.int64)
                    for s in range(0, len(key), 8192):
                        c = slice(s, s + 8192)
                        sides = (mine[i[c, None] + MARGIN + 1 - step], mine[j[c, None] + MARGIN + 2 + SEED + step])
                        beside = [pa.FixedSizeBinaryArray.from_buffers(_HELD_TYPES[-1], len(x), [None, pa.py_buffer(np.pad(x, ((0, 0), (0, 2))).tobytes())]) for x in sides]
                        columns = (key[c], np.full(len(i[c]), ids[a + n]), tells[c], i[c], j[c], lo[c], hi[c])
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x, k) for x, k in zip(columns, _HELD_TYPES)), *(x.cast(pa.binary()) for x in beside)], names=[x.split()[0] for x in _HELD.split(", ")]
                        )
                give_back()

    return wanted.select("t", "text", "keys", "known").mapInArrow(run, _HELD)


def word_marks(h: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash, never 0, which stands beyond a text's ends."""
    return np.maximum(h >> UINT(48), UINT(1)).astype(np.uint16)


def extensions(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_extension`` for many pairs at a time: ``words`` has a row of marks for each place, 0 beyond its end; ``a`` and ``b`` are rows."""
    width, flat = words.shape[1], words.reshape(-1)
    ends_a, ends_b = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    which, i, j = np.arange(len(a)), a * width, b * width
    score, best = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
    while len(which):
        x, y = flat[i], flat[j]
        go = (x != 0) & (y != 0) & (score > best - 8)
        if not go.all():
            which, i, j, x, y, score, best = (c[go] for c in (which, i, j, x, y, score, best))
        same = x == y
        skip_a = ~same & (flat[i + 1] == y)
        skip_b = ~same & ~skip_a & (x == flat[j + 1])
        score += np.where(same, 1, np.where(skip_a | skip_b, -2, -3)).astype(np.int32)
        i, j = i + ~skip_b, j + ~skip_a
        more = np.flatnonzero(score > best)
        best[more] = score[more]
        w = which[more]
        ends_a[w], ends_b[w] = i[more] - a[w] * width, j[more] - b[w] * width
    return ends_a, ends_b


#: Pairs of places that a worker looks at at a time.
_PAIRS = 1 << 17


def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, p: the texts of a key that may have a new passage there, of ``_HELD`` sorted by key.

    Most pairs of a key share a clause and nothing around it. The words beside both seeds tell how far an alignment extends
    beyond them; if with that it spans less than ``PASSAGE``, or lies in what is known of both texts, the pair is left out.
    A chain's own ends are a key like others, and of a chain beyond ``APART`` words any key inside it spans ``PASSAGE``.
    """
    for g, starts in complete_groups(batches, ["key"]):
        t, told, i, j, lo, hi = (g.column(c).to_numpy() for c in ("t", "tells", "i", "j", "lo", "hi"))
        before, after = (np.frombuffer(b"".join(g.column(c).to_pylist()), np.uint16).reshape(g.num_rows, -1) for c in ("before", "after"))
        sizes = np.diff(np.append(starts, g.num_rows))
        own = np.repeat(np.arange(len(starts)), sizes)
        tells = np.flatnonzero(told)
        tells = tells[sizes[own[tells]] > 1]
        ends = np.cumsum(sizes[own[tells]])
        at = 0
        while at < len(tells):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
            part = tells[at:stop]
            n = sizes[own[part]]
            a = np.repeat(part, n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own[part]], n)
            at = stop
            use = t[a] != t[b]
            a, b = a[use], b[use]
            left_a, left_b = extensions(before, a, b)
            right_a, right_b = extensions(after, a, b)
            a0, a1, b0, b1 = i[a] - left_a, j[a] + SEED + right_a, i[b] - left_b, j[b] + SEED + right_b
            new = (a0 < lo[a]) | (a1 > hi[a]) | (b0 < lo[b]) | (b1 > hi[b])
            use = np.flatnonzero(new & (a1 - a0 >= PASSAGE) & (b1 - b0 >= PASSAGE))
            if len(use):
                found = pa.table({"t": t[a[use]], "p": t[b[use]]})
                yield from found.group_by(["t", "p"]).aggregate([]).to_batches()


def _met(sought: DataFrame, places: DataFrame, known: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The chains of uncovered places and those near them with all texts that may hold one, and the texts of both."""

    # a chain that spans LEAST_SPAN has two places that are so far apart: texts meet by both seeds, those of covered places too, as a passage may reach beyond its chain
    def ours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, starts in complete_groups(batches, ["t", "start"]):
            pos, seed = (g.column(c).to_numpy() for c in ("pos", "seed"))
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, g.num_rows)))
            i, j, key = _keys(own, pos, seed, LEAST_SPAN - SEED, APART)
            yield from g.select(["t"]).take(pa.array(i)).append_column("i", pa.array(pos[i])).append_column("j", pa.array(pos[j])).append_column("key", pa.array(key)).to_batches()

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in complete_groups(batches, ["t"]):
            t, pos, seed = (g.column(c).to_numpy() for c in ("t", "pos", "seed"))
            i, j, key = _keys(t, pos, seed, 1, int(APART / AGREE))
            yield pa.RecordBatch.from_arrays([pa.array(t[i]), pa.array(pos[i]), pa.array(pos[j]), pa.array(key)], names=["t", "i", "j", "key"])

    tells = sought.select("t", "start", "pos", "seed").repartition("t").sortWithinPartitions("t", "start", "pos").mapInArrow(ours, "t long, i int, j int, key long")
    tells = written(tells, "substring-keys")
    held = places.select("t", "pos", "seed").repartition("t").sortWithinPartitions("t", "pos").mapInArrow(others, "t long, i int, j int, key long")
    held = written(pruned(held, "key", tells), "substring-held")
    several = held.groupBy("key").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("key")
    rows = tells.withColumn("tells", F.lit(1)).unionByName(held.withColumn("tells", F.lit(0))).join(several, "key")
    listed = written(rows.groupBy("t").agg(F.collect_list(F.struct("tells", "i", "j", "key")).alias("keys")), "substring-listed")
    words = texts(listed.select("t"))
    spans = known.groupBy("t").agg(F.collect_list(F.struct("start", "stop")).alias("known"))
    beside = _words_beside(words.join(listed, "t").join(spans, "t", "left"))
    pairs = written(beside.repartition("key").sortWithinPartitions("key").mapInArrow(meeting, "t long, p long").distinct(), "substring-pairs")
    forget(held, listed)
    theirs = places.select("seed", F.col("t").alias("p"), F.col("pos").alias("q"))
    # all of a text's places: a chain may begin where the score of one before it still counts
    both = pairs.join(sought.select("t", "start", "pos", "seed"), "t").join(theirs, ["seed", "p"])
    lists = both.groupBy("t", "p").agg(F.sort_array(F.collect_list(F.struct("start", "pos", "q"))).alias("at"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = []
            for t, p, at in zip(rb.column("t").to_pylist(), rb.column("p").to_pylist(), _listed(rb.column("at"))):
                first = np.flatnonzero(np.concatenate([[True], at[0][1:] != at[0][:-1]]))
                wide = at[1][np.append(first[1:], len(at[0])) - 1] - at[1][first] >= LEAST_SPAN - SEED
                use = np.repeat(wide, np.diff(np.append(first, len(at[0]))))
                rows += _linked_rows(t, p, at[1][use].tolist(), at[2][use].tolist())
            if rows:
                yield _chain_batch(rows)

    return lists.mapInArrow(chain, _CHAINED), words


def _listed(column: pa.ListArray) -> Iterator[list[np.ndarray]]:
    """Each list of a column of lists of structs as one array a field."""
    flat, ends = column.flatten(), np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    fields = [f.to_numpy() for f in flat.flatten()]
    for a, b in zip(ends, ends[1:]):
        yield [f[a:b] for f in fields]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words, partner_id, kept: one row for each repeated passage of each row.

    The partner is a row with the same passage; ``kept`` marks the holder to keep, the smaller id of the two.
    """
    docs = by_content(docs)
    seeded = written(_seeded(docs), "substring-seeds")
    one = F.min(F.struct("_row", "d")).alias("one")
    holders = seeded.groupBy("h1", "h2").agg(one, F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("rows"), F.first("n").alias("n"))
    holders = written(holders.select(F.col("one._row").alias("t"), F.col("one.d").alias("d"), "h1", "h2", "first_id", "last_id", "rows", "n"), "substring-texts")
    firsts = seeded.join(holders.select(F.col("t").alias("_row")), "_row", "left_semi").select(F.col("_row").alias("t"), "seeds", "at")
    places = firsts.select("t", F.explode(F.arrays_zip("seeds", "at")).alias("s")).select("t", F.col("s.seeds").alias("seed"), F.col("s.at").alias("pos"))
    matches = written(_stretches(_pivoted(places)), "substring-matches")
    fetched = lambda wanted: texts_of(docs, holders.select("t", "h1", "h2", "d").join(wanted, "t"), "t")
    texts = written(fetched(matches.select("t").unionAll(matches.select(F.col("p").alias("t"))).distinct()), "substring-words")
    first = _explained(_chained(matches), lambda wanted: texts.join(wanted, "t", "left_semi"))
    # what no passage covers yet is matched among itself
    runs = written(_runs(_uncovered(matches, first)), "substring-runs")
    again = written(_stretches(_pivoted(runs, 1)).select("t", "p", "pos", "q").distinct(), "substring-matches")
    spans = first.unionAll(_explained(_chained(again), lambda wanted: texts.join(wanted, "t", "left_semi")))
    forget(runs, again)
    copies = holders.where((F.col("rows") > 1) & (F.col("n") >= PASSAGE)).select("t", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"), F.col("t").alias("p"))
    spans = spans.unionAll(copies)
    spans = spans.unionAll(_exact(matches, texts, _merged(spans)))
    forget(texts)
    # and what is still left with all texts
    known = written(_merged(spans), "substring-known")
    sought = _sought(matches, written(_uncovered(matches, known), "substring-open"))
    chained, words = _met(sought, _holding(sought, seeded, holders), known, lambda wanted: written(fetched(wanted), "substring-words"))
    spans = spans.unionAll(_explained(chained, lambda wanted: words.join(wanted, "t", "left_semi")))
    merged = _merged(spans)
    partner = holders.select(F.col("t").alias("p"), "first_id", "last_id")
    rows = seeded.select("doc_id", "h1", "h2").join(holders.select("h1", "h2", "t"), ["h1", "h2"]).select("t", "doc_id")
    out = merged.join(partner, "p").join(rows, "t")
    other = F.when((F.col("t") == F.col("p")) & (F.col("first_id") == F.col("doc_id")), F.col("last_id")).otherwise(F.col("first_id"))
    return out.select(
        "doc_id", F.col("start").cast("long").alias("start_word"), F.col("stop").cast("long").alias("end_word"),
        (F.col("stop") - F.col("start")).cast("long").alias("n_words"), other.alias("partner_id"), (F.col("doc_id") <= other).alias("kept"),
    )
