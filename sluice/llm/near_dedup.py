"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its five-word shingles, a shingle's weight being how often it stands there.
DartMinHash throws darts at the plane of (element, weight) by rank, from hashes alone, so that all documents see the
same darts. A document's region lies below its weights; of the darts in it the earliest (least rank) in each of k
coordinates makes up the signature. Two signatures agree in a coordinate with probability equal to the weighted
Jaccard similarity. Only darts below a rank bound set by the document's total weight are thrown, about k log k + 2k in
all, whatever its length; while a coordinate stays empty the bound is doubled.

The coordinates are cut into bands, and documents that agree in a band share a bucket. Every link is verified on the
shingles themselves (weighted Jaccard of at least 0.8); classes are the connected components of the links.

Size bounds. Equal texts are one representative from the start. Buckets are not expanded into pairs:

1. each member of a bucket is compared with the bucket's first member, which gives classes;
2. buckets in which several classes meet are dealt to cells of two bounded blocks; within a cell signatures are
   compared, and a forest of the likeliest links between classes is verified, which merges classes further;
3. the same once more, but every pair between different classes is verified whose signatures may mean 0.8 and whose
   texts each share enough with any others at all.

A pair that is never looked at thus lies within one class already, or cannot be similar, so no class lacks a link. What
remains is a cloud of texts just below 0.8 whose differences are shared as well: there the third step verifies pairs in
the square of the cloud's size, since nothing short of the texts tells these pairs from links.

Defined results: a null or empty text, or one without words, is a class of its own; a text of fewer than five words
is one shingle of all its words; equal texts are always one class; rows that share an id are told apart; an empty
table gives an empty result; other columns are ignored (``near_duplicates``) or kept (``deduplicate``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import UINT, binaries, by_content, complete_groups, components, free_name, give_back, hash_words, mix, slices, split_words, texts_of, window_hashes, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 misses all bands with probability (1 - 0.8**ROWS)**BANDS, about 0.0013.
BANDS, ROWS = 36, 8
K = BANDS * ROWS
#: Darts thrown at first.
DARTS = K * math.log(K) + 2 * K
#: Three standard deviations of the signatures' estimate at 0.8.
MARGIN = 3 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / K)
BLOCK = 512

_FIRST, _CELL = 2.0**-6, 8.0


def shingles(texts: Sequence[bytes | None], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text's index of each shingle of each text that has words."""
    flat, counts = split_words(texts)
    words = hash_words(flat)
    h, owner, _ = window_hashes(words, counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        ends = np.cumsum(counts)
        whole = [xxhash.xxh3_64_intdigest(words[ends[i] - counts[i] : ends[i]].tobytes()) for i in short]
        h, owner = np.concatenate([h, np.array(whole, UINT)]), np.concatenate([owner, short])
    return h, owner


def _region(r: int) -> tuple[float, float]:
    """Rank interval of region ``r``; the intervals double."""
    return (0.0, _FIRST) if r == 0 else (_FIRST * 2 ** (r - 1), _FIRST * 2 ** (r - 1))


def _poisson_steps(rate: float) -> np.ndarray:
    """Cumulative distribution of a Poisson variable, to the end of double precision."""
    p, total, out, n = math.exp(-rate), 0.0, [], 0
    while total + p > total:
        total += p
        out.append(total)
        n += 1
        p *= rate / n
    return np.array(out)


_STEPS = {2.0**e: _poisson_steps(2.0**e) for e in range(-6, 4)}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> UINT(11)).astype(np.float64) / float(1 << 53)


def _thrown(element: np.ndarray, owner: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts below their document's rank bound at unit-weight elements: document, rank, identity."""
    docs, ranks, ids = [], [], []
    limit, r, most = bound[owner], 0, bound.max(initial=0)
    while (at := _region(r)[0]) < most:
        length = _region(r)[1]
        cells = max(1, int(length / _CELL))
        size = length / cells
        for c in range(cells):
            start = at + c * size
            if start >= most:
                break
            alive = limit > start
            e, o = (element, owner) if alive.all() else (element[alive], owner[alive])
            z = mix(e ^ mix(np.array([(r << 32) + c], UINT)))
            n = np.searchsorted(_STEPS[size], _unit(z), side="right")
            hit = np.flatnonzero(n)
            n = n[hit]
            which = np.repeat(hit, n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            with np.errstate(over="ignore"):
                dart = mix(z[which] + (nth.astype(UINT) + UINT(1)) * UINT(0xD1342543DE82EF95))
            rank = start + size * _unit(mix(dart ^ UINT(0x5851F42D4C957F2D)))
            keep = rank < bound[o[which]]
            docs.append(o[which][keep])
            ranks.append(rank[keep])
            ids.append(dart[keep])
        r += 1
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, UINT)
    return np.concatenate(docs), np.concatenate(ranks), np.concatenate(ids)


def dart_minhash(h: np.ndarray, owner: np.ndarray, n_docs: int, k: int = K, darts: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (documents by k) of weighted sets given as element hashes, one for each unit of weight.

    Returns them and which documents have any element. The j-th unit of an element's weight is an element of its own,
    which is what integer weights mean for the region under them.
    """
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    nth = np.arange(len(h)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(h)]])))
    element = mix(h ^ mix(nth.astype(UINT)))
    total = np.bincount(owner, minlength=n_docs)
    has = total > 0
    out = np.zeros((n_docs, k), UINT)
    bound = np.where(has, (darts or DARTS) / np.maximum(total, 1), 0.0)
    while (bound > 0).any():
        alive = bound[owner] > 0
        doc, rank, dart = _thrown(element[alive], owner[alive], bound)
        at = doc * k + (dart % UINT(k)).astype(np.int64)
        best = np.full(n_docs * k, np.inf)
        np.minimum.at(best, at, rank)
        won = rank == best[at]
        sig = np.zeros(n_docs * k, UINT)
        sig[at[won]] = dart[won]
        full = np.isfinite(best).reshape(n_docs, k).all(1) & (bound > 0)
        out[full] = sig.reshape(n_docs, k)[full]
        bound = np.where(full, 0.0, bound * 2)
    return out, has


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(BANDS, dtype=UINT)), (len(sig), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key ^ parts[:, :, j])
    return key.view(np.int64)


_SIGNED = "_row long, doc_id long, h1 long, h2 long, d long, bands array<long>"


def _signed(docs: DataFrame) -> DataFrame:
    """Each row's band keys, and a number for the row, which holds once this is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = binaries(rb.column("text"))
            for a, b in slices(texts, 1 << 20):
                h, owner = shingles(texts[a:b])
                sig, has = dart_minhash(h, owner, b - a)
                keys = band_keys(sig)
                offsets = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].ravel()))
                names = ["_row", "doc_id", "h1", "h2", "d"]
                yield pa.RecordBatch.from_arrays([*(rb.column(c)[a:b] for c in names), bands], names=[*names, "bands"])
            del texts, h, owner, sig, keys
            give_back()

    return by_content(docs).withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, _SIGNED)


def _sketched(texts: DataFrame) -> DataFrame:
    """rep, bands, sig: band keys and short signature of each text, which has words.

    Made again from the texts that several classes' buckets hold: signatures are two thirds of what all rows would keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = binaries(rb.column("text"))
            for a, b in slices(rows, 1 << 20):
                h, owner = shingles(rows[a:b])
                sig, _ = dart_minhash(h, owner, b - a)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(band_keys(sig).ravel()))
                yield pa.RecordBatch.from_arrays([rb.column("rep")[a:b], bands, pa.array([x.tobytes() for x in sig.astype(np.uint16)], pa.binary())], names=["rep", "bands", "sig"])
            give_back()

    return texts.select("rep", "text").mapInArrow(run, "rep long, bands array<long>, sig binary")


def similar(a: Sequence[bytes], b: Sequence[bytes]) -> np.ndarray:
    """Whether each pair's weighted Jaccard similarity is at least 0.8, in whole numbers."""
    n = len(a)
    h, owner = shingles([*a, *b])
    pair, side = owner % n, owner // n
    order = np.lexsort((h, pair))
    h, pair, side = h[order], pair[order], side[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])])) if len(h) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(n, bool)
    right = np.add.reduceat(side, starts)
    left = np.diff(np.concatenate([starts, [len(h)]])) - right
    both = np.bincount(pair[starts], np.minimum(left, right), n)
    either = np.bincount(pair[starts], np.maximum(left, right), n)
    return (5 * both >= 4 * either) & (either > 0)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            left, right = binaries(rb.column("ta")), binaries(rb.column("tb"))
            for x, y in slices([l + r for l, r in zip(left, right)]):
                ok = similar(left[x:y], right[x:y])
                yield pa.RecordBatch.from_arrays([rb.column("a")[x:y], rb.column("b")[x:y]], names=["a", "b"]).filter(pa.array(ok))

    ta = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _weights(texts: DataFrame) -> DataFrame:
    """rep, total, common: the weight of a text's shingles, and of those that another of ``texts`` has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows, reps = binaries(rb.column("text")), rb.column("rep").to_numpy()
            for a, b in slices(rows, 1 << 20):
                h, owner = shingles(rows[a:b])
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
                weight = np.diff(np.concatenate([first, [len(h)]]))
                yield pa.RecordBatch.from_arrays([pa.array(reps[a:b][owner[first]]), pa.array(h[first].view(np.int64)), pa.array(weight)], names=["rep", "h", "w"])

    rows = texts.mapInArrow(run, "rep long, h long, w long")
    several = rows.groupBy("h").agg(F.count("*").alias("n"), F.sum("w").alias("_")).where("n > 1 AND _ > 0").select("h", F.lit(1).alias("also"))
    return rows.join(several, "h", "left").groupBy("rep").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("also").isNotNull(), F.col("w")).otherwise(0)).alias("common"))


def _forest(i: np.ndarray, j: np.ndarray, share: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of candidate pairs the likeliest that join different classes, none that earlier ones have joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for e in np.argsort(-share, kind="stable"):
        x, y = find(classes[i[e]]), find(classes[j[e]])
        if x != y:
            root[x] = y
            out.append(e)
    return np.array(out, int)


def _cell_pairs(members: DataFrame, forest: bool) -> DataFrame:
    """Pairs between classes within cells that may reach the similarity, each from the first band it shares.

    members: _b (bucket), rep, cls, bands, sig, _n (members of the bucket), total, common (see ``_weights``). Two texts
    have no more in common than either has with any other, which excludes most pairs of a cloud that is held together
    by text all its members share, without a look at the pairs.
    """
    blocks = F.ceil(F.col("_n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), blocks)
    dealt = members.withColumns({"_blocks": blocks, "_i": own}).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    cells = dealt.withColumn("_cell", F.xxhash64("_b", F.least("_i", "_j"), F.greatest("_i", "_j"))).withColumn("_diagonal", F.col("_i") == F.col("_j")).withColumn("_alone", F.col("_blocks") == 1)
    parts = cells.select("_cell", "_b", "_i", "rep", "cls", "bands", "sig", "total", "common").repartition("_cell").sortWithinPartitions("_cell", "_i", "rep")
    least = SIMILARITY - MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_groups(batches, ["_cell"]):
            cls, block, rep, bucket, total, common = (t.column(c).to_numpy() for c in ("cls", "_i", "rep", "_b", "total", "common"))
            sigs = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, K)
            bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], t.num_rows]):
                n, two = e - s, block[s] != block[e - 1]
                i, j = [], []
                for x in range(s, e - 1):
                    ys = np.arange(x + 1, e)
                    ok = cls[ys] != cls[x]
                    if two:  # pairs within a block belong to its own cell
                        ok &= block[ys] != block[x]
                    ok &= 9 * np.minimum(common[x], common[ys]) >= 4 * (total[x] + total[ys])  # similarity of 0.8 needs that
                    ys = ys[ok]
                    if len(ys):
                        shared = bands[ys] == bands[x]
                        ys = ys[shared.any(1) & (bands[x][shared.argmax(1)] == bucket[x])]
                    i.append(np.full(len(ys), x))
                    j.append(ys)
                if not n or not i:
                    continue
                i, j = np.concatenate(i), np.concatenate(j)
                share = np.array([(sigs[x] == sigs[y]).mean() for x, y in zip(i, j)])
                likely = share >= least
                i, j, share = i[likely], j[likely], share[likely]
                if forest and len(i):
                    keep = _forest(i, j, share, cls)
                    i, j = i[keep], j[keep]
                a.append(rep[i])
                b.append(rep[j])
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return parts.mapInArrow(run, "a long, b long").distinct()


def _classes(signed: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2, cls: the class (smallest row of its representatives) of each distinct text that has words."""
    one = F.min(F.struct("_row", "d"))
    reps = written(
        signed.where(F.size("bands") > 0).groupBy("h1", "h2").agg(one.alias("one"), F.first("bands").alias("bands"))
        .select("h1", "h2", F.col("one._row").alias("rep"), F.col("one.d").alias("d"), "bands"),
        "near-reps",
    )
    banded = reps.select("rep", F.explode("bands").alias("_b"))
    bucket = Window.partitionBy("_b")  # one shuffle: most buckets hold one text, so their aggregate would be as large as the rows
    members = written(banded.withColumns({"pivot": F.min("rep").over(bucket), "_n": F.count("*").over(bucket)}).where("_n > 1"), "near-buckets")
    wanted = reps.select("rep", "h1", "h2", "d").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = written(texts_of(by_content(docs), written(wanted, "near-wanted"), "rep"), "near-texts")
    links = written(_verified(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), texts), "near-links")
    roots = components(links)
    sketches = None
    for forest in (True, False):
        labelled = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("_b", "_n", "rep", F.coalesce("root", "rep").alias("cls"))
        meeting = labelled.groupBy("_b").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("_b")
        open_ = written(labelled.join(meeting, "_b"), "near-meeting")
        looked = texts.join(open_.select("rep").distinct(), "rep", "left_semi")
        if sketches is None:  # the second time's are among the first's: merging classes opens no bucket
            sketches = written(_sketched(looked), "near-sketches")
        cells = open_.join(sketches, "rep").join(_weights(looked), "rep")
        pairs = written(_cell_pairs(cells, forest), "near-pairs")
        if pairs.isEmpty():
            break
        more = written(_verified(pairs, texts), "near-links")
        if not more.isEmpty():
            links = links.unionAll(more)
            roots = components(links)
    return reps.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("cls"))


def _membership(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """_row, doc_id, cls of each row of ``docs``, its classes' first row and size, and the signed rows."""
    signed = written(_signed(docs), "near-signed")
    classes = _classes(signed, docs)
    rows = signed.select("_row", "doc_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    member = written(rows.select("_row", "doc_id", F.coalesce("cls", "_row").alias("cls")), "near-members")
    first = member.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "_row")).alias("first"), F.count("*").alias("class_size"))
    return member, written(first, "near-classes"), signed  # a table of its own: the join with a hot class can then be split


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the class's smallest id), class_size, kept (the class's first row) for each row."""
    member, first, _ = _membership(docs)
    return member.join(first, "cls").select("doc_id", "class_id", "class_size", (F.col("first._row") == F.col("_row")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first row of each class, with all its columns; of rows that agree in id and text any."""
    _, first, signed = _membership(docs)
    worded = signed.where(F.size("bands") > 0)
    kept = worded.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select("h1", "h2", "d")
    alike = worded.groupBy("h1", "h2", "d").agg(F.count("*").alias("n"))
    k1, k2, kd, kn = (free_name(docs, f"_near_{c}") for c in ("h1", "h2", "d", "n"))
    kept = written(kept.join(alike, ["h1", "h2", "d"]).select(F.col("h1").alias(k1), F.col("h2").alias(k2), F.col("d").alias(kd), F.col("n").alias(kn)), "near-kept")
    # a text without words is a class of its own
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = {k1: F.xxhash64("text"), k2: F.xxhash64(F.lit(1), "text"), kd: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))}
    keyed, names = docs.where(words).withColumns(own), [F.col(f"`{c}`") for c in docs.columns]
    out = docs.where(~words).unionAll(keyed.join(kept.where(F.col(kn) == 1), [k1, k2, kd], "left_semi").select(*names))
    several = kept.where(F.col(kn) > 1)
    if several.isEmpty():
        return out
    repeated = keyed.join(several, [k1, k2, kd], "left_semi").groupBy(k1, k2, kd).agg(*[F.first(c).alias(n) for c, n in zip(names, docs.columns)])
    return out.unionAll(repeated.select(*names))
