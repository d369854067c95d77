"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window of text that resembles toxic
text is shorter under the toxic dictionary than under the ordinary one. Both dictionaries share a part trained on
ordinary windows, so that common text costs the same under both; what differs is a head of fragments (words and word
beginnings, by how many distinct contexts each class has them in) that set toxic text apart, against an equally long
head of ordinary text. Each window ends with a fixed piece of the shared part, so that no block is stored raw and
lengths compare.

A text is cut into windows as a whole. The distribution of its windows' length differences goes through calibrated
thresholds, a logistic function fitted on the training texts and weighted to the labels' class shares.

Labels are learnt from a bounded sample: at most ``PER_CLASS`` texts of each class, none with crc32(doc_id) mod 4
equal to 2. Only the text enters a score.

Defined results: a null text counts as empty and gets the empty text's score, a number like any other; without
a toxic and an ordinary example that has words every score is the share of toxic labels (0 without labels); where no
fragment sets toxic text apart the dictionaries are alike and only the number of windows tells texts apart; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored (``score``) or kept (``reject``).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import UINT, held_out, labelled_sample, mix, slices

#: Sample bound; words a window; bytes of the shared part and of the heads; least score of a fragment.
PER_CLASS, WINDOW, SHARED, HEAD, LEAST = 2000, 2, 1024, 600, 8.0
THRESHOLD = 0.3
#: Above this score a pipeline stage rejects a text.
REJECT = 0.4
_ANCHOR = 40


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


def windows(words: Sequence[bytes]) -> list[bytes]:
    """Windows of ``WINDOW`` words that cover all words; the last may be shorter."""
    return [b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def _fragments(texts: Sequence[str]) -> tuple[Counter, int]:
    """How many distinct contexts (a word and its neighbours) each word and word beginning has."""
    flat, counts = [], []
    spelled: dict[bytes, int] = {}
    for t in texts:
        ws = words_of(t)
        counts.append(len(ws))
        flat.append(np.fromiter((spelled.setdefault(w, len(spelled) + 1) for w in ws), np.int64, len(ws)))
    codes = np.concatenate([np.zeros(0, np.int64), *flat])
    ends = np.cumsum(np.array(counts, np.int64))
    before, after = np.concatenate([[0], codes[:-1]])[: len(codes)], np.concatenate([codes[1:], [0]])[: len(codes)]
    if len(codes):
        before[(ends - counts)[np.array(counts) > 0]] = 0
        after[ends[np.array(counts) > 0] - 1] = 0
    seen = mix(mix(mix(before.astype(UINT)) ^ codes.astype(UINT)) ^ after.astype(UINT))
    _, first = np.unique(seen, return_index=True)
    times = np.bincount(codes[first], minlength=len(spelled) + 1)
    count: Counter = Counter()
    for w, k in zip(spelled, times[1:].tolist()):
        count[b" " + w + b" "] += k
        u = w.decode(errors="ignore")
        for i in range(3, min(9, len(u))):
            count[b" " + u[:i].encode()] += k
    return count, len(first)


def distinctive(own: tuple[Counter, int], other: tuple[Counter, int], size: int = HEAD) -> bytes:
    """Fragments that ``own`` has oftener than ``other`` by standard deviations, the strongest last."""
    (a, n), (b, m) = own, other
    scored = []
    for f, k in a.items():
        if k >= 5:
            p = (k + b.get(f, 0)) / (n + m)
            scored.append(((k - n * p) / math.sqrt(max(n * p * (1 - p), 1e-9)), f))
    scored.sort(key=lambda x: (-x[0], x[1]))
    least = max(LEAST, 0.3 * scored[0][0]) if scored else LEAST
    picked: list[bytes] = []
    used = 0
    for s, f in scored:
        if s < least or used + len(f) > size:
            break
        if not any(f in p for p in picked):
            picked.append(f)
            used += len(f)
    return b"".join(picked[::-1])


class Compressors:
    """Lengths of windows under the two dictionaries."""

    def __init__(self, shared: bytes, toxic: bytes, ordinary: bytes):
        self.parts = shared, toxic, ordinary
        self._anchor = b" " + shared[-_ANCHOR:]
        self._own = [self._compressor(shared + head) for head in (ordinary, toxic)]
        self._known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        params = zstd.ZstdCompressionParameters(
            window_log=12, chain_log=11, hash_log=11, search_log=3, min_match=4, target_length=16,
            strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        dictionary = zstd.ZstdCompressionDict(content, zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)

    def differences(self, wins: Sequence[bytes]) -> np.ndarray:
        """Ordinary length less toxic length of each window."""
        known, (ordinary, toxic) = self._known, (c.compress for c in self._own)
        if len(known) > 200_000:
            known.clear()
        out = np.empty(len(wins), np.float64)
        for i, w in enumerate(wins):
            d = known.get(w)
            if d is None:
                text = b" " + w + self._anchor
                d = known[w] = len(ordinary(text)) - len(toxic(text))
            out[i] = d
        return out


def features(d: np.ndarray) -> list[float]:
    """What a text's length differences look like; the number of windows, as the largest of many is larger."""
    n = len(d)
    if not n:
        return [0.0] * 7
    top = np.sort(d if n <= 8 else np.partition(d, n - 8)[-8:])
    return [min(top[-1], 12.0), top[-3:].mean(), top.mean(), 10 * np.count_nonzero(d >= 3) / n, 10 * np.count_nonzero(d >= 5) / n, d.mean(), math.log1p(n)]


def expanded(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x**2, np.log1p(np.maximum(x, 0))])


class Model:
    def __init__(self, parts: tuple[bytes, bytes, bytes] | None, share: float, mean=None, scale=None, weights=None):
        self.parts, self.share, self.mean, self.scale, self.weights = parts, share, mean, scale, weights
        self._compressors: Compressors | None = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def table(self, texts: Sequence[str]) -> np.ndarray:
        if self._compressors is None:
            self._compressors = Compressors(*self.parts)
        wins = [windows(words_of(t)) for t in texts]
        d = self._compressors.differences([w for ws in wins for w in ws])
        ends = np.cumsum([len(w) for w in wins])
        return np.array([features(d[e - len(w) : e]) for w, e in zip(wins, ends)]).reshape(len(texts), 7)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = np.hstack([(expanded(self.table(texts)) - self.mean) / self.scale, np.ones((len(texts), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _common(ordinary: Sequence[str], total: int) -> tuple[bytes, bytes]:
    """The shared part, trained on ordinary windows, and as much again as a head is long; plain text if that is too little."""
    # samples of four windows each, evenly from all texts: the dictionary trainer wants some length
    step, samples = max(1, total // 40_000), []
    for t in ordinary:
        wins = windows(words_of(t))
        samples += [b" ".join(wins[i : i + 4]) for i in range(0, len(wins) - 3, 4 * step)]
    try:
        trained = zstd.train_dictionary(SHARED + HEAD + 1024, samples).as_bytes()
    except zstd.ZstdError:  # too few samples
        trained = b" ".join(w for t in ordinary for w in words_of(t))[-SHARED - HEAD - 1024 :]
    return trained[-SHARED:], trained[-SHARED - HEAD : -SHARED]


def train(sample: Sequence[tuple[int, str, int]], n_toxic: int, n_ordinary: int) -> Model:
    """Fits dictionaries and thresholds on (id, text, label); the counts are of all labels that may be learnt from."""
    share = n_toxic / max(1, n_toxic + n_ordinary)
    toxic, ordinary = [t for _, t, y in sample if y], [t for _, t, y in sample if not y]
    total = sum(len(words_of(t)) for t in ordinary) // WINDOW
    if not toxic or not total:
        return Model(None, share)
    shared, filler = _common(ordinary, total)
    a, b = _fragments(toxic), _fragments(ordinary)
    head, own = distinctive(a, b), distinctive(b, a)
    del a, b
    own = own[len(own) - min(len(own), len(head)) :]
    both = filler + own
    model = Model((shared, head, both[max(0, len(both) - len(head)) :]), share)
    y = np.array([s[2] for s in sample], float)
    x = expanded(np.vstack([model.table([s[1] for s in sample[i : i + 200]]) for i in range(0, len(sample), 200)]))
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    weight = np.where(y == 1, n_toxic / max(1, len(toxic)), n_ordinary / max(1, len(ordinary)))
    weight *= len(y) / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    model.weights = w
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in usable.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    return train(labelled_sample(docs, labels, label, per_class), counts.get(1, 0), counts.get(0, 0))


def _score_text_batches(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rb in batches:
        texts = [t or "" for t in rb.column("text").to_pylist()]
        for a, b in slices(texts):
            yield rb.slice(a, b - a), model.scores(texts[a:b])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, s in _score_text_batches(model, batches):
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, s in _score_text_batches(model, batches):
            yield rb.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
