"""Quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Bytes become learned vectors; learned filters
run over each chunk and are max-pooled. A text is the maximum of its chunks' pooled activations beside their mean, and
one logistic unit combines these into a probability. Training is plain numpy, on the driver, by Adam.

Labels are learnt from a bounded sample: at most ``PER_CLASS`` texts of each class, none with crc32(doc_id) mod 4
equal to 2, all chunks of each. Only the text enters a score.

Defined results: a null text counts as empty; an empty text is one chunk of padding and gets a score like any other;
without examples of both classes every score is the share of label 1 (0 without labels); repeated rows each get a
row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import binaries, held_out, labelled_sample, slices

#: Sample bound; bytes of a chunk and of two chunks' overlap; bytes of a filter, its step, vectors' size, filters.
PER_CLASS = 500
CHUNK, OVERLAP = 512, 64
WIDTH, STEP, DIM, FILTERS = 12, 4, 6, 24
THRESHOLD = 0.7
EPOCHS = 14
_PLACES = (CHUNK - WIDTH) // STEP + 1


def chunks(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts, padded with zero bytes, and each text's number of chunks."""
    stride = CHUNK - OVERLAP
    counts = np.array([max(1, -(-max(0, len(t) - OVERLAP) // stride)) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        flat = np.frombuffer(t, np.uint8)
        for k in range(n):
            piece = flat[k * stride : k * stride + CHUNK]
            out[at + k, : len(piece)] = piece
        at += n
    return out, counts


def _columns(vectors: np.ndarray) -> np.ndarray:
    """The filters' input at each place: a view of (chunks, places, WIDTH * DIM)."""
    n = vectors.shape[0]
    v = vectors.reshape(n, CHUNK * DIM)
    s = v.strides
    return np.lib.stride_tricks.as_strided(v, (n, _PLACES, WIDTH * DIM), (s[0], STEP * DIM * s[1], s[1]))


class Net:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.filters = r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)

    NAMES = ("embed", "filters", "bias", "out", "shift")

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest activation in each chunk, and where."""
        a = (_columns(self.embed[x]).reshape(-1, WIDTH * DIM) @ self.filters).reshape(len(x), _PLACES, FILTERS)
        where = a.argmax(1)
        return np.maximum(np.take_along_axis(a, where[:, None], 1)[:, 0] + self.bias, 0), where

    def best(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty((len(x), FILTERS), np.float32)
        for i in range(0, len(x), block):
            a = _columns(self.embed[x[i : i + block]]).reshape(-1, WIDTH * DIM) @ self.filters
            out[i : i + block] = np.maximum(a.reshape(-1, _PLACES, FILTERS).max(1) + self.bias, 0)
        return out

    def logits(self, texts: Sequence[bytes]) -> np.ndarray:
        x, counts = chunks(texts)
        p = self.best(x)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        top = np.maximum.reduceat(p, starts) if len(texts) else p
        mean = np.add.reduceat(p, starts) / counts[:, None] if len(texts) else p
        return np.hstack([top, mean]) @ self.out + self.shift[0]

    def gradients(self, texts: Sequence[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x, counts = chunks(texts)
        p, where = self.pooled(x)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        owner = np.repeat(np.arange(len(texts)), counts)
        top = np.maximum.reduceat(p, starts)
        h = np.hstack([top, np.add.reduceat(p, starts) / counts[:, None]])
        z = h @ self.out + self.shift[0]
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = float(-(weight * (y * np.log(s + 1e-9) + (1 - y) * np.log(1 - s + 1e-9))).mean())
        dz = (weight * (s - y) / len(y)).astype(np.float32)
        g = {"out": h.T @ dz, "shift": np.array([dz.sum()], np.float32)}
        dh = dz[:, None] * self.out[None]
        first = (p == top[owner]) & (p > 0)  # ties share; they are rare
        dp = dh[owner, :FILTERS] * first + dh[owner, FILTERS:] / counts[owner, None]
        dp = dp * (p > 0)
        g["bias"] = dp.sum(0)
        df = np.zeros_like(self.filters)
        de = np.zeros_like(self.embed)
        vectors = self.embed[x]
        rows = np.arange(len(x))
        for k in range(FILTERS):
            at = where[:, k][:, None] * STEP + np.arange(WIDTH)[None]
            seen = x[rows[:, None], at]
            df[:, k] = (vectors[rows[:, None], at].reshape(len(x), -1) * dp[:, k : k + 1]).sum(0)
            np.add.at(de, seen.ravel(), (dp[:, k, None, None] * self.filters[:, k].reshape(1, WIDTH, DIM)).reshape(-1, DIM))
        de[0] = 0
        g["filters"], g["embed"] = df, de
        return loss, g


class Model:
    def __init__(self, share: float, net: Net | None = None, scale: float = 1.0, shift: float = 0.0):
        self.share, self.net, self.scale, self.shift = share, net, scale, shift

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        z = self.net.logits(texts).astype(np.float64) * self.scale + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(sample: Sequence[tuple[int, str, int]], n_good: int, n_bad: int, epochs: int = EPOCHS) -> Model:
    """Fits a network on (id, text, label); the counts are of all labels that may be learnt from."""
    share = n_good / max(1, n_good + n_bad)
    texts = [t.encode() for _, t, _ in sample]
    y = np.array([s[2] for s in sample], np.float32)
    if not len(y) or y.min() == y.max():
        return Model(share)
    net, r = Net(), np.random.default_rng(2)
    m = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}
    v = {n: np.zeros_like(getattr(net, n)) for n in Net.NAMES}
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    t, total = 0, epochs * -(-len(y) // 24)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), 24):
            pick = order[i : i + 24]
            _, g = net.gradients([texts[j] for j in pick], y[pick], balance[pick])
            t += 1
            rate = 0.01 * (1 - t / (total + 1))
            for n in Net.NAMES:
                m[n] += 0.1 * (g[n] - m[n])
                v[n] += 0.01 * (g[n] ** 2 - v[n])
                step = rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.99**t)) + 1e-7)
                setattr(net, n, (getattr(net, n) - step).astype(np.float32))
    # the trained classes are balanced; the labels are not
    shift = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    return Model(share, net, 1.0, shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in usable.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    return train(labelled_sample(docs, labels, label, per_class), counts.get(1, 0), counts.get(0, 0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [t or b"" for t in binaries(rb.column("text"))]
            for a, b in slices(texts, 1 << 20):
                s = model.scores(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc_id")[a:b], rb.column("held_out")[a:b], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
