"""Quality scores from random-indexing word vectors.

Every hash bucket of words has a fixed sparse index vector of a few +1 and -1 (Kanerva et al., 2000).  A
word's vector is the sum of the index vectors of the words around each of its occurrences in the whole
corpus: each task sums those of its own rows, and one aggregate adds the tasks' sums, so what is gathered
has a fixed size (`BUCKETS` times `SIZE`), whatever the corpus.  A document is the mean and the spread of
its words' vectors and of their index vectors.  A network of two layers, trained in numpy on a bounded
sample of labelled rows, gives a logit; a temperature, fitted on a part of the sample that training
doesn't see, turns it into a probability.

Words here are runs of letters, of digits or of other signs; a run of capitals is another word than the
same letters in lower case, as the writing tells much about quality.

Defined cases: null and empty texts have a zero vector and get the score it gives.  Without labels of
both kinds every score is the share of good labels (0.5 without any).  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, mapped, mix, residue, utf8
from .labelled import SAMPLE_ROWS, labelled_sample
from .words import Words, sum_by, words

BITS = 14
BUCKETS = 1 << BITS
SIZE = 32
SIGNS = 4
WINDOW = 2
HIDDEN = 24
GOOD = 0.5

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: The sums of one bucket as plain columns, which aggregate without arrays.
COLUMNS = [f"v{i}" for i in range(SIZE)]


def index_vectors() -> np.ndarray:
    """The index vector of each bucket: half of `SIGNS` places +1, half -1."""
    out = np.zeros((BUCKETS, SIZE), dtype=np.int8)
    rows = np.arange(BUCKETS)
    with np.errstate(over="ignore"):
        for k in range(SIGNS):
            place = mix(rows.astype(np.uint64) * np.uint64(SIGNS) + np.uint64(k + 1)) % np.uint64(SIZE)
            out[rows, place.astype(np.int64)] += 1 if k % 2 else -1
    return out


def buckets(found: Words) -> np.ndarray:
    return (found.hash >> np.uint64(64 - BITS)).astype(np.int64)


def context_sums(texts: list[bytes], index: np.ndarray, into: np.ndarray) -> None:
    """Adds to each bucket's row the index vectors of the words within `WINDOW` of its occurrences."""
    found = words(texts, signs=True)
    b = buckets(found)
    if not len(b):
        return
    text = np.repeat(np.arange(len(texts)), np.diff(found.bounds))
    around = np.zeros((len(b), SIZE), dtype=np.int8)
    for k in range(1, WINDOW + 1):
        same = (text[k:] == text[:-k])[:, None]
        around[:-k] += index[b[k:]] * same
        around[k:] += index[b[:-k]] * same
    order = np.argsort(b, kind="stable")
    own = b[order]
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    into[own[heads]] += np.add.reduceat(around[order], heads, axis=0, dtype=np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all buckets, over all documents, of length one (zero where a bucket has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, SIZE), dtype=np.int64)
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in groups_of(texts, 500_000):
                context_sums(texts[a:b], index, total)
        met = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(total[met, i]) for i in range(SIZE))], names=["bucket", *COLUMNS])

    parts = docs.select("text").mapInArrow(run, ", ".join(f"{c} long" for c in ("bucket", *COLUMNS)))
    rows = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in COLUMNS)).toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, SIZE), dtype=np.float32)
    v = rows[COLUMNS].to_numpy(dtype=np.float64)
    out[rows["bucket"].to_numpy()] = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)
    return out


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Of each text: mean and spread over its words of word vectors and index vectors, and how alike
    neighbouring words are in either."""
    found = words(texts, signs=True)
    b = buckets(found)
    n = np.maximum(np.diff(found.bounds), 1)[:, None]
    last = found.bounds[1:][np.diff(found.bounds) > 0] - 1
    out = []
    for table in (vectors, index_vectors().astype(np.float32) / np.float32(SIGNS**0.5)):
        v = table[b]
        mean = sum_by(v, found.bounds) / n
        alike = np.zeros((len(v), 1), dtype=np.float32)
        alike[:-1, 0] = np.einsum("ij,ij->i", v[:-1], v[1:])
        alike[last] = 0  # no neighbour in the next text
        out += [mean, np.sqrt(np.maximum(sum_by(v * v, found.bounds) / n - mean * mean, 0)), sum_by(alike, found.bounds) / n]
    return np.concatenate(out, axis=1)


class Scorer:
    """Word vectors, and the two layers over pooled vectors."""

    def __init__(self, vectors: np.ndarray, sample: list[tuple[bytes, int]], steps: int = 1500, seed: int = 3):
        self.vectors = vectors
        sample = sorted(dict(sorted(sample)).items())
        y = np.array([k for _, k in sample], dtype=np.float64)
        self.share = float(y.mean()) if len(y) else 0.5
        self.trained = len(y) > 1 and 0 < self.share < 1
        if not self.trained:
            return
        texts = [t for t, _ in sample]
        x = np.concatenate([pooled(texts[a:b], vectors) for a, b in groups_of(texts, 500_000)])
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.spread
        random = np.random.default_rng(seed)
        order = random.permutation(len(y))
        apart = order[: len(y) // 5] if len(y) >= 50 else order[:0]  # for the temperature alone
        inner = order[len(apart) :]
        kinds = [inner[y[inner] == k] for k in (0, 1)]
        if not len(kinds[0]) or not len(kinds[1]):
            inner, kinds = order, [order[y[order] == k] for k in (0, 1)]
        p = [random.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), random.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in p]
        for step in range(1, steps + 1):
            rows = np.concatenate([random.choice(k, 48) for k in kinds])
            xs, ys = x[rows], y[rows]
            h = np.tanh(xs @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3]) - ys) / len(rows)
            dh = d[:, None] * p[2] * (1 - h * h)
            grads = [xs.T @ dh + 1e-3 * p[0], dh.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum(keepdims=True)]
            for i, g in enumerate(grads):
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[i] = p[i] - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.layers = p
        self.temperature = 1.0
        if len(apart):
            logit = self._logit(x[apart])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(x @ a + b) @ c + d

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.share)
        parts = [(pooled(texts[a:b], self.vectors) - self.mean) / self.spread for a, b in groups_of(texts, 500_000)]
        return _sigmoid(self._logit(np.concatenate(parts)) / self.temperature) if parts else np.empty(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def learnable():
    """Which rows labels may be learned from: all but the held-out fold."""
    return residue("doc_id", 3) != 1


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer:
    return Scorer(word_vectors(docs), labelled_sample(docs, labels, "quality", learnable(), rows))


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: held out or not, score, prediction."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.value.score(utf8(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ids = F.col("doc_id").cast("long")
    return mapped(docs.select(ids.alias("doc_id"), F.coalesce(residue(ids, 3) == 1, F.lit(False)).alias("held_out"), "text"), run, SCHEMA)
