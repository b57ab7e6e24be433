"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

Each word has a word input (a learned vector of its hash bucket) and a character input (the mean of the
learned vectors of its character n-grams' buckets), so that forms of a word not met in training are
known by their parts.  A run of letters of over `LONGEST` bytes, such as a sentence in a script without
spaces, is read as pieces of `PIECE` bytes that overlap, each a word.  Both have one more dimension that isn't trained: the log odds of the bucket among
toxic and other documents of the sample, shrunk towards zero where it is rare.  The network reads
windows of `LENGTH` words that overlap (one every `STRIDE` words), forward and backward; attention pools
the states of a window, and a document's score is its highest window's, calibrated on the sample.

Training is in numpy, on a bounded sample (see :mod:`.labelled`); as only documents are labelled, each
toxic one is represented by its currently highest window.  Scoring reads every window of every document.

Defined cases: null, empty and wordless texts are scored as a window of no words.  Without labels of both
kinds every score is the share of toxic labels (0 without any).  Texts of any length are read whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, groups_of, mapped, mix, residue, utf8
from .labelled import SAMPLE_ROWS, labelled_rows
from .minhash import band_keys, shingles, signature
from .words import Words, in_pieces, sum_by, words

LENGTH, STRIDE = 24, 16
LONGEST, PIECE, EVERY = 48, 48, 32
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
LEARNED = 7
STATE = 8
ATTENTION = 8
TOXIC = 0.5

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_windows int"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Vocabulary:
    """The distinct words of some texts: buckets of the words and of their n-grams."""

    word: np.ndarray
    gram: np.ndarray
    bounds: np.ndarray  # the n-grams of word i are bounds[i] to bounds[i + 1]


def words_of(texts: list[bytes]) -> Words:
    return in_pieces(words(texts), LONGEST, PIECE, EVERY)


def vocabulary(found: Words) -> tuple[Vocabulary, np.ndarray]:
    """The distinct words, and the number of each word's in it."""
    _, first, number = np.unique(found.hash, return_index=True, return_inverse=True)
    start, length = found.start[first], found.length[first]
    # each word as < w o r d >, one after another
    size = length + 2
    edge = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(edge, size)
    code = found.code[np.minimum(np.repeat(start, size) + np.maximum(place - 1, 0), len(found.code) - 1)].astype(np.uint64)
    code[edge] = 256
    code[edge + size - 1] = 257
    owner, grams = [], []
    for n in GRAMS:
        at = np.flatnonzero(place + n <= np.repeat(size, size))
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + code[at + k]
        owner.append((np.searchsorted(edge, at, "right") - 1).astype(np.int32))
        grams.append(mix(h) & np.uint64(BUCKETS - 1))
    owner, grams = np.concatenate(owner), np.concatenate(grams).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(first) + 1))
    return Vocabulary((found.hash[first] & np.uint64(BUCKETS - 1)).astype(np.int64), grams[order], bounds), number


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each window, and where each text's windows begin; every text has one at least."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - (LENGTH - STRIDE)) // STRIDE))
    first = np.append(0, np.cumsum(count))
    text = np.repeat(np.arange(len(n)), count)
    start = bounds[text] + (np.arange(first[-1]) - first[text]) * STRIDE
    return start, np.minimum(LENGTH, bounds[text + 1] - start), first


class Network:
    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)

        def matrix(a: int, b: int) -> np.ndarray:
            return (random.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        self.word = (0.1 * random.standard_normal((BUCKETS, LEARNED + 1))).astype(np.float32)
        self.gram = (0.1 * random.standard_normal((BUCKETS, LEARNED + 1))).astype(np.float32)
        self.word[:, -1] = self.gram[:, -1] = 0
        inputs = 2 * LEARNED + 3
        self.p = {"b": np.zeros(1, dtype=np.float32), "out": matrix(2 * STATE, 1), "att": matrix(2 * STATE, ATTENTION), "v": matrix(ATTENTION, 1)}
        for way in "fb":
            self.p |= {f"w{way}": matrix(inputs, 3 * STATE), f"c{way}": np.zeros(3 * STATE, dtype=np.float32), f"u{way}": matrix(STATE, 3 * STATE)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, voc: Vocabulary) -> np.ndarray:
        """The input of each word: its own vector, the mean of its n-grams', their highest and lowest log odds."""
        n = np.maximum(np.diff(voc.bounds), 1)[:, None].astype(np.float32)
        g = self.gram[voc.gram]
        own = self.word[voc.word]
        if not len(own):
            return np.zeros((0, 2 * LEARNED + 3), dtype=np.float32)
        odds = g[:, -1]
        best, worst = np.maximum.reduceat(odds, voc.bounds[:-1]), np.minimum.reduceat(odds, voc.bounds[:-1])
        return np.concatenate([own, sum_by(g[:, :-1], voc.bounds) / n, best[:, None], worst[:, None]], axis=1)

    def read(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows given as inputs (window, place, dimension) already projected for both ways."""
        n, steps = mask.shape
        states, memory = np.empty((n, steps, 2 * STATE), dtype=np.float32), {}
        full = bool(mask.all())
        for way, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            u, h, kept = self.p[f"u{way}"], np.zeros((n, STATE), dtype=np.float32), {}
            side = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            columns = slice(0, 3 * STATE) if way == "f" else slice(3 * STATE, 6 * STATE)
            for t in order:
                g, hu = x[:, t, columns], h @ u
                gates = sigmoid(g[:, : 2 * STATE] + hu[:, : 2 * STATE])
                z, r = gates[:, :STATE], gates[:, STATE:]
                new = np.tanh(g[:, 2 * STATE :] + r * hu[:, 2 * STATE :])
                after = new + z * (h - new)
                if not full:
                    after = np.where(mask[:, t, None], after, h)
                if keep:
                    kept[t] = (h, z, r, new, hu[:, 2 * STATE :])
                h = after
                states[:, t, side] = h
            memory[way] = kept
        a = np.tanh(states @ self.p["att"])
        e = np.where(mask, (a @ self.p["v"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * np.maximum(mask, ~mask.any(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nts->ns", alpha, states)
        logit = (pooled @ self.p["out"])[:, 0] + self.p["b"]
        return (logit, (states, memory, a, alpha, pooled)) if keep else logit

    def back(self, x, mask, kept, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the projected inputs, for the gradient `d` of the logits."""
        states, memory, a, alpha, pooled = kept
        p, steps = self.p, mask.shape[1]
        out = {"b": d.sum(keepdims=True), "out": pooled.T @ d[:, None]}
        dp = d[:, None] * p["out"].T
        ds = alpha[:, :, None] * dp[:, None, :]
        da = np.einsum("ns,nts->nt", dp, states)
        de = alpha * (da - (alpha * da).sum(axis=1, keepdims=True)) * mask
        dt = de[:, :, None] * p["v"][:, 0] * (1 - a * a)
        out["v"] = np.einsum("nt,nta->a", de, a)[:, None]
        out["att"] = np.einsum("nts,nta->sa", states, dt)
        ds = ds + dt @ p["att"].T
        dx = np.zeros_like(x)
        for way, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            side = slice(0, STATE) if way == "f" else slice(STATE, 2 * STATE)
            base = 0 if way == "f" else 3 * STATE
            u, du, dh = p[f"u{way}"], np.zeros_like(p[f"u{way}"]), np.zeros((len(d), STATE), dtype=np.float32)
            for t in order:
                h, z, r, new, hn = memory[way][t]
                dh = dh + ds[:, t, side]
                m = mask[:, t, None]
                now = dh * m
                dnew = now * (1 - z) * (1 - new * new)
                dz = now * (h - new) * z * (1 - z)
                dr = dnew * hn * r * (1 - r)
                dg = np.concatenate([dz, dr, dnew], axis=1)
                dx[:, t, base : base + 3 * STATE] = dg
                dhu = np.concatenate([dz, dr, dnew * r], axis=1)
                du += h.T @ dhu
                dh = dh * ~m + now * z + dhu @ u.T
            out[f"u{way}"] = du
        return out, dx

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ np.concatenate([self.p["wf"], self.p["wb"]], axis=1) + np.concatenate([self.p["cf"], self.p["cb"]])

    def score_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's highest logit, its number of windows, and all windows' logits."""
        found = words_of(texts)
        voc, number = vocabulary(found)
        start, size, first = windows(found.bounds)
        projected = np.concatenate([self.project(self.inputs(voc)), np.zeros((1, 6 * STATE), dtype=np.float32)])
        logits = np.empty(len(start), dtype=np.float32)
        padded = np.append(number, np.full(LENGTH, len(projected) - 1))
        for whole in (True, False):  # windows of full length need no mask
            rows = np.flatnonzero((size == LENGTH) == whole)
            for i in range(0, len(rows), 1024):
                part = rows[i : i + 1024]
                place = start[part, None] + np.arange(LENGTH)
                mask = np.arange(LENGTH) < size[part, None]
                logits[part] = self.read(projected[np.where(mask, padded[np.minimum(place, len(padded) - 1)], len(projected) - 1)], mask)
        best = np.maximum.reduceat(logits, first[:-1]) if len(texts) else logits
        return best, np.diff(first), logits

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def log_odds(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each bucket: log odds of being in a toxic document, shrunk where few have it; `count` and `total`
    are the other and the toxic documents that have the bucket, and all."""
    total = np.maximum(total, 1)
    odds = np.log((count[1] + 0.5) / (total[1] + 1)) - np.log((count[0] + 0.5) / (total[0] + 1))
    seen = count[0] + count[1]
    return (np.clip(odds, -4, 4) * seen / (seen + 3.0) * (seen > 1)).astype(np.float32)


def bucket_counts(texts: list[bytes], y: np.ndarray, half: np.ndarray) -> np.ndarray:
    """[words or n-grams, half, label, bucket]: how many texts have a bucket."""
    out = np.zeros((2, 2, 2, BUCKETS), dtype=np.int64)
    for a, b in groups_of(texts, 300_000):
        found = words_of(texts[a:b])
        voc, number = vocabulary(found)
        if not len(number):
            continue
        owner = np.repeat(np.arange(b - a), np.diff(found.bounds))
        distinct = np.unique(owner * len(voc.word) + number)  # (text, word)
        text, word = distinct // len(voc.word), distinct % len(voc.word)
        n = np.diff(voc.bounds)[word]
        spread = np.repeat(voc.bounds[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for kind, (bucket, of) in enumerate(((voc.word[word], text), (voc.gram[spread], np.repeat(text, n)))):
            pairs = np.unique(of * BUCKETS + bucket)
            of, bucket = pairs // BUCKETS + a, pairs % BUCKETS
            for h in (0, 1):
                for k in (0, 1):
                    out[kind, h, k] += np.bincount(bucket[(half[of] == h) & (y[of] == k)], minlength=BUCKETS)
    return out


def gathered(texts: list[bytes]) -> Words:
    """The words of all texts, read in groups to bound memory."""
    parts, offset = [], 0
    for a, b in groups_of(texts, 300_000):
        f = words_of(texts[a:b])
        parts.append((f.code, f.start + offset, f.length, f.hash, np.diff(f.bounds)))
        offset += len(f.code)
    code, start, length, h, n = (np.concatenate(c) for c in zip(*parts))
    return Words(code, start, length, h, np.append(0, np.cumsum(n)), np.empty(0, dtype=np.uint8))


def apart(sample: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """One text of each family of copies with one label: what the copies share would look like a mark of the label."""
    met, out = set(), []
    for text, y in sample:
        found = shingles(text)
        keys = {(y, k) for k in band_keys(signature(found))[:12].tolist()} if len(found) else set()
        if met.isdisjoint(keys):
            out.append((text, y))
        met |= keys
    return out


def fit(sample: list[tuple[bytes, int]], rounds: int = 4, steps: int = 80, seed: int = 6) -> Network | float:
    """A network trained on texts and labels; the share of toxic ones where there is nothing to tell apart.

    While the network learns from one half of the texts, the log odds are those of the other half: words
    that a document alone has then tell nothing of it.  In the end they are those of all.
    """
    sample = apart(sorted(dict(sorted(sample)).items()))
    y = np.array([k for _, k in sample], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    random = np.random.default_rng(seed)
    order = random.permutation(len(sample))
    texts, y, net = [sample[i][0] for i in order], y[order], Network()
    found = gathered(texts)
    if not len(found.hash):
        return float(y.mean())
    voc, number = vocabulary(found)
    half = np.zeros(len(y), dtype=np.int64)
    for k in (0, 1):
        half[np.flatnonzero(y == k)[1::2]] = 1
    tables, counts = (net.word, net.gram), bucket_counts(texts, y, half)
    totals = np.array([[((half == h) & (y == k)).sum() for k in (0, 1)] for h in (0, 1)])
    odds = [[log_odds(counts[t, 1 - k], totals[1 - k]) for t in (0, 1)] for k in (0, 1)]

    def use(k: int) -> None:
        for table, o in zip(tables, odds[k]):
            table[:, -1] = o

    def scored() -> tuple[np.ndarray, np.ndarray]:
        """Logits of documents and windows, each with the other half's log odds."""
        both = []
        for k in (0, 1):
            use(k)
            parts = [net.score_texts(texts[a:b]) for a, b in groups_of(texts, 500_000)]
            both.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])))
        return np.where(half == 0, both[0][0], both[1][0]), np.where(half[window_owner] == 0, both[0][1], both[1][1])

    start, size, first = windows(found.bounds)
    window_owner = np.repeat(np.arange(len(texts)), np.diff(first))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    seen = {"word": np.full(BUCKETS, 1e-2, dtype=np.float32), "gram": np.full(BUCKETS, 1e-2, dtype=np.float32)}
    # the first choice of windows: where the log odds of a word and of its parts are highest
    guess = np.zeros(len(start), dtype=np.float32)
    for k in (0, 1):
        use(k)
        x = net.inputs(voc)
        hint = (x[:, LEARNED] + x[:, -2])[number]
        for i in np.flatnonzero(half[window_owner] == k):
            guess[i] = hint[start[i] : start[i] + size[i]].max(initial=0)
    step = 0
    for turn in range(rounds):
        if turn:
            guess = scored()[1]
        top = np.array([a + int(np.argmax(guess[a:b])) for a, b in zip(first, first[1:])])
        for _ in range(steps):
            step += 1
            use(k := step % 2)
            positive, negative = (np.flatnonzero((y == v) & ((half == k) | (np.bincount(y, minlength=2)[v] < 2))) for v in (1, 0))
            pos = top[random.choice(positive, 64)]
            neg = random.choice(negative, 112)
            neg = np.where(random.random(112) < 0.5, top[neg], first[neg] + (random.random(112) * (first[neg + 1] - first[neg])).astype(np.int64))
            rows, target = np.concatenate([pos, neg]), np.repeat(np.array([1, 0], dtype=np.float32), [64, 112])
            _train(net, voc, number, start[rows], size[rows], target, moments, seen, step)
    net.scale, net.shift = calibrated(scored()[0].astype(np.float64), y)
    for t, table in enumerate(tables):
        table[:, -1] = log_odds(counts[t].sum(axis=0), totals.sum(axis=0))
    return net


def _train(net: Network, voc: Vocabulary, number, start, size, target, moments, seen, step: int, rate: float = 0.01) -> None:
    mask = np.arange(LENGTH) < size[:, None]
    place = np.minimum(start[:, None] + np.arange(LENGTH), max(len(number) - 1, 0))
    own, local = np.unique(number[place] if len(number) else np.zeros_like(place), return_inverse=True)
    n = np.diff(voc.bounds)[own]
    grams = voc.gram[np.repeat(voc.bounds[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    part = Vocabulary(voc.word[own], grams, np.append(0, np.cumsum(n)))
    inputs = net.inputs(part)
    at = local.reshape(place.shape)
    x = net.project(inputs)[at] * mask[:, :, None]
    logit, kept = net.read(x, mask, keep=True)
    d = ((sigmoid(logit) - target) / len(target)).astype(np.float32)
    grads, dx = net.back(x, mask, kept, d)
    dx *= mask[:, :, None]
    flat = np.zeros((len(own), dx.shape[2]), dtype=np.float32)
    np.add.at(flat, at.ravel(), dx.reshape(-1, dx.shape[2]))
    for way, side in (("f", slice(0, 3 * STATE)), ("b", slice(3 * STATE, 6 * STATE))):
        grads[f"w{way}"], grads[f"c{way}"] = inputs.T @ flat[:, side], flat[:, side].sum(axis=0)
    di = flat @ np.concatenate([net.p["wf"], net.p["wb"]], axis=1).T
    for k, g in grads.items():
        m, v = moments[k]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    per = (di[:, LEARNED + 1 : 2 * LEARNED + 1] / np.maximum(n, 1)[:, None]).repeat(n, axis=0)
    for table, rows, g in ((net.word, part.word, di[:, :LEARNED]), (net.gram, grams, per)):
        name = "word" if table is net.word else "gram"
        np.add.at(seen[name], rows, (g * g).mean(axis=1))
        np.add.at(table[:, :-1], rows, -0.05 * g / np.sqrt(seen[name][rows])[:, None])


def calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve over the documents' logits, by Newton's method with a weak prior."""
    w, x = np.array([1.0, 0.0]), np.stack([logit, np.ones_like(logit)], axis=1)
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.5, 0.05])
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - y) + np.array([0.5, 0.05]) * (w - np.array([1.0, 0.0]))), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def learnable():
    """Which rows labels may be learned from: all but the held-out fold."""
    return residue("doc_id", 5) != 0


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | float:
    """Fitted in a task on the bounded sample: the driver holds only the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [pair for batch in batches for pair in zip(utf8(batch.column("text")), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])
        pa.default_memory_pool().release_unused()

    sample = labelled_rows(docs, labels, "toxic", learnable(), rows).coalesce(1)
    told = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(told.model) if told else fit([])


def _scores(model: Network | float, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in groups_of(texts, 400_000):
        if isinstance(model, float):
            yield np.full(b - a, model), np.zeros(b - a, dtype=np.int64)
        else:
            best, n, _ = model.score_texts(texts[a:b])
            yield model.probability(best), n


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: held out or not, score, prediction, number of windows."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(_scores(model.value, utf8(batch.column("text"))))
        score, n = (np.concatenate([p[i] for p in parts] or [np.empty(0)]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= TOXIC).astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "held_out", "score", "predicted", "n_windows"])

    ids = F.col("doc_id").cast("long")
    return mapped(docs.select(ids.alias("doc_id"), F.coalesce(residue(ids, 5) == 0, F.lit(False)).alias("held_out"), "text"), run, SCHEMA)


def remove_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, with all their columns, whose score is below a half."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    return chosen(docs, lambda texts: np.concatenate([s for s, _ in _scores(model.value, texts)] or [np.empty(0)]) < TOXIC)
