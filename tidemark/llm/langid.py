"""Language identification by hierarchical discrimination.

First the family of the language (Germanic, Romance, ...), then, within the family, one-versus-one linear support
vector machines between its languages; the machines between families are of the same kind.  Each pair of classes
learns only from texts of the two, so close languages are told apart by what differs between them.

Features of a text: hashed counts of its letter sequences of one to `ORDERS` code points inside words (a word's
edges count as letters) and of whole words, over the whole text; damped by the square root and scaled to length one.

The fit reads a bounded sample: at most `SAMPLE_ROWS` labelled texts of each language, of at most `SAMPLE_BYTES` bytes each, drawn by a
hash of the id.  Features are made where the texts are; each pair of classes is a group of its own with at most
`PAIR_ROWS` rows on a side, so fits run side by side, and what reaches the driver is a weight vector for each pair.
Prediction is a map over all whole texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; texts of unknown scripts get the class
whose machines win; one learned language is every text's language, with score 1; without any labelled text all are
`und`; rows that repeat give rows that repeat.  A language that the table of families lacks is a family of its own.
Nothing but the text is an input of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of, mapped, mix, residue, salts, utf8

#: Labelled texts of each language at most, bytes of each at most, and rows of each side of a pair at most.
SAMPLE_ROWS, SAMPLE_BYTES, PAIR_ROWS = 600, 16_000, 1200
#: Features (a power of two), orders of letter sequences, texts and bytes of texts worked on at once.
BITS, ORDERS, BLOCK, GROUP = 13, 3, 256, 1_000_000
#: Weight of the error against the length of the weight vector, and steps of the fit.
COST, STEPS = 8.0, 150
UNKNOWN = "und"

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "indo-iranian": "bn fa gu hi ku mr ne pa ps sd si tg ur",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg mi ms sm su tl to",
    "bantu": "ln lg ny rn rw sn st sw tn ts xh zu",
}

_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_SALTS = salts(ORDERS + 1, 1301)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def family(lang: str) -> str:
    """The family of a language, by its code up to a dash or underscore."""
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), f"of {lang}")


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower-case form where that is one code point, itself where it has no case, 0 where it is
    neither a letter nor a mark; and whether it is a letter."""
    low, letter = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
    for c in range(0x40000):  # no letter is beyond
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            small = chr(c).lower()
            low[c], letter[c] = ord(small) if len(small) == 1 else c, kind == "L"
    return low, letter


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of the texts and whether they have a letter, block by block, in order."""
    for start in range(0, len(texts), BLOCK):
        block = texts[start : start + BLOCK]
        for a, b in groups_of(block, GROUP):
            yield _vectors([t.decode("utf-8", "replace") for t in block[a:b]])


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lower, letter = _letters()
    points = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    edges = np.cumsum([len(t) + 1 for t in texts])
    seen = np.zeros(len(texts), dtype=bool)
    seen[np.searchsorted(edges, np.flatnonzero(letter[points]), side="right")] = True
    c = lower[points]
    inside = c > 0
    keep = inside | np.append(False, inside[:-1])  # letters, and one sign after each word: the edge of that word and the next
    text = np.searchsorted(edges, np.flatnonzero(keep), side="right")
    c = c[keep]
    gone, code = c == 0, mix(c.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(texts) << BITS)
    shift, n, h = np.uint64(64 - BITS), len(code), np.zeros(len(code), dtype=np.uint64)
    for order in range(1, min(ORDERS, n) + 1):
        m = n - order + 1
        h = h[:m] * _FACTOR + code[order - 1 :]
        whole = (text[:m] == text[order - 1 :]) & ~(gone[:m] & gone[order - 1 :])
        for k in range(1, order - 1):
            whole &= ~gone[k : m + k]  # an edge may only be first or last
        out += np.bincount((mix(h[whole] ^ _SALTS[order - 1]) >> shift).astype(np.int64) + (text[:m][whole] << BITS), minlength=len(out))
    ends = np.flatnonzero(gone)
    if len(ends):
        place = np.arange(n) - np.maximum.accumulate(np.where(gone, np.arange(n), -1))
        sums = np.cumsum(code * (mix(place.astype(np.uint64)) | np.uint64(1)))[ends]
        words = np.diff(sums, prepend=np.uint64(0))
        out += np.bincount((mix(words ^ _SALTS[ORDERS]) >> shift).astype(np.int64) + (text[ends] << BITS), minlength=len(out))
    x = np.sqrt(out.reshape(len(texts), -1))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12), seen


def machine(x: np.ndarray, y: np.ndarray, cost: float = COST, steps: int = STEPS) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge) for y of -1 and 1, sides weighted alike, by
    accelerated gradient steps; the last two values turn a margin into a log odds (fitted on the same rows)."""
    x = np.column_stack([x, np.ones(len(x), dtype=x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = (cost * share * len(x)).astype(x.dtype)
    top = 2 * float(weight.max()) * _largest(x) + 1
    w = v = np.zeros(x.shape[1], dtype=x.dtype)
    for t in range(steps):
        new = v - (v - 2 * (weight * y * np.maximum(1 - y * (x @ v), 0)) @ x) / top
        v, w = new + t / (t + 3) * (new - w), new
    margin, line = (x @ w).astype(float), np.array([1.0, 0.0])
    design = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(30):  # from margin to log odds, held back towards a slope of one
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        slope = design.T @ ((p - (y > 0)) * share) + 0.05 * (line - [1.0, 0.0])
        curve = (design * (share * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        line = line - np.linalg.solve(curve, slope)
    return np.append(w, [max(line[0], 1e-3), line[1]]).astype(float)


def _largest(x: np.ndarray) -> float:
    """About the largest eigenvalue of x'x, by power steps, with a margin."""
    v, size = np.ones(x.shape[1], dtype=x.dtype), 0.0
    for _ in range(20):
        v = (x @ v) @ x
        size = float(np.linalg.norm(v))
        v /= max(size, 1e-30)
    return 1.1 * size


#: Machines between families, then between the languages of each family: (first, second, weights) by level.
Machines = list[tuple[str, str, str, np.ndarray]]


def fitted(docs: DataFrame, learn: Column) -> tuple[list[str], Machines]:
    """The languages learned from, sorted, and a machine for each pair of families and of languages of one family."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)).between(1, SAMPLE_BYTES)).withColumn("drawn", F.xxhash64("doc_id", F.lit(1301)))
    counts = rows.groupBy("lang").count()
    langs = sorted(r.lang for r in counts.select("lang").collect())
    families = _by_family(langs)
    pairs = [("", a, b) for a, b in combinations(families, 2)] + [(f, a, b) for f, of in families.items() for a, b in combinations(of, 2)]
    if not pairs:
        return langs, []
    # all but about four times as many as are wanted go by a threshold on the hash, where the rows are
    below = counts.select("lang", (F.least(F.lit(1.0), 4.0 * SAMPLE_ROWS / F.col("count")) * 2.0**64 - 2.0**63).alias("below"))
    few = rows.join(F.broadcast(below), "lang").where(F.col("drawn").cast("double") <= F.col("below")).dropDuplicates(["lang", "doc_id", "text"])  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id", "text"))
    sample = few.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).select("lang", "doc_id", "place", "text")

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [row.tobytes() if has else None for x, seen in features(utf8(batch.column(3))) for row, has in zip(x.astype(np.float32), seen)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], ["lang", "doc_id", "place", "vector"])

    sides = []
    for level, a, b in pairs:
        for side, one in ((1, a), (-1, b)):
            of = families[one] if level == "" else [one]
            sides += [(level, a, b, lang, side, max(1, PAIR_ROWS // len(of))) for lang in of]
    wanted = docs.sparkSession.createDataFrame(sides, "level string, a string, b string, lang string, side int, most int")  # of languages only
    taught = mapped(sample, vectors, "lang string, doc_id long, place int, vector binary").where(F.col("vector").isNotNull())
    groups = taught.join(F.broadcast(wanted), "lang").where(F.col("place") <= F.col("most")).drop("most")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "lang"])
        x = np.frombuffer(b"".join(rows["vector"]), dtype=np.float32).reshape(len(rows), -1)
        return pd.DataFrame([{"level": key[0], "a": key[1], "b": key[2], "weights": machine(x, rows["side"].to_numpy(dtype=np.float32)).tobytes()}])

    found = groups.groupBy("level", "a", "b").applyInPandas(fit, "level string, a string, b string, weights binary").collect()
    return langs, [(r.level, r.a, r.b, np.frombuffer(r.weights)) for r in sorted(found, key=lambda r: (r.level, r.a, r.b))]


def _by_family(langs: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for lang in langs:
        out.setdefault(family(lang), []).append(lang)
    return out


def decided(x: np.ndarray, names: list[str], pairs: list[tuple[str, str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The place of the class that wins most pairs (of equal ones the larger mean chance, then the first), and that
    class's mean chance against the others."""
    at, votes, chance = {n: i for i, n in enumerate(names)}, np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for a, b, w in pairs:
        p = 1 / (1 + np.exp(-np.clip(w[-2] * (x @ w[:-3] + w[-3]) + w[-1], -30, 30)))
        votes[:, at[a]] += p >= 0.5
        votes[:, at[b]] += p < 0.5
        chance[:, at[a]] += p
        chance[:, at[b]] += 1 - p
    best = (votes + chance / (len(names) + 1)).argmax(axis=1)
    others = max(len(names) - 1, 1)
    return best, (chance[np.arange(len(x)), best] / others if pairs else np.ones(len(x)))


SCHEMA = "doc_id long, lang_pred string, family string, score double"


def predicted(docs: DataFrame, langs: list[str], machines: Machines) -> DataFrame:
    """(doc_id, lang_pred, family, score) of every row: family first, then its language; the score is the product of
    the two chances."""
    families = _by_family(langs)
    names = list(families)
    levels: dict[str, list[tuple[str, str, np.ndarray]]] = {}
    for level, a, b, w in machines:
        levels.setdefault(level, []).append((a, b, w))
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # a vector for each pair

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, kin, score = [], [], []
        for x, seen in features(utf8(batch.column(1))):
            own, of, p = np.full(len(x), UNKNOWN, dtype=object), np.full(len(x), None, dtype=object), np.zeros(len(x))
            rows = np.flatnonzero(seen) if names else []
            if len(rows):
                first, sure = decided(x[rows], names, shared.value.get("", []))
                for k in np.unique(first):
                    mine = first == k
                    second, within = decided(x[rows[mine]], families[names[k]], shared.value.get(names[k], []))
                    own[rows[mine]], of[rows[mine]], p[rows[mine]] = np.array(families[names[k]], dtype=object)[second], names[k], sure[mine] * within
            lang += own.tolist()
            kin += of.tolist()
            score.append(np.clip(p, 0, 1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(kin, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["doc_id", "lang_pred", "family", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(residue(doc_id, 4) == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, family) of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    found = predicted(docs, *fitted(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "family")
