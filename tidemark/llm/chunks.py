"""Substring deduplication by content-defined chunks.

A text is read as units: words between white space, single characters of scripts without spaces, and pieces
of words of over 32 bytes, split where a hash of the last bytes says so, so that equal text has equal units.
A gear rolling hash runs over the units; a chunk ends where it is no larger than at the `REACH` units on
either side, so the text around a place alone decides, and an insertion moves no other boundary.  Chunks
have 9 units on average.  Each is known by a 128-bit digest, and the digests decide: a chunk that a document with a
smaller doc_id has, or the same document before, is a repeat.

Neighbouring repeats are one stretch.  A passage's first and last chunk reach beyond it, so a stretch is extended from its
ends, unit by unit, as far as its document goes on like the one it is a copy of: the boundaries of a passage are the
same wherever it stands but in its first seven and last four units, so this is a chunk and those at most, and up to
`CONTEXT` units are compared.  A stretch is cut if it has `RUN` bytes or more than `WORDS` units then, so stock phrases
are left alone.  A text that another document has before, of any length, is cut whole, by the digest of all of it.

Of each digest the smallest document is a partial aggregate; what has that digest is then joined with it, where
adaptive execution splits a digest that a large part of the documents has.  Texts meet their repeats in one join, whose
result gives the ends of stretches and the chunks they are copies of, and then the cuts.  White space between
units doesn't count.

Defined cases: null texts stay null, empty ones empty.  A null doc_id takes part like the largest id.
Rows with one doc_id count as one document: a chunk of one is no repeat in the other; each has its own cuts.  Within one
document the first of equal chunks stays, and those less than `APART` units after it.  The text is cut at the ends of units only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, mapped, mix, salts, stored, utf8

RUN = 112
WORDS = 50
CONTEXT = 32
#: Units that lie between a chunk and an equal one of the same text, at least: a word said a few times over is no repeat.
APART = 16
#: Units that the gear hash reads, and units on either side that a chunk's end is compared with.
GEARS, REACH = 4, 4
LONG = 32
WHOLE = -1  # the place of a whole text
NO_ID = 2**63 - 1

_GEAR = salts(2, 21) | np.uint64(1)
_POWER = salts(64, 22) | np.uint64(1)
_BASE = int(salts(3, 23)[2]) | 1
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


@dataclass
class Units:
    start: np.ndarray  # in the joined texts
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # the units of text i are bounds[i] to bounds[i + 1]
    offset: np.ndarray  # where each text starts


def units(texts: list[bytes]) -> Units:
    """The units of each text."""
    code = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    offset = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    space, at = _SPACE[code], np.arange(len(code))
    starts = ~space & (np.append(True, space[:-1]) | ((code >= 0xE0) & (code != 0xE2)))  # 0xE2: mostly quotes and dashes
    since = at - np.maximum.accumulate(np.where(space, at, -1))
    far = np.flatnonzero((since > LONG) & ((code & 0xC0) != 0x80))
    if len(far):
        h = np.zeros(len(far), dtype=np.uint64)
        for k in range(1, 9):
            h = h * np.uint64(_BASE) + code[far - k].astype(np.uint64)
        starts[far[(mix(h) & np.uint64(15)) == 0]] = True
    start = np.flatnonzero(starts)
    if not len(start):
        return Units(start, start, np.empty(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64), offset)
    inside = np.flatnonzero(~space)
    first = np.searchsorted(inside, start)
    length = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, length)
    value = (code[inside].astype(np.uint64) + np.uint64(1)) * _POWER[place & 63]
    h = mix(np.add.reduceat(mix(value + place.astype(np.uint64)), first) + length.astype(np.uint64))
    return Units(start, start + length, h, np.searchsorted(start, offset), offset)


@dataclass
class Chunks:
    start: np.ndarray  # the first unit of each chunk
    end: np.ndarray  # one past its last
    high: np.ndarray  # its digest
    low: np.ndarray
    bounds: np.ndarray  # the chunks of text i are bounds[i] to bounds[i + 1]


def chunks_of(u: Units) -> Chunks:
    """The chunks of each text.  The gear hash adds each unit's value to that of the units before it, shifted by 16
    bits for each unit in between, so four units count."""
    n = len(u.hash)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Chunks(none, none, none, none, np.zeros(len(u.bounds), dtype=np.int64))
    text = np.repeat(np.arange(len(u.bounds) - 1), np.diff(u.bounds))
    own = mix(u.hash * _GEAR[0])
    gear = own.copy()
    for k in range(1, min(GEARS, n)):
        gear[k:] += np.where(text[k:] == text[:-k], own[:-k] << np.uint64(16 * k), np.uint64(0))
    ends = np.ones(n, dtype=bool)
    for k in range(1, min(REACH + 1, n)):
        other = text[k:] != text[:-k]
        ends[k:] &= other | (gear[k:] <= gear[:-k])
        ends[:-k] &= other | (gear[:-k] <= gear[k:])
    first = np.ones(n, dtype=bool)
    first[1:] = ends[:-1] | (text[1:] != text[:-1])
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, n))
    place = (np.arange(n) - np.repeat(start, length)).astype(np.uint64)
    high, low = (mix(np.add.reduceat(mix(u.hash * g + place), start) + length.astype(np.uint64)).view(np.int64) for g in _GEAR)
    return Chunks(start, start + length, high, low, np.searchsorted(start, u.bounds))


def boundaries(text: bytes) -> list[int]:
    """Where the chunks of a text end; white space belongs to the chunk before it."""
    u = units([text])
    starts = u.start[chunks_of(u).start[1:]].tolist()
    return [*starts, len(text)] if text else []


def digests(text: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    """Chunk ends and digests of a text; one without units is one chunk without a digest."""
    found = chunks_of(units([text]))
    return boundaries(text), list(zip(found.high.tolist(), found.low.tolist()))


def _each(texts: list[bytes], most: int = 500_000) -> Iterator[tuple[int, Units, Chunks]]:
    """Groups of texts: the number of the first, their units and their chunks."""
    for a, b in groups_of(texts, most):
        u = units(texts[a:b])
        yield a, u, chunks_of(u)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place, high, low): each document's distinct chunks, by their rank in it, and at `WHOLE` its text's
    digest."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids, marks = utf8(batch.column("text")), np.array(batch.column("doc_id"), dtype=np.int64), np.array(batch.column("mark"), dtype=np.int64)
        for a, _, found in _each(texts):
            doc, mark, place, high, low = [], [], [], [], []
            for i, (p, q) in enumerate(zip(found.bounds.tolist(), found.bounds[1:].tolist()), a):
                own, first = np.unique(found.high[p:q], return_index=True)
                whole = np.frombuffer(xxhash.xxh3_128_digest(texts[i]), dtype=np.int64)[: 2 * bool(texts[i])]
                doc.append(np.full(len(own) + len(whole) // 2, ids[i]))
                mark.append(np.full(len(own) + len(whole) // 2, marks[i]))
                place += [np.arange(len(own), dtype=np.int32), np.full(len(whole) // 2, WHOLE, dtype=np.int32)]
                high += [own, whole[:1]]
                low += [found.low[p + first], whole[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (doc, mark, place, high, low)], names=NAMES)

    return mapped(docs.select(F.col("key").alias("doc_id"), "mark", "text"), run, ROWS)


@dataclass
class Stretch:
    """Neighbouring repeated chunks of a text: the first and last unit in it, and where each end was met before: the document
    and the digest, or the unit of the same text."""

    first: int
    last: int
    ends: list[tuple[int, int, int, int]]  # document or -1, high, low, unit or -1


def stretches_of(found: Chunks, i: int, seen: dict[int, int]) -> list[tuple[Stretch, list[int]]]:
    """The stretches of text i with all documents that have a part of each before: chunks that are in `seen` (rank of a chunk in
    the text: the first document that has it), or earlier in the text."""
    p, q = found.bounds[i : i + 2].tolist()
    if p == q:
        return []
    own, head, of = np.unique(found.high[p:q], return_index=True, return_inverse=True)
    source = np.full(len(own), -1)
    if seen:
        source[np.fromiter(seen.keys(), dtype=np.int64)] = list(seen.values())
    far = found.start[p:q] - found.start[p + head[of]] >= APART
    at = np.flatnonzero((source[of] >= 0) | far)
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
        ends = []
        for k, side in ((part[0], found.start), (part[-1], found.end)):
            before = int(source[of[k]])
            ends.append((before, int(found.high[p + k]), int(found.low[p + k]), -1 if before >= 0 else int(side[p + head[of[k]]])))
        told = source[of[part]]
        out.append((Stretch(int(found.start[p + part[0]]), int(found.end[p + part[-1]]), ends), np.unique(told[told >= 0]).tolist()))
    return out


def context(u: Units, i: int, unit: int, back: bool) -> np.ndarray:
    """Marks of the units of text i before a unit, the nearest first, or from it on: 16 bits each, so that of 65,536 ends one
    goes a unit too far."""
    a, b = u.bounds[i : i + 2]
    near = u.hash[max(a, unit - CONTEXT) : unit][::-1] if back else u.hash[unit : min(b, unit + CONTEXT)]
    return (near >> np.uint64(48)).astype(np.uint16)


def alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many marks two contexts have in common from their start."""
    n = min(len(a), len(b))
    return int(np.append(a[:n] == b[:n], False).argmin())


def cuts_of(u: Units, found: Chunks, i: int, seen: dict[int, int], longer: dict[tuple[int, int], int]) -> list[tuple[int, int, list[int]]]:
    """Stretches (start, end, source documents) of text i to cut, in bytes; `longer` has the units that (stretch, end) goes on
    like its source."""
    spans: list[list] = []
    for k, (stretch, sources) in enumerate(stretches_of(found, i, seen)):
        edge = [stretch.first, stretch.last]
        for side, (_, _, _, unit) in enumerate(stretch.ends):
            back = side == 0
            n = longer.get((k, side), 0) if unit < 0 else alike(context(u, i, edge[side], back), context(u, i, unit, back))
            edge[side] += -n if back else n
        if spans and edge[0] <= spans[-1][1]:
            spans[-1][1], spans[-1][2] = max(spans[-1][1], edge[1]), sorted({*spans[-1][2], *sources})
        else:
            spans.append([*edge, sources])
    out = []
    for first, last, sources in spans:
        a, b = u.start[first], u.end[last - 1]
        if b - a >= RUN or last - first > WORDS:
            out.append((int(a - u.offset[i]), int(b - u.offset[i]), sources))
    return out


ENDS = "key long, mark long, stretch int, side int, high long, low long, source long, near binary"


def ends_of(joined: DataFrame) -> DataFrame:
    """The ends of stretches that other documents have, with the units around them: at (stretch, side) of (key, mark) is a copy
    of a chunk of `source`.  Documents that are copies as a whole have none."""

    def one(u: Units, found: Chunks, i: int, key: int, mark: int, seen: dict[int, int]) -> Iterator[tuple]:
        for k, (stretch, _) in enumerate(stretches_of(found, i, {r: f for r, f in seen.items() if f != key})):
            for side, (source, high, low, _) in enumerate(stretch.ends):
                if source >= 0:
                    yield key, mark, k, side, high, low, source, context(u, i, (stretch.first, stretch.last)[side], side == 0).tobytes()

    rows = joined.where(F.exists("seen", lambda x: x["first"] != F.col("key")) & ~F.exists("seen", lambda x: x["place"] == WHOLE))
    return _around(rows, one)


def sources_of(joined: DataFrame) -> DataFrame:
    """The same of all chunks that others copy, `source` being the document itself."""

    def one(u: Units, found: Chunks, i: int, key: int, mark: int, seen: dict[int, int]) -> Iterator[tuple]:
        p, q = found.bounds[i : i + 2].tolist()
        head = np.unique(found.high[p:q], return_index=True)[1]
        for c in (p + head[np.array([r for r, first in seen.items() if first == key], dtype=np.int64)]).tolist():
            for side, at in enumerate((found.start[c], found.end[c])):
                yield key, mark, -1, side, int(found.high[c]), int(found.low[c]), key, context(u, i, int(at), side == 0).tobytes()

    return _around(joined.where(F.exists("seen", lambda x: x["first"] == F.col("key"))), one)


def _around(rows: DataFrame, one: Callable[[Units, Chunks, int, int, int, dict[int, int]], Iterator[tuple]]) -> DataFrame:
    """`one` over the units and chunks of each text of `rows`, all columns of which are read, so that the shuffle of the texts is
    the one the cuts read."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists, keys, marks, texts = batch.column("seen"), batch.column("key").to_pylist(), batch.column("mark").to_pylist(), utf8(batch.column("text"))
        for start, u, found in _each(texts):
            out = []
            for i in range(start, start + len(u.bounds) - 1):
                out += one(u, found, i - start, keys[i], marks[i], {x["place"]: x["first"] for x in lists[i].as_py() if x["place"] != WHOLE})
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, kinds)], names=[f.split()[0] for f in ENDS.split(", ")])

    return mapped(rows, run, ENDS)


def extensions(joined: DataFrame) -> DataFrame:
    """(key, mark, longer): of each document the units by which the ends of its stretches go on like what they are copies of."""
    theirs = sources_of(joined).select("high", "low", "source", "side", F.col("near").alias("theirs"))
    both = ends_of(joined).join(theirs, ["high", "low", "source", "side"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [alike(np.frombuffer(a, dtype=np.uint16), np.frombuffer(b, dtype=np.uint16)) for a, b in zip(batch.column("near").to_pylist(), batch.column("theirs").to_pylist())]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "mark", "stretch", "side")), pa.array(n, pa.int32())], ["key", "mark", "stretch", "side", "n"])

    counted = mapped(both.select("key", "mark", "stretch", "side", "near", "theirs"), run, "key long, mark long, stretch int, side int, n int").where("n > 0")
    counted = counted.groupBy("key", "mark", "stretch", "side").agg(F.max("n").alias("n"))  # rows of one doc_id may each have the chunk
    return counted.groupBy("key", "mark").agg(F.collect_list(F.struct("stretch", "side", "n")).alias("longer"))


NAMES = ["doc_id", "mark", "place", "high", "low"]
ROWS = "doc_id long, mark long, place int, high long, low long"
SCHEMA = "doc_id long, n_cut long, cut_chars long, copied_from array<long>, spans string, text string"


def marked(docs: DataFrame) -> DataFrame:
    """(key, mark, doc_id, text): `key` is the doc_id, the largest where it is null, and `mark` tells rows of one doc_id
    with different texts apart: a hash of the text for those, else 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(NO_ID)))
    mixed = rows.groupBy("key").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("a != b").select("key", F.lit(True).alias("mixed"))
    mixed = stored(mixed, "mixed")
    if mixed.isEmpty():
        return rows.select("key", F.lit(0).cast("long").alias("mark"), "doc_id", "text")
    told = rows.join(mixed, "key", "left")
    return told.select("key", F.when(F.col("mixed"), F.xxhash64("text")).otherwise(0).alias("mark"), "doc_id", "text")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: stretches cut, their characters, the documents that keep them, their places
    (code points of the whole text), and the text that stays."""
    whole = marked(docs)
    rows = chunk_rows(whole)
    first = rows.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    met = rows.join(first, ["high", "low"]).where((F.col("place") != WHOLE) | (F.col("first") < F.col("doc_id")))
    met = met.groupBy(F.col("doc_id").alias("key"), "mark").agg(F.collect_list(F.struct("place", "first")).alias("seen"))
    joined = whole.join(met, ["key", "mark"], "left").select("key", "mark", "doc_id", "text", "seen")  # shuffled once, read twice

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids, keys, null = utf8(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").is_null().to_pylist()
        lists, longer = batch.column("seen"), batch.column("longer")
        for start, u, found in _each(texts):
            out = []
            for i in range(start, start + len(u.bounds) - 1):
                text, seen = texts[i], {s["place"]: s["first"] for s in lists[i].as_py() or () if s["first"] != keys[i]}
                copy = seen.pop(WHOLE, None)
                more = {(x["stretch"], x["side"]): x["n"] for x in longer[i].as_py() or ()}
                cut = cuts_of(u, found, i - start, seen, more) if copy is None else [(0, len(text), [copy])]
                kept = b"".join(text[p:q] for p, q in zip([0, *(c[1] for c in cut)], [*(c[0] for c in cut), len(text)]))
                places = [(len(text[:p].decode()), len(text[p:q].decode())) for p, q, _ in cut]
                out.append((ids[i], len(cut), sum(n for _, n in places), sorted({s for c in cut for s in c[2]}), ",".join(f"{p}:{p + n}" for p, n in places), None if null[i] else kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_cut", "cut_chars", "copied_from", "spans", "text"])

    return mapped(joined.join(extensions(joined), ["key", "mark"], "left").drop("mark"), run, SCHEMA)
