"""Benchmark decontamination by suffix arrays.

The training texts are taken in shards (a bounded number of bytes of one task's rows).  For each shard a suffix array is made:
the starts of all word suffixes, sorted by their first words.  Every window of every benchmark suffix is
binary-searched in it, which gives all places of the shard that begin with it; the words there are hit.  Each place that
begins a hit is then searched in the benchmark's own suffix array, to any depth: its longest verbatim match is with one
of its two neighbours there.  So a place has one longest match however many items hold it, and places and items are
never paired.  Which items a window occurs in is a set, numbered once; a text's items are those of its sets.

A suffix that holds a word no benchmark item has within its window can't match, so the shard's array leaves such
suffixes out.  The benchmark's words are counted first.  Up to `BLOCK_WORDS` it goes to all tasks at once and no
rows are shuffled; a larger one is taken in blocks of that size, each in a pass of its own whose findings are
written to shared storage before the next is sent.  A block is arrays of some 60 bytes a word, and each different word once.

Defined cases: null or empty texts and texts without words have n_words 0 and no hit.  An item with fewer words than the
window is one window; an item without words matches nothing.  Repeated documents are each judged; repeated items
each count.  An empty benchmark contaminates nothing.  Further columns of either table are not read.  A longest match
of under `window` words counts only where it is a whole item.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import forget, mix, small_batches, stored, utf8

WINDOW = 10
BLOCK_WORDS = 1_000_000
SHARD_BYTES = 8_000_000

#: Word bytes are digits, letters (A-Z as a-z) and all bytes of characters beyond ASCII; the others part words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
#: An odd number, so that it has an inverse modulo 2^64, for hashes of any stretch from sums over what comes before.
_BASE = 0x9E3779B97F4A7C15
#: Places looked up at once, and sets of items a task remembers the digest of.
_AT_ONCE, _REMEMBERED = 200_000, 10_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def suffix_array(x: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a sequence, sorted, by ranks over twice as many elements each round.  No suffix is the
    beginning of another where the last element occurs once."""
    rank, k = np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.full(len(x), -1, dtype=np.int64)
        second[:-k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.append(0, np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])))
        rank[order] = new
        if not len(x) or new[-1] == len(x) - 1 or k >= len(x):
            return order
        k *= 2


class Hashed:
    """A sequence of numbers any two stretches of which can be compared at once, with others of another sequence."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        power = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, dtype=np.uint64)))
        self.sums = np.append(np.uint64(0), np.cumsum(mix(x.astype(np.int64).view(np.uint64)) * power[:n]))
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, pow(_BASE, -1, 2**64), dtype=np.uint64)))

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def common_lengths(a: Hashed, p: np.ndarray, b: Hashed, t: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many elements the stretches of `a` at `p` and of `b` at `t` have in common from their start, `most` at most."""
    length = np.zeros(len(p), dtype=np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step:
        longer = length + step
        fits = np.flatnonzero(longer <= most)
        same = a.of(p[fits], longer[fits]) == b.of(t[fits], longer[fits])
        length[fits[same]] = longer[fits[same]]
        step >>= 1
    return length


class Block:
    """Some benchmark items: their words as numbers one after another, the suffixes sorted, and the windows as sorted keys with
    the sets of items that hold them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, sorted_suffixes: bool = True):
        self.window, self.ids = window, {}
        self.names = [name for name, _ in items]
        lengths = np.array([len(w) for _, w in items], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1  # a place of its own after each item, with a number that occurs once
        self.x = np.empty(int((lengths + 1).sum()), dtype=np.int64)
        self.first = ends - lengths
        for k, (_, words) in enumerate(items):
            self.x[self.first[k] : ends[k]] = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
        self.x[ends] = -1 - np.arange(len(items))
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), lengths + 1)
        self.room = ends[self.item] - np.arange(len(self.x)) if len(items) else np.empty(0, dtype=np.int64)
        own = np.minimum(lengths, window)[self.item] if len(items) else self.room
        found = []
        for m in sorted(set(np.minimum(lengths, window).tolist()) - {0}):
            at = np.flatnonzero((own == m) & (self.room >= m))
            keys = _keys(self.x[at[:, None] + np.arange(m)])
            order = np.lexsort((self.item[at], keys))
            keys, item = keys[order], self.item[at[order]]
            new = np.append(True, keys[1:] != keys[:-1])
            fresh = new | np.append(True, item[1:] != item[:-1])  # a window that an item holds twice counts once
            found.append((m, keys[new], item[fresh], np.flatnonzero(new[fresh])))
        self._number(found)
        if sorted_suffixes and len(items):
            order = suffix_array(self.x)
            self.sorted = order[self.x[order] > 0].astype(np.int32)
            self.hashed = Hashed(self.x)

    def _number(self, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Numbers the sets of items that windows (length, keys, items, where each window's begin) are in: equal sets have
        one number."""
        items = np.concatenate([f[2] for f in found] or [np.empty(0, dtype=np.int64)])
        shift = np.cumsum([0, *(len(f[2]) for f in found)])
        start = np.concatenate([f[3] + s for f, s in zip(found, shift)] or [np.empty(0, dtype=np.int64)])
        size = np.diff(np.append(start, len(items)))
        total = np.add.reduceat(mix(items.astype(np.uint64) + np.uint64(1)), start) if len(start) else np.empty(0, dtype=np.uint64)
        _, one, number = np.unique(mix(total ^ mix(size.astype(np.uint64))), return_index=True, return_inverse=True)
        self.edge = np.append(0, np.cumsum(size[one]))
        self.members = items[np.repeat(start[one] - self.edge[:-1], size[one]) + np.arange(self.edge[-1])].astype(np.int32)
        cut = np.cumsum([0, *(len(f[1]) for f in found)])
        self.by_length = {m: (keys, number[cut[i] : cut[i + 1]].astype(np.int32)) for i, (m, keys, *_) in enumerate(found)}

    def items_of(self, sets: list[int]) -> np.ndarray:
        """The items of some sets, once each."""
        return np.unique(np.concatenate([self.members[self.edge[k] : self.edge[k + 1]] for k in sets]))

    def search(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """For each window length: the places of a shard's words that begin with a window, the length, the window's number."""
        room = _room(ids)
        for m, (keys, number) in self.by_length.items():
            suffixes = np.flatnonzero(room >= m)
            if not len(suffixes):
                continue
            own = _keys(ids[suffixes[:, None] + np.arange(m)])
            order = np.argsort(own, kind="stable")  # the shard's suffix array, to a depth of m words
            own, suffixes = own[order], suffixes[order]
            low, high = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            n = high - low
            which = np.repeat(np.arange(len(keys)), n)
            yield suffixes[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], m, number[which]

    def longest(self, ids: np.ndarray, hashed: Hashed, room: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of a shard: how many words its longest match with any suffix has, and that suffix."""
        parts = [self._longest(ids, hashed, room, places[i : i + _AT_ONCE]) for i in range(0, len(places), _AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (places, places)

    def _longest(self, ids: np.ndarray, hashed: Hashed, room: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.zeros(len(p), dtype=np.int64), np.full(len(p), len(self.sorted), dtype=np.int64)
        best, where, going = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64), np.arange(len(p))
        while len(going):  # a binary search for all of them; the neighbours of where each ends are among what it met
            middle = (low[going] + high[going]) // 2
            t, q = self.sorted[middle].astype(np.int64), p[going]
            n = common_lengths(hashed, q, self.hashed, t, np.minimum(room[q], self.room[t]))
            better = n > best[going]
            best[going[better]], where[going[better]] = n[better], t[better]
            right = self.x[t + n] < ids[q + n]
            low[going[right]] = middle[right] + 1
            high[going[~right]] = middle[~right]
            going = going[low[going] < high[going]]
        return best, where


def _keys(windows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(windows.astype(">u4")).view(f"S{4 * windows.shape[1]}").ravel()


def _room(ids: np.ndarray) -> np.ndarray:
    """How many words from each place on are known ones."""
    end = np.where(ids == 0, np.arange(len(ids)), len(ids))
    return (np.minimum.accumulate(end[::-1])[::-1] if len(ids) else end) - np.arange(len(ids))


class Shard:
    """The words of some texts as a block numbers them (0: none of its words, or the place after a text), and their hits."""

    def __init__(self, texts: list[list[bytes]], block: Block):
        get = block.ids.get
        self.block, self.ids = block, np.fromiter((get(w, 0) for words in texts for w in (*words, b"")), dtype=np.int64)
        self.first = np.cumsum([0, *(len(w) + 1 for w in texts)])
        found = [(at, np.full(len(at), m), number) for at, m, number in block.search(self.ids)] or [(np.empty(0, dtype=np.int64),) * 3]
        self.at, self.length, self.set = (np.concatenate(x) for x in zip(*found))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of hit words: text, first word, one past the last."""
        deep = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(deep, self.at, 1)
        np.add.at(deep, self.at + self.length, -1)
        hit = np.cumsum(deep) > 0
        change = np.flatnonzero(np.diff(hit, prepend=False, append=False))
        start, end = change[::2], change[1::2]
        text = self.text_of(start)
        return text, start - self.first[text], end - self.first[text]

    def longest(self, all_places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches: text, word of the text, words, place in the block.  Of each stretch of hit words only the first
        place's, and all places' where that doesn't reach the stretch's end or `all_places` are wanted; whole items
        of under a window as they are."""
        short = self.length < self.block.window
        starts, order = np.unique(self.at[~short]), np.argsort(self.at[short], kind="stable")
        at, n, where = self.at[short][order], self.length[short][order], np.full(int(short.sum()), -1)
        if len(starts):
            text, a, b = self.runs()
            begin, end = a + self.first[text], b + self.first[text]
            run = np.searchsorted(begin, starts, "right") - 1
            hashed, room = Hashed(self.ids), _room(self.ids)
            head = np.append(True, run[1:] != run[:-1])
            n1, t1 = self.block.longest(self.ids, hashed, room, starts[head])
            open_ = np.ones(len(begin), dtype=bool) if all_places else np.zeros(len(begin), dtype=bool)
            open_[run[head]] |= starts[head] + n1 < end[run[head]]
            rest = starts[~head & open_[run]]
            n2, t2 = self.block.longest(self.ids, hashed, room, rest)
            at, n, where = np.concatenate([at, starts[head], rest]), np.concatenate([n, n1, n2]), np.concatenate([where, t1, t2])
        text = self.text_of(at)
        return text, at - self.first[text], n, where

    def items_of(self, text: np.ndarray) -> np.ndarray:
        """The sets that windows of each text are in, once each: (text, set) sorted."""
        return np.unique(np.stack([text, self.set], axis=1), axis=0)


def judged(texts: list[list[bytes]], block: Block, told: dict[tuple[int, ...], tuple[int, str]]) -> list[tuple]:
    """(n_words, n_hit, n_items, items_sha256, contaminated, longest) of each text; `told` remembers the digests of sets."""
    shard = Shard(texts, block)
    hit, long = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    text, a, b = shard.runs()
    np.add.at(hit, text, b - a)
    text, _, n, _ = shard.longest()
    np.maximum.at(long, text, n)
    pairs = shard.items_of(shard.text_of(shard.at)).tolist()
    sets: dict[int, list[int]] = {}
    for i, number in pairs:
        sets.setdefault(i, []).append(number)
    out = []
    for i, words in enumerate(texts):
        key = tuple(sets.get(i, ()))
        if key not in told:
            if len(told) >= _REMEMBERED:
                told.clear()
            items = block.items_of(key) if key else ()
            told[key] = len(items), digest([block.names[k] for k in items])
        out.append((len(words), int(hit[i]), *told[key], bool(hit[i]), int(long[i])))
    return out


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def blocks(benchmark: DataFrame, window: int, block_words: int, sorted_suffixes: bool = True) -> Iterator[Block]:
    """The benchmark in blocks of at most `block_words` words (or one item); the driver holds one at a time."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = words_of((row.text or "").encode())
        if not words:
            continue
        if items and size + len(words) > block_words:
            yield Block(items, window, sorted_suffixes)
            items, size = [], 0
        items.append((row.item_id or "", words))
        size += len(words)
    yield Block(items, window, sorted_suffixes)


def _fits(benchmark: DataFrame, block_words: int) -> bool:
    """Whether the benchmark is one block; spaces and other signs between words are counted generously."""
    most = benchmark.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    if most <= block_words:
        return True
    return (benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0) <= block_words


def sharded(df: DataFrame, fn: Callable[[list[list[bytes]], pa.Table], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """`fn` over shards of about `SHARD_BYTES` of a task's rows: the words of their texts, and the rows."""
    small_batches(df.sparkSession)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= SHARD_BYTES:
                yield from one(held)
                held = []
        if held:
            yield from one(held)

    def one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        yield from fn([words_of(t) for t in utf8(rows.column(at))], rows)

    return df.mapInArrow(run, schema)


def _batch(ids: pa.ChunkedArray, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its words, those inside a match, the items matched, and the longest match's words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    if not _fits(benchmark, block_words):
        return _in_passes(docs, benchmark, window, block_words)
    part = spark.sparkContext.broadcast(next(blocks(benchmark, window, block_words)))
    told: dict[tuple[int, ...], tuple[int, str]] = {}

    def run(shard: list[list[bytes]], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield _batch(rows.column("doc_id"), judged(shard, part.value, told))

    return sharded(docs, run, SCHEMA)


FOUND = "key string, longest long, runs array<struct<a: long, b: long>>, items array<struct<number: long, name: string>>"


def _in_passes(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """A pass over the documents for each block; what a block finds is kept by a digest of the text, then put together."""
    spark, parts = docs.sparkSession, []
    keyed = docs.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    for number, block in enumerate(blocks(benchmark, window, block_words)):
        part = spark.sparkContext.broadcast(block)
        parts.append(stored(sharded(keyed.select("key", "text"), _finder(part, number), FOUND).dropDuplicates(["key"]), "matches"))
        part.destroy()
    found = reduce(DataFrame.union, parts).groupBy("key").agg(F.max("longest").alias("longest"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))

    def run(shard: list[list[bytes]], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        out = []
        for words, n, runs, items in zip(shard, rows.column("longest"), rows.column("runs"), rows.column("items")):
            hit = upto = 0
            for a, b in sorted((r["a"], r["b"]) for r in runs.as_py() or ()):
                hit += max(0, b - max(a, upto))
                upto = max(upto, b)
            names = [x["name"] for x in items.as_py() or ()]
            out.append((len(words), hit, len(names), digest(names), hit > 0, n.as_py() or 0))
        yield _batch(rows.column("doc_id"), out)

    return sharded(keyed.join(found, "key", "left").select("doc_id", "text", "longest", "runs", "items"), run, SCHEMA)


def _finder(part: Broadcast, number: int):
    def run(texts: list[list[bytes]], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, keys = part.value, rows.column("key")
        shard, runs, sets = Shard(texts, part.value), {}, {}
        for i, a, b in zip(*(x.tolist() for x in shard.runs())):
            runs.setdefault(i, []).append({"a": a, "b": b})
        long = np.zeros(len(texts), dtype=np.int64)
        text, _, n, _ = shard.longest()
        np.maximum.at(long, text, n)
        for i, k in shard.items_of(shard.text_of(shard.at)).tolist():
            sets.setdefault(i, []).append(k)
        out = []
        for i, own in sets.items():
            items = block.items_of(own).tolist()
            out.append({"key": keys[i].as_py(), "longest": int(long[i]), "runs": runs[i], "items": [{"number": number * 2**32 + k, "name": block.names[k]} for k in items]})
        place = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        named = pa.list_(pa.struct([("number", pa.int64()), ("name", pa.string())]))
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("longest", pa.int64()), ("runs", place), ("items", named)]))

    return run


MATCHES = "doc_id long, item_id string, doc_word long, item_word long, n_words long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): the verbatim matches of each document that no longer one covers, each
    with one place in the benchmark where it occurs.  A benchmark of several blocks gives those of each block."""
    spark, out = docs.sparkSession, None
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for block in blocks(benchmark, window, block_words):
        rows = sharded(docs, _locator(spark.sparkContext.broadcast(block)), MATCHES)
        out = rows if out is None else out.union(rows)
    return out


def _locator(part: Broadcast):
    def run(texts: list[list[bytes]], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        block, shard = part.value, Shard(texts, part.value)
        text, a, n, t = shard.longest(all_places=True)
        place = {m: dict(zip(_keys(block.x[at[:, None] + np.arange(m)]).tolist(), at.tolist())) for m in block.by_length if m < block.window for at in [np.flatnonzero((block.room == m) & (np.arange(len(block.x)) == block.first[block.item]))]}
        order = np.lexsort((-n, a, text))
        out, upto, last = [], -1, -1
        for i in order.tolist():
            if text[i] != last:
                last, upto = text[i], -1
            if a[i] + n[i] <= upto:
                continue
            upto, own = a[i] + n[i], t[i]
            if own < 0:  # a whole short item
                p = shard.first[text[i]] + a[i]
                own = place[int(n[i])][_keys(shard.ids[None, p : p + n[i]]).tolist()[0]]
            k = block.item[own]
            out.append((rows.column("doc_id")[int(text[i])].as_py(), block.names[k], int(a[i]), int(own - block.first[k]), int(n[i])))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [()] * 5, kinds)], [c.split()[0] for c in MATCHES.split(", ")])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, that have no match with the benchmark."""
    spark, fits, before = docs.sparkSession, _fits(benchmark, block_words), None
    for block in blocks(benchmark, window, block_words, sorted_suffixes=False):
        part = spark.sparkContext.broadcast(block)
        left = sharded(docs, _keeper(part), docs.schema)
        if fits:
            return left
        docs = stored(left, "clean")  # the next block is sent when this one's work is done
        part.destroy()
        if before is not None:
            forget(before)
        before = docs
    return docs


def _keeper(part: Broadcast):
    def run(texts: list[list[bytes]], rows: pa.Table) -> Iterator[pa.RecordBatch]:
        keep, shard = np.ones(len(texts), dtype=bool), Shard(texts, part.value)
        keep[shard.text_of(shard.at)] = False
        yield from rows.filter(pa.array(keep)).to_batches()

    return run
