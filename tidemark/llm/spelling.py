"""Spelling variants: words one edit apart, by Levenshtein automata run over compact tries.

1. Runs of Latin letters are counted where the texts are, then summed; words below the bounds go.
2. The words, in order of length, are cut into shards of bounded size, each built into a trie by the task that holds it.
3. As many shards as `PASS_BYTES` allows are broadcast at a time; every word's automaton of distance one runs through
   each of them depth-first: an exact path, and from each of its nodes the branches with one edit, each followed to its
   end before the path goes on.  Edits are taken in one way only (a deletion or insertion within a run of equal
   letters at its end), so each neighbour is met once.  Shards whose lengths lie more than one off accept nothing.
4. What a word meets in a shard becomes one row (how many, and the best); rows are reduced by word.  Pairs are never
   written out.
5. Roots come by doubling the paths of forms.  A form has at least `RATIO` times the occurrences, so paths have no
   circle and a length that grows with the logarithm of the largest count.

Bounds: a task remembers `REMEMBERED` words before it hands on their counts; a broadcast holds at most `PASS_BYTES` letters of
words (or one shard); a shard holds at most `SHARD_BYTES` (or one word).  The number of passes grows with the number of words.

Defined cases: null and empty texts have no runs; a null doc_id stands as an empty decimal in the hash; rows that repeat count each;
tables without words give no rows.  Other columns of the input are ignored.
"""

from __future__ import annotations

import io
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, small_batches, stored, utf8

#: Words have at least so many code points and occurrences; a form has so many times its word's.
LEAST_POINTS, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many (document, run) pairs loses a code point.
DAMAGED = 199
#: Words a task counts before it hands them on; letters of a shard and of a pass; words of a task of a pass, and those whose
#: automata run together.
REMEMBERED, SHARD_BYTES, PASS_BYTES, TASK_WORDS, BLOCK = 200_000, 1_000_000, 8_000_000, 20_000, 2048

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Letters are a to z and U+00C0 to U+00FF, numbered in order; words are kept in Latin-1, a byte for each.
_SYMBOL = np.array([b - 97 if 97 <= b <= 122 else b - 192 + 26 if b >= 192 else 255 for b in range(256)], dtype=np.uint8)
_LETTER = bytes([*range(97, 123), *range(192, 256)])


def run_counts(doc_id: int | None, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of one text, as (word, occurrences), after the damage that its id draws."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), seed)
        if h % DAMAGED == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_POINTS:
            yield run, n


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): all words of enough code points and occurrences."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                for word, n in run_counts(doc_id, text):
                    counts[word] += n
                if len(counts) > REMEMBERED:
                    yield handed(counts)
                    counts.clear()
        yield handed(counts)

    def handed(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


@dataclass
class Trie:
    """Nodes by depth, the children of a node side by side in the order of their letters; node 0 is the root."""

    label: np.ndarray  # the letter that leads to a node
    children: np.ndarray  # how many a node has
    ends: np.ndarray  # whether a word ends there
    n: np.ndarray  # occurrences of the words, in the order of the nodes they end at
    place: np.ndarray  # the words' places in code point order, in that order too

    @staticmethod
    def of(words: list[bytes], counts: list[int]) -> Trie:
        """Of different words, in any order."""
        order = sorted(range(len(words)), key=words.__getitem__)
        words, counts_of = [words[i] for i in order], np.array([counts[i] for i in order], dtype=np.int64)
        length = np.array([len(w) for w in words])
        start, flat = np.cumsum(length) - length, _SYMBOL[np.frombuffer(b"".join(words), dtype=np.uint8)]
        node, active, nodes, depth = np.zeros(len(words), dtype=np.int64), np.arange(len(words)), 1, 0
        labels, parents = [np.zeros(1, dtype=np.uint8)], []
        while len(active):
            letter, parent = flat[start[active] + depth], node[active]
            new = np.append(True, (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1]))
            node[active] = nodes - 1 + np.cumsum(new)
            nodes, depth = nodes + int(new.sum()), depth + 1
            labels.append(letter[new])
            parents.append(parent[new])
            active = active[length[active] > depth]
        ends = np.zeros(nodes, dtype=bool)
        ends[node] = True
        children = np.bincount(np.concatenate(parents), minlength=nodes) if parents else np.zeros(nodes)
        place = np.argsort(node)
        return Trie(np.concatenate(labels), children.astype(np.uint8), ends, counts_of[place], place.astype(np.int32))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, label=self.label, children=self.children, ends=np.packbits(self.ends), n=self.n, place=self.place)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Trie:
        with np.load(io.BytesIO(data)) as a:
            return Trie(a["label"], a["children"], np.unpackbits(a["ends"], count=len(a["label"])).astype(bool), a["n"], a["place"])


class Reader:
    """A trie made ready to be run through, and the neighbours of words in it."""

    def __init__(self, trie: Trie):
        self.label, self.children, self.n = trie.label, trie.children.astype(np.int64), trie.n
        self.first = np.cumsum(self.children) - self.children + 1
        self.parent = np.append(0, np.repeat(np.arange(len(self.label)), self.children))
        self.word = np.where(trie.ends, np.cumsum(trie.ends) - 1, -1)
        self.end = np.flatnonzero(trie.ends)
        self.order = np.lexsort((trie.place, -trie.n))  # the best first
        self.rank = np.argsort(self.order)
        self.mask = np.zeros((len(self.label), 2), dtype=np.uint64)  # which letters a node's children have
        bit, inner = np.uint64(1) << (self.label & 63).astype(np.uint64), np.flatnonzero(self.children)
        if len(inner):
            for half in (0, 1):
                self.mask[inner, half] = np.bitwise_or.reduceat(np.where(self.label[1:] >> 6 == half, bit[1:], np.uint64(0)), self.first[inner] - 1)

    def child(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each node has a child by the letter, and that child where it has."""
        high, at = letter >> 6, (letter & 63).astype(np.uint64)
        mask = self.mask[node, high]
        has = (mask >> at) & np.uint64(1) == 1
        n, h = node[has], high[has]
        rank = np.bitwise_count(mask[has] & ((np.uint64(1) << at[has]) - np.uint64(1))) + np.where(h == 1, np.bitwise_count(self.mask[n, 0]), 0)
        return has, self.first[n] + rank

    def spelled(self, word: int) -> str:
        out, node = [], int(self.end[word])
        while node:
            out.append(_LETTER[self.label[node]])
            node = int(self.parent[node])
        return bytes(out[::-1]).decode("latin-1")

    def neighbours(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in `words`, word of the trie) of all that differ by one edit, each once, part by part."""
        length = np.array([len(w) for w in words])
        start, flat = np.cumsum(length) - length, np.append(_SYMBOL[np.frombuffer(b"".join(words), dtype=np.uint8)], np.uint8(255))
        w, node, depth = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), 0
        while len(w):  # the exact paths of all words, a letter a turn
            left = length[w] - depth
            here = np.where(left > 0, flat[start[w] + np.minimum(depth, length[w])], 255)
            after = np.where(left > 1, flat[np.minimum(start[w] + depth + 1, len(flat) - 1)], 255)
            gone = (left > 0) & (here != after)
            yield self._followed(w[gone], node[gone], start, length, flat, depth + 1)
            many = self.children[node]
            of = np.repeat(np.arange(len(w)), many)
            kid = np.repeat(self.first[node] - np.cumsum(many) + many, many) + np.arange(len(of))
            other = self.label[kid] != here[of]
            of, kid = of[other], kid[other]
            yield self._followed(w[of], kid, start, length, flat, depth)
            replaced = left[of] > 0
            yield self._followed(w[of[replaced]], kid[replaced], start, length, flat, depth + 1)
            w, node = w[left > 0], node[left > 0]
            has, kid = self.child(node, here[left > 0])
            w, node, depth = w[has], kid, depth + 1

    def _followed(self, w: np.ndarray, node: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words whose edit is made, those whose rest leads to the end of a word."""
        out = []
        while len(w):
            over = length[w] == depth
            if over.any():
                word = self.word[node[over]]
                out.append((w[over][word >= 0], word[word >= 0]))
                w, node = w[~over], node[~over]
            has, node = self.child(node, flat[start[w] + depth])
            w, depth = w[has], depth + 1
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (w, node)

    def met(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: how many neighbours it has here, and the best of them (most occurrences, then first in code
        point order), or -1."""
        count, best = np.zeros(len(words), dtype=np.int64), np.full(len(words), len(self.n))
        for place, word in self.neighbours(words):
            count += np.bincount(place, minlength=len(words))
            np.minimum.at(best, place, self.rank[word])
        return count, np.where(count > 0, np.append(self.order, -1)[best], -1)


def shards(words: DataFrame) -> DataFrame:
    """(shard, shortest, longest, bytes, trie), a row for each shard of the words in order of length."""
    sized = words.withColumn("length", F.char_length("word"))
    total = sized.agg(F.sum("length")).first()[0] or 0
    spread = sized.repartitionByRange(max(1, -(-total // SHARD_BYTES)), "length", "word").sortWithinPartitions("length", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, counts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = word.encode("latin-1")
                if held and size + len(word) > SHARD_BYTES:
                    yield built(part, k, held, counts, size)
                    k, held, counts, size = k + 1, [], [], 0
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield built(part, k, held, counts, size)

    def built(part: int, k: int, held: list[bytes], counts: list[int], size: int) -> pa.RecordBatch:
        row = {"shard": (part << 32) + k, "shortest": len(held[0]), "longest": len(held[-1]), "bytes": size, "trie": Trie.of(held, counts).packed()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("shortest", pa.int64()), ("longest", pa.int64()), ("bytes", pa.int64()), ("trie", pa.binary())]))

    return spread.select("word", "n").mapInArrow(run, "shard long, shortest long, longest long, bytes long, trie binary")


def passes(sizes: list[tuple[int, int]], most: int = PASS_BYTES) -> list[list[int]]:
    """The shards of each pass, from (shard, bytes)."""
    out, held = [], 0
    for shard, size in sorted(sizes):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += size
    return out


MET = "word string, n_near long, form string, form_n long"


def met_in(words: DataFrame, tries: list[tuple[int, int, bytes]]) -> DataFrame:
    """(word, n_near, form, form_n): what each word meets in each of a pass's shards, where it meets any."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [(a, b, Reader(Trie.unpacked(t))) for a, b, t in shared.value]
        for batch in batches:
            known = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for start in range(0, len(known), BLOCK):
                block, found = known[start : start + BLOCK], {name: [] for name in ("word", "n_near", "form", "form_n")}
                for shortest, longest, reader in readers:
                    near = [w for w in block if shortest - 1 <= len(w) <= longest + 1]
                    if not near:
                        continue
                    count, best = reader.met(near)
                    for i in np.flatnonzero(count):
                        for name, value in (("word", near[i].decode("latin-1")), ("n_near", int(count[i])), ("form", reader.spelled(best[i])), ("form_n", int(reader.n[best[i]]))):
                            found[name].append(value)
                yield pa.RecordBatch.from_pydict(found, pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]))

    return words.mapInArrow(run, MET)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have neighbours: how many, and the best one with its occurrences."""
    small_batches(words.sparkSession)
    tries, known = stored(shards(words), "tries"), words.count()
    spread = words.select("word").repartition(max(1, -(-known // TASK_WORDS)), "word")  # little data, much work
    listed = [(r.shard, r.bytes) for r in tries.select("shard", "bytes").collect()]
    out = words.sparkSession.createDataFrame([], MET)
    for own in passes(listed):
        rows = tries.where(F.col("shard").isin(own)).select("shortest", "longest", "trie").collect()  # at most PASS_BYTES letters
        out = out.union(stored(met_in(spread, [(r.shortest, r.longest, bytes(r.trie)) for r in rows]), "met"))
    forget(tries)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    found = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the path of forms ends.  Each round doubles what has been walked; a form has
    no more words than it has neighbours, so no key of the joins grows with the corpus."""
    walked = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = walked.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(walked.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(walked)
        walked = further.select("word", "root")
        if further.where("moved").isEmpty():
            return walked


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words."""
    words = stored(vocabulary(docs), "words")
    rows = words.join(near_words(words), "word", "left")
    better = F.coalesce(F.col("form_n") >= RATIO * F.col("n"), F.lit(False))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n")), "variants")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
