"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that stand side by side inside no vocabulary token can never come to be in
one token, so the text is cut between them for certain; the fragments are encoded independently and
their ids concatenated.  Fragments are short and recur, so each task remembers the ids of those it
has met, within a bound.  Texts are only mapped: nothing is shuffled.

The vocabulary file is one of the public tokenizers (its path is a parameter): a byte-level BPE with
an end-of-word mark, lower-cased, white space dropped.  The special tokens' strings inside a text are
taken for the tokens themselves.  Decoding gives the tokens' strings with a space between each two,
as the file names no decoder; `text_of` undoes the byte alphabet besides.

Defined cases: null and empty texts give no ids and an empty decoded text.  Texts are never cut short.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import mapped

#: Bytes of the pieces a task remembers, with what Python needs for each, before it starts anew.
REMEMBERED, EACH = 16_000_000, 200
#: The rank of pairs that are never joined.
NEVER = np.int32(2**31 - 1)

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids_head array<int>"
END = "</w>"

ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others for the characters from 256 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class Pairs:
    """Rank and product of each merge, found by the numbers of its two symbols: a hash table for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray, bits: int = 20):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NEVER, dtype=np.int32)
        self.product, self.probes = product.astype(np.int32), 1
        keys = (left.astype(np.int64) << 32) | right
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.slot(keys).tolist())):
            probes = 1
            while self.keys[at] not in (-1, key):
                at, probes = (at + 1) & self.mask, probes + 1
            if self.keys[at] == -1:
                self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, probes)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER where the two are never joined."""
        keys = (left.astype(np.int64) << 32) | right
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NEVER)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model.get("end_of_word_suffix") != END or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a vocabulary with the end-of-word mark {END}")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.shown = {i: t.encode() for i, t in self.token.items()}
        self.text_to_bytes = {c: b for b, c in byte_alphabet().items()}
        letters = [byte_alphabet()[b] for b in range(256)]
        self.first = np.array([[vocab[c] for c in letters], [vocab[c + END] for c in letters]], dtype=np.int32)
        merges = [tuple(m) for m in model["merges"]]
        self.pairs = Pairs(*(np.array([vocab[f(m)] for m in merges], dtype=np.int64) for f in (lambda m: m[0], lambda m: m[1], "".join)))
        #: Which two symbols stand side by side inside some token: without that, a cut between them is certain.
        number = {c: i for i, c in enumerate(letters)} | {c + END: 256 + i for i, c in enumerate(letters)}
        self.inside = np.zeros((512, 512), dtype=bool)
        for symbols in map(self.symbols, vocab):
            for a, b in zip(symbols, symbols[1:]):
                self.inside[number[a], number[b]] = True
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {t: np.array([i], dtype="<u4").tobytes() for t, i in self.special.items()}
        self.always, self.held = len(self.known), 0

    @staticmethod
    def symbols(token: str) -> list[str]:
        """A token's characters; the end-of-word mark belongs to the last."""
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def fragments(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' symbols one after another, where fragments start, and how many symbols each piece has."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        code = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        last = np.cumsum(length) - 1
        ends = np.zeros(len(code), dtype=np.int64)
        ends[last] = 1
        number = code + 256 * ends
        start = np.ones(len(code), dtype=bool)
        start[1:] = ~self.inside[number[:-1], number[1:]] | (ends[:-1] == 1)
        return self.first[ends, code], start, length

    def merge(self, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes all fragments at once.  In each round every fragment joins its earliest learned pair,
        leftmost first, until none is left.  Gives the ids and, for each, the place of its first symbol."""
        at = np.arange(len(symbols))
        done_ids, done_at = [], []
        while len(symbols):
            heads = np.flatnonzero(start)
            rank = np.full(len(symbols), NEVER, dtype=np.int32)
            inner = np.flatnonzero(~start[1:])
            rank[inner] = self.pairs.rank(symbols[inner], symbols[inner + 1])
            best = np.minimum.reduceat(rank, heads)
            size = np.diff(np.append(heads, len(symbols)))
            live = np.repeat(best != NEVER, size)
            done_ids.append(symbols[~live])
            done_at.append(at[~live])
            symbols, at, start, rank = symbols[live], at[live], start[live], rank[live]
            join = rank == np.repeat(best[best != NEVER], size[best != NEVER])
            # of neighbouring places of one pair (a a a) every second is joined, from the left
            run = np.flatnonzero(join[1:] & join[:-1])
            if len(run):
                where = np.arange(len(join))
                lead = np.maximum.accumulate(np.where(join & ~np.append(False, join[:-1]), where, 0))
                join &= (where - lead) % 2 == 0
            where = np.flatnonzero(join)
            symbols[where] = self.pairs.product[rank[where]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[where + 1] = False
            symbols, at, start = symbols[keep], at[keep], start[keep]
        ids, place = np.concatenate(done_ids or [symbols]), np.concatenate(done_at or [at])
        order = np.argsort(place, kind="stable")
        return ids[order], place[order]

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't remembered yet."""
        if not pieces:
            return
        symbols, start, length = self.fragments(pieces)
        ids, place = self.merge(symbols, start)
        cut = np.searchsorted(place, np.cumsum(length)).tolist()
        raw = ids.astype("<u4").tobytes()
        a = 0
        for p, b in zip(pieces, cut):
            self.known[p] = raw[4 * a : 4 * b]
            self.held += EACH + 2 * len(p) + 4 * (b - a)
            a = b

    def normalized(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # each character by itself: no final sigma

    def pieces(self, text: str | None) -> list[str]:
        """What white space and kinds of characters part; special tokens stand by themselves."""
        if not text:
            return []
        out: list[str] = []
        for part in self.split_special.split(text) if self.split_special and "<" in text else (text,):
            if part in self.special:
                out.append(part)
            elif part.isascii():
                out += ASCII_PIECES.findall(part.lower())
            else:
                out += PIECES.findall(self.normalized(part))
        return out

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids (little-endian, 32 bits each) of whole texts."""
        split = [self.pieces(t) for t in texts]
        wanted = {p for pieces in split for p in pieces}
        if self.held > REMEMBERED:
            self.known, self.held = dict(list(self.known.items())[: self.always]), 0
        self.learn([p for p in wanted if p not in self.known])
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings with a space between each two."""
        return " ".join(self.token[i] for i in ids)

    def text_of(self, ids: Iterable[int]) -> str:
        """The normalized text of the ids, words parted by spaces."""
        out = bytearray()
        for i in ids:
            t = self.token[i]
            if t in self.special:
                out += t.encode() + b" "
                continue
            ends = t.endswith(END) and len(t) > len(END)
            out += bytes(self.text_to_bytes[c] for c in (t[: -len(END)] if ends else t)) + b" " * ends
        return out.decode("utf-8", "replace").rstrip(" ")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bounded(texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[list[str | None]]:
    """The texts in groups of about `most` characters, or of one text."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of its tokens, digests of the ids and of the decoded text, the first ids."""
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, n, a, b, head = encoder(path), [], [], [], []
        for texts in bounded(t.as_py() for t in batch.column("text")):
            for ids in code.encode_all(texts):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(code.decode_bytes(ids)).hexdigest())
                head.append(np.frombuffer(ids[:32], dtype="<u4").tolist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(head, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_head"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def with_ids(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns `keep` of the documents, the ids of each text (a null text has none) and their number.

    A few megabytes of text are in memory at once; a group's ids are one array that Arrow takes as it is.
    """
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code, at = encoder(path), 0
        for texts in bounded(t.as_py() for t in batch.column(len(keep))):
            found = code.encode_all(texts)
            n = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(len(keep))), ids, pa.array(n)], names=[*keep, "ids", "n_tokens"])
            at += len(texts)

    rows = docs.select(*keep, "text")
    schema = StructType([*rows.schema.fields[:-1], StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])
    return mapped(rows, run, schema)


def encoded(path: str | None = None):
    """A column function: the ids of a text as ``array<int>``; a null text has none."""
    path = path or default_path()

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        code = encoder(path)
        return pd.Series([np.frombuffer(i, dtype="<u4").astype(np.int32) for group in bounded(texts) for i in code.encode_all(group)], dtype=object)

    return of


def decoded(path: str | None = None):
    """A column function: the decoded text of ids; null ids give an empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        code = encoder(path)
        return pd.Series([code.decode(() if x is None else map(int, x)) for x in ids], dtype=object)

    return of
