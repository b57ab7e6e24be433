"""Words of many texts at once, as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix, salts

_POWER = salts(64, 31) | np.uint64(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Kinds of bytes: 0 space, 1 letters and all beyond ASCII, 2 digits, 3 other signs (a line end among them).
KIND = np.array([1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 2 if 48 <= b <= 57 else 0 if b in (32, 9, 13) else 3 for b in range(256)], dtype=np.uint8)


@dataclass
class Words:
    code: np.ndarray  # the bytes of all texts, lower case
    start: np.ndarray  # where each word starts
    length: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray  # the words of text i are bounds[i] to bounds[i + 1]
    kind: np.ndarray


def words(texts: list[bytes], signs: bool = False) -> Words:
    """The runs of letters and digits of each text, in lower case; with `signs`, runs of letters, of digits
    and of other signs, where the hash of a run of capitals (two or more) differs from the same in lower case."""
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(joined, dtype=np.uint8)
    code = np.frombuffer(joined.translate(_LOWER), dtype=np.uint8)
    kind = KIND[raw]
    if not signs:
        kind = ((kind == 1) | (kind == 2)).astype(np.uint8)
    change = np.flatnonzero(np.diff(kind, prepend=np.uint8(255)))
    length = np.diff(np.append(change, len(kind)))
    own = kind[change]
    start, length, own = change[own > 0], length[own > 0], own[own > 0]
    at = np.flatnonzero(kind > 0)
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    value = (code[at].astype(np.uint64) + np.uint64(1)) * _POWER[place & 63]
    h = np.add.reduceat(value, first) if len(first) else np.empty(0, dtype=np.uint64)
    if signs and len(first):
        capital = ((raw[at] >= 65) & (raw[at] <= 90)).astype(np.int32)
        shout = (np.add.reduceat(capital, first) == length) & (length > 1)
        h = h + shout.astype(np.uint64) * _POWER[7]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    bounds = np.searchsorted(start, np.append(0, np.cumsum(sizes)))
    return Words(code, start, length, mix(h) if len(h) else h, bounds, own)


def in_pieces(found: Words, most: int, size: int, step: int) -> Words:
    """Words of over `most` bytes (texts without spaces) as pieces of `size` bytes, one every `step`, each a word
    of its own; a piece starts and ends with a character and may be three bytes longer for it."""
    long = found.length > most
    if not long.any():
        return found
    count = np.where(long, -(-(found.length - size) // step) + 1, 1)
    first = np.cumsum(count) - count
    word = np.repeat(np.arange(len(count)), count)
    start = found.start[word] + (np.arange(len(word)) - first[word]) * step
    last = found.start[word] + found.length[word]
    end = np.where(long[word], np.minimum(start + size, last), last)
    for _ in range(3):
        start = start - ((found.code[start] & 0xC0) == 0x80)
        end = end - ((end < last) & ((found.code[np.minimum(end, len(found.code) - 1)] & 0xC0) == 0x80))
    h, cut = found.hash[word], np.flatnonzero(long[word])
    n = (end - start)[cut]
    edge = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(edge, n)
    value = (found.code[np.repeat(start[cut], n) + place].astype(np.uint64) + np.uint64(1)) * _POWER[place & 63]
    h[cut] = mix(np.add.reduceat(value, edge))
    return Words(found.code, start, end - start, h, np.append(first, len(word))[found.bounds], found.kind[word] if len(found.kind) else found.kind)


def sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows between neighbouring bounds; zero where there are none."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), dtype=values.dtype)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0)
    return out
