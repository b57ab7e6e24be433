"""Near-duplicate documents by min-max hashing.

Each document is the set of its five-word shingles.  Under each permutation both the smallest and the
largest value are kept, so 64 permutations give a signature of 128 values.  Equal sets are one class
from the start.  Signatures are cut into bands of four values; documents that share a band are
candidates, and every link is confirmed on the full sets.

Bands of large groups would give a quadratic number of pairs, so candidates are met in three rounds:
 1. in each band's bucket, all members with one leader, the same for most buckets of a group;
 2. in buckets that still hold several components, the members outside the largest one with a
    member of it, another in each bucket;
 3. what is left in buckets that still hold several components, in clusters of documents joined by such
    buckets.  A cluster is dealt out by size in blocks of about `BLOCK` documents and `BLOCK_SHINGLES` shingles; each
    two blocks whose sizes allow the similarity meet in one task, which counts the common shingles of all its pairs of different components exactly and gives
    only the links that join components, never more than the documents it holds.
A pair within one component needs no check, as it can't change the result; any other pair that shares
a band and is similar enough is found, so nothing is capped.

The smallest and the largest of a small set aren't independent, so bands would miss more of small sets: those of up to
`SMALL` shingles also get a key for each of their first shingles in the order of the hashes, as many as a set as
similar can't do without (6 of 21).  Two sets of which one has up to 16 shingles always share such a key.  Of larger
ones, at similarity 0.75 a pair shares no band with probability under 1e-5.

Defined cases: a document of fewer words than five has its whole sequence as its one shingle.  Null,
empty and blank texts have no shingle, are linked with nothing and kept.  `near_duplicates` speaks of
doc_ids: each row gets its result, rows of one doc_id are one document, linked by what any of them holds,
and a null doc_id is linked with nothing (component null, kept).  `keep_one` speaks of rows: of each
component the row of the smallest doc_id stays (a null one counts as the largest; of one doc_id the
smallest digest of the text), and of repeated rows one.  Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import forget, groups_of, mapped, mix, salts, stored, utf8
from .graph import components

SHINGLE = 5
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Documents and shingles of a block of the third round, about.
BLOCK, BLOCK_SHINGLES = 128, 131_072
PERCENT = 75
#: Shingles of a set that has exact keys too: a set similar to one of 16 has 21 at most.
SMALL = 21
#: Rows up to which a table of cluster sizes is broadcast: 40 bytes each.
FEW = 250_000
#: Bits of a filter for each of its keys, and of one filter at most (16 MB); a bitmap of Spark's holds 32,768.
KEY_BITS, FILTER_BITS, BITMAP_BITS = 16, 2**27, 2**15
NO_ID = 2**63 - 1

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACE = salts(SHINGLE, 11) | np.uint64(1)
_ROW, _BAND, _FIRST = salts(ROWS, 14) | np.uint64(1), salts(BANDS, 15), salts(1, 16)[0]
_XOR = (salts(PERMUTATIONS, 12) >> np.uint64(32)).astype(np.uint32)
_TIMES = (salts(PERMUTATIONS, 13) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(h) < size:
        return mix(np.array([(h * _PLACE[: len(h)]).sum() + np.uint64(len(h))], dtype=np.uint64))
    n = len(h) - size + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, size):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The smallest and the largest value of the set under each permutation, in turn."""
    s = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    for i in range(0, len(s), 2048):
        x = (s[i : i + 2048, None] ^ _XOR) * _TIMES
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    values = signed.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((values * _ROW).sum(axis=1) + _BAND).view(np.int64)


def first_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a small set's first shingles: any two sets that have them and are similar enough share one, as both would
    have to lack more than they may before their first common shingle."""
    if len(found) > SMALL:
        return np.empty(0, dtype=np.int64)
    return mix(found[: len(found) + 1 + (-PERCENT * len(found) // 100)] ^ _FIRST).view(np.int64)


def _told(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the id, the largest where it is null, and a digest of the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("mark"), "text")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, bands) of each document; digest is null for those without words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, start = utf8(batch.column("text")), 0
        for a, b in groups_of(texts, 2_000_000):
            found = [shingles(t) for t in texts[a:b]]
            n, digest = [len(f) for f in found], [xxhash.xxh3_128_digest(f.tobytes()) if len(f) else None for f in found]
            bands = [np.append(band_keys(signature(f)), first_keys(f)) if len(f) else None for f in found]
            ids = [batch.column(c).slice(start, b - a) for c in ("doc_id", "mark")]
            start = b
            yield pa.RecordBatch.from_arrays([*ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "digest", "bands"])

    return mapped(_told(docs), run, "doc_id long, mark binary, n_shingles long, digest binary, bands array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """(rep, found) of each row of (rep, text): its shingles."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = utf8(batch.column("text"))
        for a, b in groups_of(texts, 2_000_000):
            found = [shingles(t).view(np.int64) for t in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column("rep").slice(a, b - a), pa.array(found, pa.list_(pa.int64()))], names=["rep", "found"])

    return mapped(texts.select("rep", "text"), run, "rep long, found array<long>")


def _sifted(rows: DataFrame, doc_id: Column, mark: Column, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows that may be among the `n` stored `keys` (doc_id, mark), and those that are not.

    Only the first need meet the keys in a join, so the other texts aren't shuffled.  The keys' hashes are set in a broadcast
    filter; about one other row in 16 passes it, more where it would need over `FILTER_BITS`.
    """
    count = max(1, min(KEY_BITS * n, FILTER_BITS) // BITMAP_BITS)

    def place(*key: Column) -> tuple[Column, Column]:
        h = F.xxhash64(*key)
        return F.pmod(h, F.lit(count)), F.shiftrightunsigned(h, 49)

    of, bit = place(F.col("doc_id"), F.col("mark"))
    maps = F.broadcast(keys.groupBy(of.alias("of")).agg(F.bitmap_construct_agg(bit).alias("bits")))
    of, bit = place(doc_id, mark)
    byte = F.conv(F.hex(F.substr(maps["bits"], F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = (of == maps["of"]) & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)
    return rows.join(maps, there, "left_semi"), rows.join(maps, there, "left_anti")


def _alike(a: str, b: str) -> Column:
    """Whether two set sizes allow the similarity at all."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), with all their columns, whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("found").alias("of_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("found").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= PERCENT * (F.size("of_a") + F.size("of_b") - both)).select(pairs.columns)


def _with_component(buckets: DataFrame, found: DataFrame) -> DataFrame:
    return buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _in_larger(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """The rows with the component that theirs is in, by `merged` (node, component) of components."""
    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    return rows.join(into, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")


def _all_in_larger(found: DataFrame, merged: DataFrame) -> DataFrame:
    """The same of (node, component), with the nodes that had no component before."""
    alone = merged.join(found.select("node"), "node", "left_anti")
    return _in_larger(found, merged).select("node", "component").union(alone.select("node", "component"))


def _largest(members: DataFrame) -> DataFrame:
    """Of each bucket with several components: the largest one, one of its members, drawn by the bucket's key, and the
    bucket's smallest member."""
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("key", "rep").alias("drawn"), "rep", "n")).alias("one"), F.min("rep").alias("least"))
    most = sizes.groupBy("key").agg(F.max(F.struct("size", "component", "one")).alias("top"), F.count("*").alias("parts"), F.min("least").alias("least")).where("parts > 1")
    return most.select("key", F.col("top.component").alias("main"), F.col("top.one.rep").alias("leader"), F.col("top.one.n").alias("leader_n"), "least")


def classes_of(feats: DataFrame) -> DataFrame:
    """Classes of equal sets: (digest, one, n, bands, rep), where `one` is the smallest (doc_id, mark) and `rep` a
    number for the class, which is stored so that it never changes."""
    classes = feats.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("one"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    return stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")


def shared_ids(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that have a doc_id in common, each with the smallest of that id."""
    rows = feats.where("digest is not null").select("doc_id", "digest")
    mixed = rows.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("doc_id")
    of = rows.join(mixed, "doc_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    return of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))


def links(docs: DataFrame, classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component) of the classes with a link, those `known` (a, b) included.

    Later rounds link components, not documents, so each round's components are those of a smaller graph.
    """
    rows = classes.select(F.explode("bands").alias("key"), "rep", "n")
    # classes are numbered by where their digests fell, so the smallest number is as good as drawn, and makes stars of groups
    leaders = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("one")).where("size > 1")
    buckets = rows.join(leaders.select("key", F.col("one.rep").alias("leader"), F.col("one.n").alias("leader_n")), "key")
    buckets = stored(buckets, "buckets")
    seen = Observation()
    wanted = stored(classes.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "one.*").observe(seen, F.count("*").alias("n")), "wanted")
    texts, _ = _sifted(told := _told(docs), told["doc_id"], told["mark"], wanted, seen.get["n"])
    sets = stored(full_sets(texts.join(wanted, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])), "sets")
    plain = buckets.select("key", "rep", "n")

    # 1: with the bucket's leader
    pairs = buckets.where(F.col("rep") != F.col("leader")).where(_alike("n", "leader_n"))
    pairs = pairs.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    confirmed = _confirmed(pairs, sets)
    found = components(confirmed if known is None else confirmed.union(known))
    # 2: outside the largest component, with another member of it in each bucket
    members = stored(_with_component(plain, found), "members")
    pairs = members.join(_largest(members), "key").where(F.col("component") != F.col("main")).where(_alike("n", "leader_n"))
    pairs = pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"), F.least("component", "main").alias("x"), F.greatest("component", "main").alias("y")).distinct()
    second = components(_confirmed(pairs, sets).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # 3: what is left, in blocks of whole clusters
    last = stored(_in_larger(members, second), "members")
    left = stored(last.join(_largest(last).select("key", "least"), "key").select("rep", "component", "n", "least").distinct(), "left")
    clusters = components(left.select(F.col("rep").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    third = components(_block_links(left.select("rep", "component", "n").distinct().join(clusters, "rep"), sets))
    out = stored(_all_in_larger(_all_in_larger(found, second), third), "found")
    forget(buckets, wanted, sets, members, last, left)
    return out


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the components of documents (rep, component, n, cluster) of one cluster.

    Documents whose sizes differ by more than the similarity allows never link, so a cluster is cut by size in bands
    of that ratio, and a block of a band meets those of its own and of the next one.
    """
    members = stored(members.withColumn("band", F.floor(F.ln("n") / F.ln(F.lit(100 / PERCENT)) + 1e-9).cast("int")), "members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = stored(members.groupBy("cluster", "band").agg(blocks.alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y")), "sizes")
    several = sizes.groupBy("cluster").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x != y").select("cluster")
    after = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("more"))
    before = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("less"))
    seen = Observation()
    told = sizes.select("cluster", "band", "blocks").join(several, "cluster").join(after, ["cluster", "band"], "left").join(before, ["cluster", "band"], "left")
    told = stored(told.observe(seen, F.count("*").alias("n")), "sizes")
    if seen.get["n"] <= FEW:  # else adaptive execution splits a cluster that fills its task
        told = F.broadcast(told)
    rows = members.join(told, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets, "rep")

    def met(band: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.coalesce(n, F.lit(0))), lambda i: F.struct(band.alias("band"), (i - 1).cast("int").alias("block")))

    own = F.struct("band", "block")
    others = F.concat(met(F.col("band"), F.col("blocks")), *(F.when(n.isNotNull(), met(b, n)).otherwise(F.array().cast("array<struct<band:int,block:int>>")) for b, n in ((F.col("band") + 1, F.col("more")), (F.col("band") - 1, F.col("less")))))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(others))
    rows = rows.select("cluster", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") == F.least("own", "other")).alias("first"), "rep", "component", "found")
    keys = [F.col(c).alias(f"{s}_{k}") for s, k, c in ((s, k, f"{s}.{k}") for s in "pq" for k in ("band", "block"))]
    return rows.select("cluster", *keys, "first", "rep", "component", "found").groupBy("cluster", "p_band", "p_block", "q_band", "q_block").applyInPandas(_compared, "a long, b long")


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Two blocks against each other, or one against itself: the components that their links join."""
    same = rows["p_band"].iloc[0] == rows["q_band"].iloc[0] and rows["p_block"].iloc[0] == rows["q_block"].iloc[0]
    a = rows[rows["first"]]
    b = a if same else rows[~rows["first"]]
    na, nb = (np.array([len(f) for f in x["found"]], dtype=np.int64) for x in (a, b))
    ca, cb = a["component"].to_numpy(), b["component"].to_numpy()
    pairs = np.argwhere((100 * (n := common(list(a["found"]), list(b["found"]))) >= PERCENT * (na[:, None] + nb[None, :] - n)) & (ca[:, None] != cb[None, :]))
    into: dict[int, int] = {}

    def root(x: int) -> int:
        while x in into:
            x = into[x]
        return x

    out = []
    for i, j in pairs.tolist():
        x, y = root(ca[i]), root(cb[j])
        if x != y:
            into[max(x, y)] = min(x, y)
            out.append((ca[i], cb[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def common(left: list[np.ndarray], right: list[np.ndarray], most: int = 4_000_000) -> np.ndarray:
    """How many elements each set of one list has in common with each of the other: the places of each
    element in both are multiplied out, at most about `most` at a time."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not left or not right:
        return out
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), [len(f) for f in left]), np.repeat(np.arange(len(right)), [len(f) for f in right])
    order = np.argsort(x, kind="stable")
    x, i = x[order], i[order]
    low, high = np.searchsorted(x, y, "left"), np.searchsorted(x, y, "right")
    met = np.flatnonzero(high > low)
    low, n, j = low[met], (high - low)[met], j[met]
    upto = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most, "right")))
        k = n[start:end]
        at = np.repeat(low[start:end] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        out += np.bincount(i[at] * len(right) + np.repeat(j[start:end], k), minlength=out.size).reshape(out.shape)
        start = end
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: its set's size, its component's smallest doc_id, and whether it is that one."""
    feats = stored(features(docs), "features")
    linkable = feats.where(F.col("doc_id") != NO_ID)
    classes = classes_of(linkable)
    found = links(docs, classes, shared_ids(linkable, classes)).withColumnRenamed("node", "rep")
    least = found.join(classes.select("rep", F.col("one.doc_id").alias("least")), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.select("digest", "rep", F.col("one.doc_id").alias("least")).join(found.join(least, "component").select("rep", "component_id"), "rep", "left").select("digest", F.coalesce("component_id", "least").alias("component_id"))
    linked = linkable.where("digest is not null").select("doc_id", "n_shingles", "digest").join(named, "digest").drop("digest")
    alone = feats.where((F.col("doc_id") == NO_ID) | F.col("digest").isNull()).select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles").withColumn("component_id", F.col("doc_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns: of each component one row, and all rows without words."""
    feats = stored(features(docs), "features")
    classes = classes_of(feats)
    found = links(docs, classes).withColumnRenamed("node", "rep")
    first = found.join(classes.select("rep", "one"), "rep").groupBy("component").agg(F.min("one").alias("stays"))
    named = classes.select("digest", "rep", "one").join(found.join(first, "component").select("rep", "stays"), "rep", "left").select("digest", F.coalesce("stays", "one").alias("stays"))
    rows = feats.where("digest is not null").select(F.struct("doc_id", "mark").alias("row"), "digest").join(named, "digest")
    # what must go, and rows that are there several times, of which one stays
    rows = rows.groupBy("row").agg(F.min(F.col("row") == F.col("stays")).alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    seen = Observation()
    rows = stored(rows.select("row.doc_id", "row.mark", "kept").observe(seen, F.count("*").alias("n"), F.count_if("kept").alias("again")), "changed")
    told = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))))
    same = (told[0] == rows["doc_id"]) & (told[1] == rows["mark"])
    some, others = _sifted(docs, *told, rows, seen.get["n"])
    kept = others.union(some.join(rows, same, "left_anti"))
    if not seen.get["again"]:
        return kept
    return kept.union(some.join(rows.where("kept"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
