"""Chat formatting with a prefix tree.

A conversation is a path of turns.  Conversations are sorted by their paths, dealt out by ranges of
(path, conv_id), and each task walks its range in order: as neighbours share their first turns, a stack
of the current path is the only state.  A turn shared with the conversation before is emitted once; what
follows comes after it, depth first.  Every emitted turn (node) has its place in the pack, the position
of its first character on its own path, and the intervals of the pack that its ancestors fill, which is
what it may attend to besides itself.  A pack is closed after `PACK` characters, and a range ends one
too: the turns shared by the conversations of two packs are then in both.  That splits a first turn that
a third of all conversations share over many tasks, with at most one copy of a path for each pack.

Template: ``<|start|>role<|message|>text<|end|>``.  Control strings, these and others of public templates,
are broken inside roles and texts by a backslash after their first character, and backslashes are
doubled, so that the text can be read back exactly.  The loss mask covers the texts of the assistant.

Defined cases: null texts and roles are empty.  Turns are ordered by turn, then role and text; repeated
rows are turns of their own.  A row with a null conv_id belongs to no other: it is a conversation of its own,
so nothing is gathered by null.  One conversation is one row of a task's memory, like one document.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
#: What chat templates in public use take for control.
CONTROL = (START, MESSAGE, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED_ROLE = "assistant"
#: Characters of a pack, about, and packs of a range.
PACK, PACKS_A_RANGE = 1_000_000, 16

_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MESSAGE) + "(.*?)" + re.escape(END), re.DOTALL)

NODE = "struct<start:long,end:long,position:long,parent:int,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>>"
PACKS = f"text string, nodes array<{NODE}>, conversations array<struct<conv_id:long,leaf:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends."""
    head = f"{START}{escaped(role)}{MESSAGE}"
    body = escaped(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


class Pack:
    """What one range of sorted conversations emits, up to `PACK` characters."""

    def __init__(self):
        self.parts, self.size, self.nodes, self.leaves = [], 0, [], []
        self.path: list[tuple[tuple[str, str], int]] = []  # the current path: turn, number of its node

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            text, a, b = formatted(*turn)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attends = [*above["attends"], {"start": above["start"], "end": above["end"]}] if above else []
            if len(attends) > 1 and attends[-2]["end"] == attends[-1]["start"]:
                attends[-2:] = [{"start": attends[-2]["start"], "end": attends[-1]["end"]}]
            learned = turn[0] == LEARNED_ROLE
            position = above["position"] + above["end"] - above["start"] if above else 0
            self.path.append((turn, len(self.nodes)))
            self.nodes.append({"start": self.size, "end": self.size + len(text), "position": position, "parent": parent, "loss_start": self.size + a if learned else self.size, "loss_end": self.size + b if learned else self.size, "attends": attends})
            self.parts.append(text)
            self.size += len(text)
        self.leaves.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def row(self) -> pa.RecordBatch:
        node = pa.struct([*((n, pa.int64()) for n in ("start", "end", "position")), ("parent", pa.int32()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        leaf = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array(["".join(self.parts)]), pa.array([self.nodes], pa.list_(node)), pa.array([self.leaves], pa.list_(leaf))], names=["text", "nodes", "conversations"])


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, turns, tie) of each conversation: its turns in order, a hash of each turn with all before it, and a
    number that tells rows without conv_id apart, so that any number of equal ones can be dealt out."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    whole = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    alone = rows.where(F.col("conv_id").isNull()).select("conv_id", F.array("turn").alias("turns"), F.monotonically_increasing_id().alias("tie"))  # the table's own order
    whole = whole.withColumn("tie", F.lit(0).cast("long")).unionByName(alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for turns in batch.column("turns"):
                h, path = b"", []
                for t in turns.as_py():
                    h = xxhash.xxh3_64_digest(h + xxhash.xxh3_64_digest(t["role"].encode()) + t["text"].encode())
                    path.append(int.from_bytes(h, "little", signed=True))
                out.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.list_(pa.int64())), batch.column("turns"), batch.column("tie")], names=["conv_id", "path", "turns", "tie"])

    return whole.mapInArrow(run, f"conv_id long, path array<long>, turns {dict(whole.dtypes)['turns']}, tie long")


def ranges(conversations: DataFrame, most: int) -> int:
    """As many ranges as the session shuffles to, or more where the texts would fill over `PACKS_A_RANGE` packs of each."""
    letters = conversations.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1)).first()[0] or 0
    return max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-letters // (PACKS_A_RANGE * most)))


def packed(conversations: DataFrame, partitions: int | None = None, most: int = PACK) -> DataFrame:
    """The packs: text emitted once, nodes with places, positions and attention intervals, leaf of each conversation."""
    n = partitions or ranges(conversations, most)
    ordered = paths(conversations).repartitionByRange(n, "path", "conv_id", "tie").sortWithinPartitions("path", "conv_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()
        for batch in batches:
            for conv_id, turns in zip(batch.column("conv_id"), batch.column("turns")):
                pack.add(conv_id.as_py(), [(t["role"], t["text"]) for t in turns.as_py()])
                if pack.size >= most:
                    yield pack.row()
                    pack = Pack()
        if pack.leaves:
            yield pack.row()

    return ordered.select("conv_id", "turns").mapInArrow(run, PACKS)


def read(text: str, nodes: list[dict], leaf: int) -> tuple[str, list[tuple[str, str]], str]:
    """A conversation of a pack: its formatted text, its turns, and the text under its loss mask."""
    if leaf < 0:
        return "", [], ""
    node = nodes[leaf]
    whole = "".join(text[a["start"] : a["end"]] for a in [*node["attends"], node])
    turns = [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(whole)]
    learned = []
    while leaf >= 0:
        learned.append(text[nodes[leaf]["loss_start"] : nodes[leaf]["loss_end"]])
        leaf = nodes[leaf]["parent"]
    return whole, turns, "".join(unescaped(t) for t in reversed(learned))


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone: digests of its turns and of its text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, nodes, leaves in zip(*(batch.column(c) for c in ("text", "nodes", "conversations"))):
                text, nodes, rows = text.as_py(), nodes.as_py(), []
                for c in leaves.as_py():
                    whole, turns, learned = read(text, nodes, c["leaf"])
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    rows.append((c["conv_id"], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(whole)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return packs.mapInArrow(run, READ)
