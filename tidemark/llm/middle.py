"""Fill-in-the-middle by lookaround splitting.

A unit grammar says which neighbouring classes of characters stay in one unit.  It is translated to a regex that
matches nowhere but between two units, as it only looks at the character before and the one after; Spark's `split` at
such matches loses nothing, so the pieces put together are the text.  Prefix, middle and suffix are runs of units.

Everything is a column expression over one row: nothing is shuffled, nothing leaves the JVM.  A row's memory grows with
its own text only (some hundred bytes a unit while it is cut).

Defined cases: a null text is empty; an empty text has no units (`split` would give one) and is plain; a null doc_id is
drawn for as if its decimal were empty; rows that repeat give rows that repeat; a text that holds one of the marks is
plain, so that what is written can always be read back.  Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Grammar:
    """Classes of characters, each as a regex of one character, that do not overlap and leave none out, and which
    class may follow which inside a unit."""

    classes: dict[str, str]
    together: frozenset[tuple[str, str]] = frozenset()

    def boundary(self) -> str:
        """A regex that matches the empty string between two units and nowhere else."""
        apart = [(a, b) for a in self.classes for b in self.classes if (a, b) not in self.together]
        return "|".join(f"(?<={self.classes[a]})(?={self.classes[b]})" for a, b in apart)


GRAMMARS = {
    "chars": Grammar({"any": r"[\s\S]"}),
    "words": Grammar({"space": r"\s", "sign": r"\S"}, frozenset({("sign", "sign"), ("sign", "space"), ("space", "space")})),
    "lines": Grammar({"end": r"\n", "other": r"[^\n]"}, frozenset({("other", "other"), ("other", "end")})),
    "runs": Grammar(
        {"letter": r"[\p{L}\p{M}]", "digit": r"\p{N}", "space": r"[\s&&[^\p{L}\p{M}\p{N}]]", "sign": r"[^\p{L}\p{M}\p{N}\s]"},
        frozenset({("letter", "letter"), ("digit", "digit"), ("space", "space")}),
    ),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text, in order; put together they are the text."""
    boundary = grammar.boundary()
    cut = F.split(text, boundary, -1) if boundary else F.array(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(cut)


def draws(doc_id: Column, turn: int = 1) -> list[Column]:
    """Eight numbers under 2^32, fixed by the id and the turn (another turn cuts a document elsewhere)."""
    digest = F.sha2(F.concat(F.lit(f"{turn}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]


def fill_in_middle(df: DataFrame, grammar: Grammar = GRAMMARS["chars"], turn: int = 1, plain_from: int = 90, spm_under: int = 20) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output), one row for each row of `df`: n is the number of units;
    parts are null where the form is plain.  Of a hundred documents those drawn from `plain_from` on stay plain; of the
    others those drawn under `spm_under` have their suffix first."""
    h1, h2, h3, h4 = draws(F.col("doc_id"), turn)[:4]
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_units", units(F.col("text"), grammar))
    n = F.size("_units").cast("long")
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    rows = rows.select(
        "doc_id", "text", "_units", n.alias("n"), F.least(h1 % (n + 1), h2 % (n + 1)).cast("int").alias("_a"), F.greatest(h1 % (n + 1), h2 % (n + 1)).cast("int").alias("_b"),
        F.when((F.col("text") == "") | marked | (h3 % 100 >= plain_from), PLAIN).when(h4 % 100 < spm_under, SPM).otherwise(PSM).alias("form"),
    )
    part = lambda start, length: F.when(F.col("form") != PLAIN, F.array_join(F.slice("_units", start, length), ""))
    rows = rows.select(
        "doc_id", "text", "n", "form", part(F.lit(1), F.col("_a")).alias("prefix"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("middle"),
        part(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return rows.withColumn("output", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(F.col("text")))


def restored(output: Column, form: Column) -> Column:
    """The text again, from what was written and its form alone: the marks are where they first stand, as no text
    that is cut holds one and none can come to be across an edge (a mark begins with its only `<`)."""

    def read(first: str, second: str, order: list[int]) -> Column:
        parts = F.split(F.substring(output, len(first) + 1, 2**31 - 1), f"{second}|{MIDDLE}", -1)
        return F.concat(*(parts[i] for i in order))

    return F.when(form == PSM, read(PREFIX, SUFFIX, [0, 2, 1])).when(form == SPM, read(SUFFIX, PREFIX, [1, 2, 0])).otherwise(output)


def digests(df: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) by code points."""
    rows = fill_in_middle(df).select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"), "output")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
