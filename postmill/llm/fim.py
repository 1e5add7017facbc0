"""Fill-in-the-middle by repeated captures: one match of (unit)* keeps where every unit ends.

match.ends(1) has the end of each repetition, so its length is the number of units and two of its entries are the cuts.
The regex library keeps at most some millions of captures, so a text of more than AT_ONCE code points is matched in
pieces of AT_ONCE units, each from where the one before ended; only the pieces that hold a cut are matched again.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units that one match keeps.
AT_ONCE = 1 << 20


class Units:
    """Texts as runs of a unit, any pattern without groups; "." is a code point."""

    def __init__(self, unit: str = ".", at_once: int = AT_ONCE):
        self.whole = regex.compile(f"({unit})*", regex.DOTALL)
        self.piece = regex.compile(f"({unit}){{1,{at_once}}}", regex.DOTALL)
        self.at_once = at_once

    def cuts(self, text: str, *draws: int) -> tuple[int, ...]:
        """The number n of units of text, and for each draw where its first draw % (n + 1) units end, the least first.

        ValueError for a text that isn't made of units.
        """
        if len(text) <= self.at_once:
            found = self.whole.fullmatch(text)
            if found is None:
                raise ValueError("the text is not a run of units")
            ends = found.ends(1)
            n = len(ends)
            return (n, *(ends[k - 1] if k else 0 for k in sorted(d % (n + 1) for d in draws)))
        starts, n, at = [], 0, 0
        while at < len(text):
            found = self.piece.match(text, at)
            if found is None:
                raise ValueError("the text is not a run of units")
            starts.append(at)
            n, at = n + len(found.ends(1)), found.end()
        ends = lambda k: self.piece.match(text, starts[(k - 1) // self.at_once]).ends(1)[(k - 1) % self.at_once]
        return (n, *(ends(k) if k else 0 for k in sorted(d % (n + 1) for d in draws)))


def cut_places(text: Column, first: Column, second: Column, unit: str = ".", at_once: int = AT_ONCE) -> Column:
    """(n, a, b): the units of text, and the code points before the lesser and the larger cut."""

    def run(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        units = Units(unit, at_once)
        return pd.DataFrame([units.cuts(t, int(x), int(y)) for t, x, y in zip(texts, one, two)], columns=["n", "a", "b"], dtype="int64")

    return F.pandas_udf(run, "struct<n:bigint, a:bigint, b:bigint>")(text, first, second)


def draw(k: int, seed: str = "1") -> Column:
    """The k-th of eight 32-bit numbers that the seed and doc_id alone decide."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named.cast("binary"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(df: DataFrame, plain_percent: int = 10, spm_percent: int = 20, unit: str = ".", at_once: int = AT_ONCE) -> DataFrame:
    """One row per row of df (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output.

    Form psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle, plain the text as it is; prefix and
    middle are counted in code points and null if plain. A null text counts as empty, and an empty one, or one that
    holds a mark, stays plain. Cuts and form follow from doc_id (null as one more id), so rows of one id are cut alike by
    their length; an empty table gives no rows, further columns are not read, and a text may have any length.
    """
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.withColumn("cut", cut_places(F.col("text"), draw(0), draw(1), unit, at_once))
    plain = (F.col("text") == "") | (draw(2) % 100 >= 100 - plain_percent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("text", F.lit(mark))
    formed = cut.withColumn("form", F.when(plain, "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm"))
    a, b, rest = F.col("cut.a").cast("int"), F.col("cut.b").cast("int"), F.char_length("text")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, rest - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    framed = F.col("form") != "plain"
    return formed.select(
        "doc_id", "cut.n", "form", F.when(framed, F.col("cut.a")).alias("prefix_chars"), F.when(framed, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output of a form was made of: its parts hold no mark, so the first of each mark parts them."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    head, width = len(PREFIX), F.char_length(output)

    def parts(second: str) -> tuple[Column, Column, Column]:
        at, end = F.locate(second, output), F.locate(MIDDLE, output)
        return F.substring(output, F.lit(head + 1), at - 1 - head), F.substring(output, at + head, end - at - head), F.substring(output, end + head, width)

    prefix, suffix, middle = parts(SUFFIX)
    last, first, centre = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, centre, last)).otherwise(output)


def fill_in_middle_digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored("output", "form")).alias("restored_sha256"))
