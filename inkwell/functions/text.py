"""Column functions on text: cleaning, segmentation, tokens and counts. All are row-local and stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.profiles import Profile

HAN_GAP = r"([\x{4e00}-\x{9fff}])[ \t]+([\x{4e00}-\x{9fff}])"
EDGES = r"^[ \t\r]+|[ \t\r]+$"


def text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def clean(t: Column) -> Column:
    """Without soft hyphens, and without white space between two Han characters (twice, as matches cannot overlap)."""
    t = F.translate(t, "­", "")
    for _ in range(2):
        t = F.regexp_replace(t, HAN_GAP, "$1$2")
    return t


def strip(t: Column) -> Column:
    return F.regexp_replace(t, EDGES, "")


def pieces(t: Column, pattern: str) -> Column:
    """What stands between matches of a pattern, stripped; empty pieces are left out."""
    return F.filter(F.transform(F.split(t, pattern), strip), lambda s: s != "")


def sentences(t: Column, p: Profile) -> Column:
    return pieces(t, p.sentence)


def tokens(t: Column, p: Profile) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(f"({p.token})"), F.lit(1))


def letters(t: Column, p: Profile) -> Column:
    return F.length(F.regexp_replace(t, p.letter, "")).cast("long")


def occurrences(words: Column, wanted: Sequence[str]) -> Column:
    """How many of the tokens are in a list; the list becomes one hash set of the plan, whatever its length."""
    return F.size(F.filter(words, lambda w: w.isin(*wanted))).cast("long") if wanted else F.lit(0).cast("long")


def per_thousand(n: Column, of: Column) -> Column:
    return F.round(F.try_divide(F.lit(1000.0) * n, of), 6)


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def mean_of(values: Column) -> Column:
    """The mean of an array of numbers; null of an empty one."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def any_of(words: Sequence[str]) -> str:
    """An alternation, longest first."""
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))
