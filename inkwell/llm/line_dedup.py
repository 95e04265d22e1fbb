"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Two lines are within one edit (a character put in, taken out or changed) exactly if deleting one
character from one of them, or from both at the same place, gives the same string. So lines emit the
hashes of their deletions as keys, with the place, and of themselves. Lines with the same key and place
differ in the character there and are all within one edit of each other; a line whose own hash is
another's deletion is within one edit of it. The earliest line of a group therefore decides for all of
it: the join is two windows over the keys, in time linear in their number, and no pairs are made. What
they find is verified by the edit distance of the texts.

A line of n characters has n deletions of n characters, so where an edit can be is narrowed first. Cut a
line into blocks: if two lines differ in one block only, what stands before it and what stands behind it
are equal. A line whose halves occur with no other line has no partner; of the rest, each is cut into
``BLOCKS``, and only deletions inside a block whose surroundings occur with another line are emitted.
Both steps keep every line that has a partner, whatever its length. The lists that the first step makes
(keys that lines share, lines that have one) are written and counted: short ones are broadcast to the
scan, so that the texts of all other lines stay where they are; long ones are joined by shuffle.

Rows are told apart by their id and their text's hash, so rows that repeat an id, or have none, are
documents of their own; a line is earlier by its document's id (none before all others), then that hash,
then its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import checkpoint, text_or_empty, written

BLOCKS = 16
#: Numbers in a list up to which it is broadcast (some 60 MB).
LISTED = 2_000_000
LINE = ["h1", "h2"]


#: A row's identity, and a line's place: its row and its number.
ROW = ["doc_id", "row_hash"]
PLACE = [*ROW, "line_no"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_hash and the text's parts between newlines."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.split(text, "\n", -1).alias("parts"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, line_no (from 0), line, and the line's identity h1, h2: lines of every text, trimmed, that are not empty."""
    split = _rows(docs, id_col, text_col).select(*ROW, F.posexplode("parts").alias("line_no", "line"))
    split = split.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return split.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(2))})


def _cut(base: Column, i: Column | int, blocks: int) -> Column:
    """Where block i of a line of ``base`` characters begins."""
    return F.floor(F.lit(i).cast("long") * base / blocks).cast("int") if isinstance(i, int) else F.floor(i.cast("long") * base / blocks).cast("int")


def block_keys(rows: DataFrame, blocks: int, *keep: str) -> DataFrame:
    """base, block and key: a hash of what surrounds each block, for partners as long, one longer and one shorter.

    ``base`` is the shorter length of such a pair; blocks before an edit are counted from the line's start, those behind from its end.
    """
    line, n = F.col("line"), F.col("n")
    rows = rows.withColumn("n", F.length("line"))

    def at(base: Column, b: int) -> Column:
        start, stop = _cut(base, b, blocks), _cut(base, b + 1, blocks)
        before, behind = F.substring(line, F.lit(1), start), F.substring(line, n - (base - stop) + 1, base - stop)
        return F.struct(base.alias("base"), F.lit(b).alias("block"), F.xxhash64(F.lit(b), base, before, F.lit("|"), behind).alias("key"))

    return rows.select(*keep, F.explode(F.array(*[at(base, b) for base in (n, n - 1) for b in range(blocks)])).alias("k")).select(*keep, "k.base", "k.block", "k.key")


def half_keys(rows: DataFrame) -> DataFrame:
    """h1 and key: hashes of the line's first and last half, with the base; the keys of two blocks without their numbers."""
    rows = rows.select("h1", "line", F.length("line").alias("n"))

    def both(base: Column) -> list[Column]:
        first = F.shiftright(base, 1)
        return [F.xxhash64(base, F.substring("line", F.lit(1), first)), F.xxhash64(base, F.lit("|"), F.substring("line", F.col("n") - (base - first) + 1, base - first))]

    return rows.select("h1", F.explode(F.array(*both(F.col("n")), *both(F.col("n") - 1))).alias("key"))


def _shared(keys: DataFrame) -> DataFrame:
    """The keys that more than one line has."""
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a < b").select("key")


def variants(rows: DataFrame) -> DataFrame:
    """h1, h2, first, v1, v2, place: the hashes of a line's deletions in the given blocks, and of itself with place -1."""
    line, n, base = F.col("line"), F.length("line"), F.col("base")
    start, stop = _cut(base, F.col("block"), BLOCKS), _cut(base, F.col("block") + 1, BLOCKS)
    # of equally long lines the edit is inside the block; the longer of two may have its character at the end as well
    last = F.when(n == base, stop - 1).otherwise(stop)
    places = F.when(last >= start, F.sequence(start, F.greatest(last, start))).otherwise(F.array().cast("array<int>"))
    rest = lambda p: F.concat(F.substring(line, F.lit(1), p), F.substring(line, p + 2, n))
    deleted = F.transform(places, lambda p: F.struct(F.xxhash64(rest(p)).alias("v1"), F.xxhash64(rest(p), F.lit(2)).alias("v2"), p.alias("place")))
    own = F.array(F.struct(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.lit(-1).alias("place")))
    return rows.select(*LINE, "first", F.explode(F.concat(own, deleted)).alias("v")).select(*LINE, "first", "v.v1", "v.v2", "v.place")


def _among(df: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """The rows whose column is in a list, which is written and counted first: a short one is broadcast, for a long one the rows are shuffled."""
    listed = checkpoint(listed)
    short = listed.limit(LISTED + 1).count() <= LISTED
    return df.join(F.broadcast(listed) if short else listed, column, "left_semi")


def earlier_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h1, h2 of every distinct line that is within one edit of an earlier line, and that line's place: earlier."""
    every = lines(docs, id_col, text_col)
    likely = _among(half_keys(every), _shared(half_keys(every)), "key").select("h1").distinct()
    # one row for each distinct line that may have a partner, with its text
    place = F.min(F.struct(*PLACE)).alias("first")
    texts = written(_among(every, likely, "h1").groupBy(*LINE).agg(place, F.min("line").alias("line")))
    keys = block_keys(texts, BLOCKS, *LINE, "first", "line")
    near = keys.join(_shared(keys.select("h1", "key")), "key", "left_semi")
    v = variants(near)
    group, there = W.partitionBy("v1", "v2"), W.partitionBy("v1", "v2", "place")
    itself = F.min(F.when(F.col("place") == -1, F.col("first"))).over(group)
    best = F.when(F.col("place") == -1, F.min("first").over(group)).otherwise(F.least(F.min("first").over(there), itself))
    found = v.withColumn("best", best).where("best < first").groupBy(*LINE).agg(F.min("best").alias("best"))
    one, other = texts.select(*LINE, F.col("line").alias("a")), texts.select(F.col("first").alias("best"), F.col("line").alias("b"))
    return found.join(one, LINE).join(other, "best").where(F.levenshtein("a", "b", 1) >= 0).select(*LINE, F.col("best").alias("earlier"))


def _kept(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __hash and kept: the numbers of the lines that stay, of every row that has some."""
    firsts = lines(docs, id_col, text_col).groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("first"))
    staying = firsts.join(earlier_neighbours(docs, id_col, text_col).select(*LINE), LINE, "left_anti")
    return staying.groupBy(F.col("first.doc_id").alias("__id"), F.col("first.row_hash").alias("__hash")).agg(F.collect_list("first.line_no").alias("kept"))


def _with_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash")), "left")
    return joined.withColumn("kept", F.coalesce("kept", F.array().cast("array<int>"))).drop("__id", "__hash")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and the text without the lines that ``line_dedup`` removes; empty lines stay."""
    rows = _with_kept(_rows(docs, id_col, text_col), _kept(docs, id_col, text_col))
    at = F.transform(F.filter(F.transform("parts", lambda part, i: F.struct(i.alias("i"), (trimmed(part) == "").alias("blank"))), lambda x: x["blank"]), lambda x: x["i"])
    rows = rows.withColumn("stay", F.array_sort(F.array_union("kept", at)))
    return rows.select("doc_id", F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n").alias("text"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept_lines (numbers of the lines that stay, from 0).

    Lines are what stands between newlines, trimmed; empty ones are not counted. A line stays if no line
    that comes earlier is equal to it or within one edit of it. A null text has no lines, a null id sorts
    first; rows that repeat both id and text are one document, and have the same result.
    """
    n = F.size(F.filter("parts", lambda x: trimmed(x) != "")).cast("long")
    rows = _with_kept(_rows(docs, id_col, text_col).select(*ROW, n.alias("n_lines")), _kept(docs, id_col, text_col))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.sort_array("kept").alias("kept_lines"))
