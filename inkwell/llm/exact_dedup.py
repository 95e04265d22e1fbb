"""Exact dedup by a tree-merge of sorted digest runs.

Every partition first sorts the digests of its own rows into a run with one row per distinct text.
Partitions then exchange runs in log(P) rounds along a binomial tree, two levels of it at a time: in
round r a node keeps a quarter of the digest range it holds and sends the other quarters to the three
nodes that differ from it in the r-th base-4 digit, and merges the four sorted runs it gets. After
the last round each node holds the complete run of one slice of the digest range. Copies collapse in
every round, so a group of copies that holds a third of all rows is one row per node after the first
step, and no node ever holds more than its share of distinct texts.

A merge is verified: two rows are one text only if SHA-256, a second hash and the length all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import HEAVY, MOST_HEAVY, PARTS, SPACE_CHARS, checkpoint, shuffle_partitions, text_or_empty

RUN = "digest string, second long, n_bytes long, n long, best_len long, best_id long, node int"
KEY = ["digest", "second", "n_bytes"]
#: Base-2 digits of the tree that one round merges.
STEP = 2


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.translate(text, SPACE_CHARS, "")


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its length in code points, and the verified digest of its normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(name) for name, c in _measures(text_col).items()])


def _measures(text_col: str) -> dict[str, Column]:
    norm = normalised(text_or_empty(text_col))
    return {
        "length": F.length(text_or_empty(text_col)).cast("long"),
        "digest": F.sha2(norm, 256),
        "second": F.xxhash64(norm),
        "n_bytes": F.octet_length(norm).cast("long"),
    }


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a sorted stream: one row per text, the first (best) row's id and the sum of the counts."""
    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        if not t.num_rows:
            continue
        t = t.combine_chunks()
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in KEY:
            c = t.column(k).chunk(0)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        n = np.add.reduceat(t.column("n").to_numpy(), starts)
        # the field stays as it came, or the row that is carried would not go with the next batch
        at = t.schema.get_field_index("n")
        out = t.take(pa.array(starts)).set_column(at, t.schema.field(at), pa.array(n, pa.int64()))
        carry = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def _sorted_merge(df: DataFrame) -> DataFrame:
    order = [*map(F.col, KEY), F.col("best_len").desc(), F.col("best_id").asc_nulls_last()]
    return df.sortWithinPartitions(*order).mapInArrow(_merge, RUN)


def merge_tree(digests: DataFrame, nodes: int | None = None) -> DataFrame:
    """One row per distinct text: digest, n (copies), best_id (the row that stays), by the tree-merge."""
    want = nodes or shuffle_partitions(digests.sparkSession)
    rounds = 1
    while (1 << STEP * rounds) < want and rounds < 8:
        rounds += 1
    width, mask = 1 << STEP * rounds, (1 << STEP) - 1
    runs = digests.select(*KEY, F.lit(1).cast("long").alias("n"), F.col("length").alias("best_len"), F.col("doc_id").alias("best_id"), (F.spark_partition_id() % width).cast("int").alias("node"))
    runs = _sorted_merge(runs)
    prefix = F.conv(F.substring("digest", 1, 6), 16, 10).cast("int")
    for r in range(rounds):
        shift = STEP * r
        kept = F.col("node").bitwiseAND(F.lit((width - 1) & ~(mask << shift)))
        mine = F.shiftleft(F.shiftright(prefix, shift).bitwiseAND(F.lit(mask)), shift)
        runs = _sorted_merge(runs.withColumn("node", kept.bitwiseOR(mine).cast("int")).repartitionById(width, F.col("node")))
    return runs


def _large(best: DataFrame) -> DataFrame:
    """The digests of the largest groups of copies, a bounded number."""
    return best.where(F.col("n") > HEAVY).orderBy(F.desc("n"), *KEY).limit(MOST_HEAVY)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the longest original stays, then the smallest
    id. Null text counts as empty; a null id sorts last. Rows that repeat both id and text are one
    document: ``kept`` holds for each of them. Columns of other names are ignored.
    """
    digests = with_digest(docs, id_col, text_col)
    best = checkpoint(merge_tree(digests, nodes))
    # the rows of a large group are dealt to several tasks, to each of which the row that stays goes
    large = F.broadcast(_large(best).select("digest", F.lit(1).alias("large")).distinct())
    dealt = digests.join(large, "digest", "left").withColumn("part", F.when(F.col("large") == 1, F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))).drop("large")
    every = F.when(F.col("large") == 1, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    best = best.select(*KEY, F.col("best_id").alias("keep_id"), F.col("n").alias("group_size")).join(large, "digest", "left").withColumn("part", F.explode(every)).drop("large")
    return dealt.join(best, [*KEY, "part"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat both id and text, one of the longest.

    Rows that share an id but not a text are apart. Rows without an id stay only where ``exact_dedup``
    keeps no id for their text, one row for each text.
    """
    best = checkpoint(merge_tree(with_digest(docs, id_col, text_col)))
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    # plain columns for the id, so that join and dropDuplicates share one shuffle of the texts
    names = [f"{mark}{c}" for c in ("id", "nameless", *_measures(text_col))]
    with_keys = lambda i, measures: [x.alias(name) for name, x in zip(names, (F.coalesce(i, F.lit(0)), i.isNull(), *measures), strict=True)]
    own = {"length": "best_len"}
    kept = best.select(*with_keys(F.col("best_id"), [F.col(own.get(c, c)) for c in _measures(text_col)]))
    rows = docs.select("*", *with_keys(F.col(id_col).cast("long"), _measures(text_col).values()))
    # of a large group only rows that may stay are shuffled
    large = F.broadcast(_large(best).groupBy(F.col("digest").alias(f"{mark}large")).agg(F.collect_set(F.coalesce("best_id", F.lit(0))).alias(f"{mark}ids")))
    rows = rows.join(large, F.col(f"{mark}digest") == F.col(f"{mark}large"), "left").where(F.col(f"{mark}ids").isNull() | F.array_contains(f"{mark}ids", F.col(f"{mark}id")))
    return rows.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)
