"""Coherence: similarity and overlap of neighbouring sentences, connectives, references, focus on a topic, and a shuffled control.

The rows of a document are brought together once, by its id; what follows (neighbours that share a
gram, norms, the sum of a document's vectors) groups and sorts within that partitioning. The control
needs means alone and leaves every document where it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.profiles import Profile
from inkwell.functions.text import mean_of, sentences, text, tokens

#: Grams up to which their weights are broadcast (some 20 MB); beyond it they are joined by shuffle, each in so many parts.
BROADCAST, PARTS = 500_000, 16
#: Bytes of sentences that a step of ``control`` holds at once (a longer text stands alone there), and sentences that are counted at once.
SLICE_BYTES, SLICE_SENTENCES = 2 << 20, 1 << 20
#: Bits of a code point, and code points up to which grams are found by a table.
BITS, LOW = 21, 1 << 10


def sentence_rows(df: DataFrame, p: Profile, id_col: str = "doc_id", shuffled: str | None = None) -> DataFrame:
    """row_no, sid (from 0), sentence; with a seed, in an order that its hash decides."""
    parts = df.select(F.col(id_col).alias("row_no"), F.posexplode(sentences(text(), p)).alias("sid", "sentence"))
    if shuffled is None:
        return parts
    order = F.md5(F.concat_ws("-", F.lit(shuffled), F.col("row_no").cast("string"), F.col("sid").cast("string")))
    return parts.withColumn("sid", F.row_number().over(W.partitionBy("row_no").orderBy(order, "sid")) - 1)


def grams(rows: DataFrame) -> DataFrame:
    """row_no, sid, gram, tf: the character bigrams of each sentence, lower-cased, with their counts."""
    chars = rows.repartition(F.col("row_no")).select("row_no", "sid", F.split(F.lower("sentence"), "").alias("c"))
    pairs = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda b, i: F.concat(F.get("c", i), b))
    return chars.select("row_no", "sid", F.explode(pairs).alias("gram")).groupBy("row_no", "sid", "gram").agg(F.count("*").alias("tf"))


def idf(counted: DataFrame) -> DataFrame:
    """gram, df, idf: smoothed, over all sentences that have a gram."""
    total = F.broadcast(counted.select("row_no", "sid").distinct().agg(F.count("*").alias("n")))
    return counted.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(total).select("gram", "df", (F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))


def weighted(counted: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """row_no, sid, gram, w: term frequency times idf. Weights are made once, and broadcast if they turn out to be few."""
    weights = (weights if weights is not None else idf(counted)).select("gram", "idf")
    few = weights.limit(BROADCAST + 1).toPandas()
    if len(few) <= BROADCAST:
        return counted.join(F.broadcast(counted.sparkSession.createDataFrame(few, weights.schema)), "gram").select("row_no", "sid", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    # the sentences of a frequent gram are dealt to several tasks
    parts = weights.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = counted.withColumn("part", F.pmod(F.xxhash64("row_no", "sid"), F.lit(PARTS)).cast("int"))
    return dealt.join(parts, ["gram", "part"]).select("row_no", "sid", "gram", (F.col("tf") * F.col("idf")).alias("w"))


def similarities(vectors: DataFrame) -> DataFrame:
    """row_no, sid, cosine of each sentence and the next that has a gram at all."""
    same = W.partitionBy("row_no", "gram").orderBy("sid")
    before = F.when(F.lag("sid").over(same) == F.col("sid") - 1, F.lag("w").over(same)).otherwise(0.0)
    per = vectors.withColumn("before", before).groupBy("row_no", "sid").agg(F.sum(F.col("w") * F.col("before")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    order = W.partitionBy("row_no").orderBy("sid")
    pairs = per.withColumns({"last": F.lag("sid").over(order), "last_norm": F.lag("norm").over(order)}).where(F.col("last") == F.col("sid") - 1)
    return pairs.select("row_no", F.col("last").alias("sid"), F.round(F.col("dot") / (F.col("norm") * F.col("last_norm")), 6).alias("cosine"))


def _cuts(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items that add up to SLICE_BYTES and are ``most`` at most, by the bytes up to the end of each."""
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right"))), start + most)
        yield start, stop
        start = stop


def _coded(sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bigrams of sentences in their order, as numbers; the sentence of each; the code points of every sentence."""
    sentences = sentences.cast(pa.large_string())
    lengths = pc.utf8_length(sentences).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(sentences.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    both = np.flatnonzero(of[1:] == of[:-1])
    return points[both] << BITS | points[both + 1], of[both], lengths


def _counted(rows: DataFrame) -> DataFrame:
    """gram (as a number), df: how many of the sentences of all rows hold it; at -1 how many hold any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("s").flatten()
            for start, stop in _cuts(np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False), dtype=np.int64), SLICE_SENTENCES):
                code, of, lengths = _coded(every.slice(start, stop - start))
                # by gram and sentence, in one number
                key = np.sort(code << BITS | of)
                gram, df = np.unique(key[np.append(True, key[1:] != key[:-1])[: len(key)]] >> BITS, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(gram, -1), pa.int64()), pa.array(np.append(df, np.count_nonzero(lengths > 1)), pa.int64())], ["gram", "df"])

    return rows.select("s").mapInArrow(run, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def _neighbours(gram: np.ndarray, slot: np.ndarray, slots: int, idf: np.ndarray) -> np.ndarray:
    """The cosines of the sentences at neighbouring slots, where both have grams."""
    width = slots + 1
    key, tf = np.unique(gram * width + slot, return_counts=True)
    gram, slot = np.divmod(key, width)
    w = tf * idf[gram]
    norm = np.sqrt(np.bincount(slot, w * w, width))
    next_ = np.flatnonzero(key[1:] == key[:-1] + 1)
    dot = np.bincount(slot[next_], w[next_] * w[next_ + 1], width)
    at = np.flatnonzero((norm[1:] > 0) & (norm[:-1] > 0))
    return dot[at] / (norm[at] * norm[at + 1])


def _ranks(doc: np.ndarray, names: list[str], sid: np.ndarray, seed: str) -> np.ndarray:
    """The sentences in the order that the seed's hash decides, document by document."""
    hashes = b"".join(hashlib.md5(f"{seed}-{names[d]}-{k}".encode()).digest() for d, k in zip(doc.tolist(), sid.tolist(), strict=True))
    high, low = np.frombuffer(hashes, dtype=">u8").astype(np.uint64).reshape(-1, 2).T
    return np.lexsort((sid, low, high, doc))


def _cosines(rows: DataFrame, grams: np.ndarray, idf: list[np.ndarray], seed: str) -> DataFrame:
    """shuffled, cosine: of neighbouring sentences of each row, as they stand and in the shuffled order; ``grams`` are sorted, with their weights in either order."""
    spread = rows.sparkSession.sparkContext.broadcast((grams, *idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, original, shuffled = spread.value
        first, second = grams >> BITS, grams & ((1 << BITS) - 1)
        low = np.flatnonzero((first < LOW) & (second < LOW))
        table = np.zeros(LOW * LOW, dtype=np.int32)
        table[first[low] * LOW + second[low]] = low
        for batch in batches:
            lists = batch.column("s")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(np.append(0, pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False)), dtype=np.int64)[np.cumsum(n)]
            for start, stop in _cuts(upto, max(len(n), 1)):
                code, of, _ = _coded(lists.slice(start, stop - start).flatten())
                own = n[start:stop]
                doc = np.repeat(np.arange(len(own)), own)
                a, b = code >> BITS, code & ((1 << BITS) - 1)
                far = np.flatnonzero((a >= LOW) | (b >= LOW))
                gram = table[np.minimum(a, LOW - 1) * LOW + np.minimum(b, LOW - 1)].astype(np.int64)
                gram[far] = np.searchsorted(grams, code[far])
                # a slot stays empty between documents
                slot = np.arange(len(doc)) + doc
                sid = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
                moved = np.empty_like(slot)
                moved[_ranks(doc, batch.column("row_no").slice(start, stop - start).to_pylist(), sid, seed)] = slot
                for name, at, weights in ((False, slot, original), (True, moved, shuffled)):
                    found = _neighbours(gram, at[of], len(doc) + len(own), weights)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), pa.array(found, pa.float64())], ["shuffled", "cosine"])

    return rows.mapInArrow(run, "shuffled boolean, cosine double")


def control(df: DataFrame, p: Profile, seed: str, id_col: str = "doc_id") -> DataFrame:
    """ordering, pairs, mean: the similarity of neighbouring sentences as they stand and shuffled.

    Rows whose id is their own are done one by one: a pass that counts the sentences of every gram and one that
    compares, with the weights of all grams at hand. Rows without an id or with another's go sentence by sentence,
    and so does everything where there are more grams than can be broadcast. Without an id nothing is compared.
    """
    spark, ids = df.sparkSession, F.col(id_col)
    again = df.groupBy(id_col).agg(F.count("*").alias("n")).where((F.col("n") > 1) | ids.isNull()).select(ids.alias("again"))
    rest = df.limit(0)
    own = df
    if not again.isEmpty():
        same = ids.eqNullSafe(F.col("again"))
        own, rest = df.join(again, same, "left_anti"), df.join(again, same, "left_semi")
    rest_counted = [grams(sentence_rows(rest, p, id_col, order)) for order in (None, seed)]
    rows = own.select(ids.cast("string").alias("row_no"), F.transform(sentences(text(), p), F.lower).alias("s"))

    few = _counted(rows).limit(BROADCAST + 1).toPandas()
    weights: list[pd.DataFrame] | None = [] if len(few) <= BROADCAST else None
    for counted in rest_counted if weights is not None else []:
        all_ = few
        if own is not df:
            more = counted.groupBy("gram").agg(F.count("*").alias("df")).limit(BROADCAST + 1).toPandas()
            codes = [ord(g[0]) << BITS | ord(g[1]) for g in more["gram"]]
            n = counted.select("row_no", "sid").distinct().count()
            all_ = pd.DataFrame({"gram": [*few["gram"], *codes, -1], "df": [*few["df"], *more["df"], n]}).groupby("gram", as_index=False).sum()
        if len(all_) > BROADCAST:
            weights = None
            break
        all_ = all_.astype("int64").sort_values("gram")
        n = int(all_["df"][all_["gram"] == -1].sum())
        all_ = all_[all_["gram"] >= 0]
        weights.append(pd.DataFrame({"code": all_["gram"], "idf": np.log((1 + n) / (1.0 + all_["df"])) + 1}))

    if weights is None:
        both = [similarities(weighted(grams(sentence_rows(df, p, id_col, order)))) for order in (None, seed)]
    elif own is not df:
        frames = [spark.createDataFrame([(chr(c >> BITS) + chr(c & ((1 << BITS) - 1)), i) for c, i in zip(w["code"].tolist(), w["idf"].tolist(), strict=True)], "gram string, idf double") for w in weights]
        both = [similarities(weighted(counted, frame)) for counted, frame in zip(rest_counted, frames, strict=True)]
    else:
        both = []
    sims = [x.where("row_no IS NOT NULL").select(F.lit(k == 1).alias("shuffled"), "cosine") for k, x in enumerate(both)]
    if weights is not None:
        # grams of both orders are the same, for sentences stay whole
        known = weights[0]["code"].to_numpy()
        sims.append(_cosines(rows, known, [w["idf"].to_numpy() for w in weights], seed).select("shuffled", F.round("cosine", 6).alias("cosine")))
    every = sims[0]
    for x in sims[1:]:
        every = every.unionByName(x)
    one = lambda name, shuffled: F.struct(F.lit(name).alias("ordering"), F.col(f"n_{shuffled}").alias("pairs"), F.round(f"mean_{shuffled}", 5).alias("mean"))
    summed = every.agg(*[c for k in (False, True) for c in (F.count(F.when(F.col("shuffled") == k, 1)).alias(f"n_{k}"), F.avg(F.when(F.col("shuffled") == k, F.col("cosine"))).alias(f"mean_{k}"))])
    return summed.select(F.explode(F.array(one("original", False), one("shuffled", True))).alias("x")).select("x.*")


def focus(vectors: DataFrame) -> DataFrame:
    """row_no, focus: the mean cosine of a document's sentences and the sum of their vectors."""
    summed = vectors.withColumn("c", F.sum("w").over(W.partitionBy("row_no", "gram")))
    first = F.row_number().over(W.partitionBy("row_no", "gram").orderBy("sid")) == 1
    per = summed.withColumn("c2", F.when(first, F.col("c") * F.col("c")).otherwise(0.0)).groupBy("row_no", "sid").agg(F.sum(F.col("w") * F.col("c")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("c2").alias("c2"))
    return per.groupBy("row_no").agg(F.round(F.avg(F.col("dot") / F.col("norm")) / F.sqrt(F.sum("c2")), 6).alias("focus"))


def overlaps(words: Column) -> Column:
    """Jaccard overlaps of the token sets of neighbouring sentences, in an array."""
    n = F.size(words)
    return F.when(n > 1, F.transform(F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda b, i: F.try_divide(F.size(F.array_intersect(F.get(words, i), b)).cast("double"), F.size(F.array_union(F.get(words, i), b)).cast("double")))).otherwise(F.array().cast("array<double>"))


def surface(df: DataFrame, p: Profile, id_col: str = "doc_id") -> DataFrame:
    """row_no, n_sentences, cohesion, connectives (per sentence), references (share of sentences that begin with one), in one pass."""
    rows = df.select(F.col(id_col).alias("row_no"), F.transform(sentences(text(), p), lambda s: tokens(s, p)).alias("s"))
    n = F.size("s")
    linked = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(F.filter(x, lambda w: w.isin(*p.connectives))))
    referring = F.size(F.filter("s", lambda x: F.try_element_at(x, F.lit(1)).isin(*p.references)))
    over = F.filter(overlaps(F.col("s")), lambda x: x.isNotNull())
    return rows.select("row_no", n.cast("long").alias("n_sentences"), F.round(mean_of(over), 6).alias("cohesion"), F.round(F.try_divide(linked.cast("double"), n.cast("double")), 6).alias("connectives"), F.round(F.try_divide(referring.cast("double"), n.cast("double")), 6).alias("references"))
