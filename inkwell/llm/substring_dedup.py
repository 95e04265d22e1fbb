"""Substring dedup by suffix automata over word passages.

A window is 13 consecutive words. A word goes if a window that covers it occurs in a document with a
smaller id. Suffix automata of reference shards give, for a passage streamed through them, how far each
place matches and, kept with every state, the least document its string occurs in.

The automata are not broadcast: what they must hold grows with the input. Reference passages and the
passages to be matched meet in shards instead, by what they have in common. Every window selects one of
its nine 5-grams, the one with the least hash, as its anchor; equal windows select the same. Anchors in
one text only are dropped. The windows around an anchor that select it make one passage of 13 to 21
words. Passages with the same anchor go to the same shard, which builds an automaton of the distinct
ones and streams each through it; shards are worked through in chunks of a bounded number of words.

Anchors at more than ``HOT`` places go by single windows, dealt by the window's hash. Of equal passages or
windows in a slice of texts only those in the least document go to a shard, the others are known to go;
so a passage in a third of all documents is a row for each slice. Anchors that texts of one slice share
are known to be shared at once: their rows are dealt at random, and one witness of them by the anchor.

Copies of a whole text take no part: all their windows occur in the first copy. Texts are copies if two
64-bit hashes of them agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import HEAVY, MOST_HEAVY, PARTS, checkpoint, give_back, slices, text_or_empty, written
from inkwell.llm.words import mix, shingle_hashes, word_hashes

WINDOW, GRAM = 13, 5
#: Places of an anchor from which it goes by single windows, and words a chunk of a shard holds before it is matched.
HOT, CHUNK = 4_000, 30_000
#: Such anchors up to which their list is broadcast (some 20 MB); more are joined by shuffle, each in several parts.
MOST_HOT = 1_000_000
_SALT = np.uint64(0x452821E638D01377)


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the hashes of a text's words: each anchor's hash and place, and the first and last window that selects it."""
    if len(words) < window:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    grams = mix(shingle_hashes(words, gram) ^ _SALT)
    span = window - gram + 1
    chosen = np.arange(len(grams) - span + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    last = np.append(first[1:], len(chosen)) - 1
    place = chosen[first]
    return grams[place].view(np.int64), place, first, last


class Automaton:
    """A suffix automaton of several word sequences, with the least document of each state's strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, to: dict, link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        self.least.append(None)
        return len(self.next) - 1

    def _clone(self, p: int, c, q: int) -> int:
        k = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = k
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def add(self, words: list, document: int) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:  # the string is there from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
                last = new
            if self.least[last] is None or document < self.least[last]:
                self.least[last] = document

    def finish(self) -> None:
        """Hand the least documents on to the suffixes, longest strings first."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            d, p = least[v], link[v]
            if d is not None and p > 0 and (least[p] is None or d < least[p]):
                least[p] = d

    def match(self, words: list, window: int) -> list[int | None]:
        """Matching statistics: for each window of the words the least document that has it, or None."""
        out, v, n = [], 0, 0
        nexts, link, length, least = self.next, self.link, self.length, self.least
        for i, c in enumerate(words, 1):
            while v and c not in nexts[v]:
                v = link[v]
                n = length[v]
            if c in nexts[v]:
                v, n = nexts[v][c], n + 1
            if i >= window:
                if n < window:
                    out.append(None)
                    continue
                while length[link[v]] >= window:
                    v = link[v]
                n = min(n, length[v])
                out.append(least[v])
        return out


def _hash(data: bytes) -> tuple[int, int]:
    """128 bits, in two signed halves."""
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _halves(pairs: list[tuple[int, int]]) -> list[pa.Array]:
    return [pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)]


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, packed, extra: every row, its text's hash, the text compressed, and what else the row carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_halves([_hash(t) for t in texts]), pa.array([zip_.compress(t) for t in texts], pa.binary()), batch.column("extra")], ["doc_id", "t1", "t2", "packed", "extra"])

    return docs.select("doc_id", "text", "extra").mapInArrow(run, f"doc_id long, t1 long, t2 long, packed binary, extra {docs.schema['extra'].dataType.simpleString()}")


def _hashes(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_halves([_hash(t) for t in batch.column("text").cast(pa.binary()).to_pylist()])], ["doc_id", "t1", "t2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, t1 long, t2 long")


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """key, anchor, t1, place: the anchors of each text, once whatever its copies in the partition.

    The key is the anchor and the anchor null, but for anchors that texts of a slice share: these rows
    have a random key, and one witness of them has the anchor as its key, and as its place the number of
    its places in the slice, below zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                texts = {h: t for t in batch.column("text").cast(pa.binary()).to_pylist() if (h := _hash(t)[0]) not in seen}
                seen |= texts.keys()
                found = [anchors(w, window)[:2] for w in word_hashes(list(texts.values()))]
                if not found:
                    continue
                anchor, place = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                text = np.repeat(np.array(list(texts), dtype=np.int64), [len(f[0]) for f in found])
                if not len(anchor):
                    continue
                _, back = np.unique(anchor, return_inverse=True)
                # texts an anchor is in: its distinct (anchor, text) pairs
                order = np.lexsort((text, back))
                first = np.ones(len(order), dtype=bool)
                first[1:] = (back[order][1:] != back[order][:-1]) | (text[order][1:] != text[order][:-1])
                times = np.bincount(back[order][first], minlength=int(back.max()) + 1)
                shared = times[back] > 1
                key = np.where(shared, mix(anchor.view(np.uint64) ^ mix(text.view(np.uint64))).view(np.int64), anchor)
                w = np.unique(np.where(shared, back, -1), return_index=True)[1]
                w = w[shared[w]]
                places = np.bincount(back)
                columns = [np.concatenate(x) for x in ((key, anchor[w]), (anchor, anchor[w]), (text, text[w]), (place, -places[back[w]]))]
                given = np.concatenate([~shared, np.ones(len(w), dtype=bool)])
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if k == 3 else x, mask=given if k == 1 else None) for k, x in enumerate(columns)], ["key", "anchor", "t1", "place"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, anchor long, t1 long, place int")


def _at_places(texts: DataFrame, window: int) -> DataFrame:
    """The passages around the anchors at the places in ``cold``, and the single windows of those in ``hot``.

    Of equal ones in a slice only the least document is worth a row: route (the anchor, or half the window's hash),
    id1, id2 (the words' hash), t1, doc_id, the places there, and the words. In the slice's other documents all their
    windows go; these come as one row a document, without a passage.
    """
    names = ["route", "id1", "id2", "t1", "doc_id", "starts", "passage"]
    types = [*[pa.int64()] * 5, pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in slices(whole, "packed", 1 << 20):
                least: dict[bytes, int] = {}
                found: dict[bytes, list[tuple[int, int]]] = {}
                routes: dict[bytes, int] = {}
                plain = [unzip.decompress(x) for x in batch.column("packed").to_pylist()]
                t1, doc = (batch.column(c).to_pylist() for c in ("t1", "doc_id"))
                for n, (text, hashes, d, cold, hot) in enumerate(zip(plain, word_hashes(plain), doc, *(batch.column(c).to_pylist() for c in ("cold", "hot")), strict=True)):
                    words = text.split()
                    anchor, place, first, last = anchors(hashes, window)
                    for at, single in ((cold, False), (hot, True)):
                        if not at:
                            continue
                        chosen = np.flatnonzero(np.isin(place, at))
                        for a, lo, hi in zip(anchor[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), strict=True):
                            for s, e in ((s, s + window) for s in range(lo, hi + 1)) if single else ((lo, hi + window),):
                                data = b" ".join(words[s:e])
                                places = found.get(data)
                                if places is None:
                                    found[data], least[data] = [(n, s)], d
                                    if not single:
                                        routes[data] = a
                                    continue
                                places.append((n, s))
                                if d < least[data]:
                                    least[data] = d
                out: list[list] = [[] for _ in names]
                gone: dict[int, list[int]] = {}
                for data, places in found.items():
                    d = least[data]
                    id1, id2 = _hash(data)
                    first: dict[int, list[int]] = {}
                    for n, s in places:
                        if doc[n] > d:
                            gone.setdefault(n, []).extend(range(s, s + data.count(b" ") + 2 - window))
                        else:
                            first.setdefault(n, []).append(s)
                    for n, starts in first.items():
                        for column, x in zip(out, (routes.get(data, id1), id1, id2, t1[n], d, starts, data), strict=True):
                            column.append(x)
                for n, starts in gone.items():
                    for column, x in zip(out, (t1[n], None, None, t1[n], doc[n], starts, None), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    # with the same columns as the result has, so that one shuffle of the texts serves both
    return texts.select("packed", "t1", "doc_id", "cold", "hot", "extra").mapInArrow(run, "route long, id1 long, id2 long, t1 long, doc_id long, starts array<int>, passage binary")


def _shards(passages: DataFrame, window: int) -> DataFrame:
    """t1, doc_id, s: the windows (by their place) that go, by automata over each shard's chunks."""
    dealt = passages.repartition(F.col("route")).sortWithinPartitions("route", "id1", "id2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each passage of a chunk its words, and where it stands: t1, doc_id and places
        held: list[tuple[list[bytes], list[tuple[int, int, list[int]]]]] = []
        known: list[tuple[int, int, list[int]]] = []
        size, route, passage = 0, None, None

        def out() -> pa.RecordBatch:
            automaton = Automaton()
            for words, places in held:
                automaton.add(words, min(d for _, d, _ in places))
            automaton.finish()
            gone = known
            for words, places in held:
                least = automaton.match(words, window)
                low = min(least)
                for t1, d, starts in places:
                    if low < d:
                        late = [i for i, x in enumerate(least) if x < d]
                        gone.append((t1, d, [s + i for s in starts for i in late]))
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in gone], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], ["t1", "doc_id", "s"])

        for batch in batches:
            for r, id1, id2, t1, d, starts, data in zip(*(batch.column(c).to_pylist() for c in ("route", "id1", "id2", "t1", "doc_id", "starts", "passage")), strict=True):
                if data is None:
                    known.append((t1, d, starts))
                    continue
                if r != route and size > CHUNK:
                    yield out()
                    held, size, known = [], 0, []
                if (r, id1, id2) != (route, *(passage or ())):
                    words = data.split(b" ")
                    held.append((words, []))
                    size += len(words)
                    route, passage = r, (id1, id2)
                held[-1][1].append((t1, d, starts))
        yield out()
        give_back()

    return dealt.mapInArrow(run, "t1 long, doc_id long, s array<int>")


def removed_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The rows with their texts (doc_id, t1, part, packed, is_first of its copies), and the windows that go of first copies (t1, of_doc, windows)."""
    copies = checkpoint(_hashes(docs).groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    # copies of a text with many are known from a broadcast list of bounded length, and all but the first dealt at random
    heavy = copies.where(F.col("n") > HEAVY).orderBy(F.desc("n"), "t1", "t2").limit(MOST_HEAVY).select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), F.col("first").alias("known"))
    rows = _texts(docs).join(F.broadcast(heavy), (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")), "left").drop("c1", "c2")
    rows = rows.withColumn("part", F.when(F.col("doc_id") > F.col("known"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(F.lit(0)))
    # one row for each text, and for those on the list one for each part; parts of t1 alone are the key of all joins of the texts, so that they are shuffled once
    on_list = F.when(F.col("n") > HEAVY, F.sequence(F.lit(0), F.lit(PARTS))).otherwise(F.array(F.lit(0)))
    firsts = copies.select(F.col("t1"), F.col("t2").alias("c2"), "first", F.explode(on_list).alias("part"))
    rows = rows.join(firsts, ["t1", "part"]).where(F.col("t2").bitwiseXOR(F.col("c2")) == 0)
    rows = rows.withColumn("is_first", F.coalesce(F.col("doc_id") <= F.col("first"), F.lit(False))).drop("c2", "first", "known", "t2")
    key = W.partitionBy("key")
    dealt = _anchors(docs, window).withColumns({"lo": F.min("t1").over(key), "hi": F.max("t1").over(key), "places": F.sum(F.greatest(F.lit(1), -F.col("place"))).over(key)})
    shared = written(dealt.where("place < 0 OR anchor IS NOT NULL OR lo < hi").select(F.coalesce("anchor", "key").alias("anchor"), "t1", "place", (F.col("anchor").isNull() & (F.col("places") > HOT)).alias("many")))
    hot = shared.where("many").select("anchor").distinct()
    found = shared.where("place >= 0").select("anchor", "t1", "place")
    if hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        found = found.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "anchor", "left")
    else:
        parts = hot.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"), F.lit(True).alias("is_hot"))
        found = found.withColumn("part", F.pmod("t1", F.lit(PARTS)).cast("int")).join(parts, ["anchor", "part"], "left")
    places = found.groupBy("t1").agg(F.collect_set(F.when(F.col("is_hot").isNull(), F.col("place"))).alias("cold"), F.collect_set(F.when(F.col("is_hot"), F.col("place"))).alias("hot"))
    # always 0, but not so plainly that it is left out of the join
    zero = F.pmod("t1", F.lit(1)).cast("int")
    around = rows.where("is_first").join(places.withColumn("part", zero), ["t1", "part"])
    gone = _shards(_at_places(around, window), window)
    windows = gone.groupBy("t1", F.col("doc_id").alias("of_doc")).agg(F.flatten(F.collect_list("s")).alias("windows"))
    return rows, windows.withColumn("part", zero)


def covered(n: int, starts: list[int] | None, window: int) -> np.ndarray:
    """Which of n words a window at one of the starts covers."""
    edge = np.zeros(n + 1, dtype=np.int64)
    if starts:
        at = np.unique(np.asarray(starts, dtype=np.int64))
        edge[at] += 1
        np.subtract.at(edge, np.minimum(at + window, n), 1)
    return np.cumsum(edge[:n]) > 0


def keep_words(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, n_removed, extra: every row with the words that stay, joined by one space; extra is a struct of the columns to carry."""
    extra = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(1).alias("none"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), extra.alias("extra"))
    rows, windows = removed_windows(docs.where("doc_id IS NOT NULL"), window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for whole in batches:
            for batch in slices(whole, "packed", 1 << 20):
                text, n_words, n_removed = [], [], []
                for packed, first, starts in zip(*(batch.column(c).to_pylist() for c in ("packed", "is_first", "windows")), strict=True):
                    words = unzip.decompress(packed).split()
                    n = len(words)
                    # of a copied text all but the first go, if it holds a window at all
                    gone = covered(n, starts, window) if first else np.full(n, n >= window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    text.append(b" ".join(kept).decode())
                    n_words.append(n)
                    n_removed.append(n - len(kept))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), batch.column("extra")], ["doc_id", "text", "n_words", "n_removed", "extra"])

    own = (rows["t1"] == windows["t1"]) & (rows["part"] == windows["part"]) & (F.col("doc_id").bitwiseXOR(F.col("of_doc")) == 0)
    joined = rows.join(windows, own, "left").select("doc_id", "packed", "is_first", "windows", "extra")
    named = joined.mapInArrow(run, f"doc_id long, text string, n_words long, n_removed long, extra {docs.schema['extra'].dataType.simpleString()}")
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    nameless = docs.where("doc_id IS NULL").select("doc_id", F.array_join(words, " ").alias("text"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), "extra")
    return named.unionByName(nameless)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words. Rows with equal ids are no copies of each other: only a smaller
    id takes words away. A null id is neither smaller nor greater, so its rows stay whole.
    """
    return keep_words(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
