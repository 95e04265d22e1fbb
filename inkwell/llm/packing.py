"""Packing documents into fixed-length token sequences: dominance reduction, then best fit.

Only token counts matter to the packing, so each document is tokenised once, longer ones are cut into
pieces of the sequence length, and the small table of pieces is checkpointed. All pieces are packed at
once over their histogram of lengths: its answer, sets of lengths with multiplicities, grows with the
sequence length and not with the input. Pieces are then dealt by a hash of their place into shards of
about ``SHARD`` documents, which grow in number, not in size, and each piece takes the place that its
rank among all pieces of its length has in the answer.

The reduction is that of Martello and Toth: for each piece j, longest first, look for a set of pieces
with j that no other feasible set could beat. Where no piece fits beside j, {j} is fixed. Where a piece
k fills the sequence exactly, {j, k} dominates (all that could stand beside j fits in k's place). Where
at most one piece fits beside j, the longest that fits is fixed with it; where at most two fit and one
piece is as long as the longest pair that fits, that piece; where that pair holds the longest piece that
fits and no pair has a longer second one, the triple dominates every other one. What no rule fixes goes by best fit, longest first, into the fullest open sequence that can take it.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import LETTERS, NUMBERS, PLAIN, ChunkCoder, checkpoint, slices, text_or_empty, tokenizer_path, written

#: Documents a shard is meant to hold.
SHARD = 32_768
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = ", sequence_id long, offset long"
IDS = ", ids array<int>"


#: How the tokenizer file splits text into the words it merges within; a fixed value of that file.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN_WORD = re.compile(_WORD.replace(r"[\p{L}]", f"[{LETTERS}]").replace(r"[\p{N}]", f"[{NUMBERS}]").replace(r"\p{L}\p{N}", LETTERS + NUMBERS))


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> ChunkCoder:
    """Ids by a ``tokenizers`` file that drops white space, so that what stands between spaces is encoded alone.

    Where the file splits as ``_WORD`` does, plain texts are split here, and each word is encoded once.
    Pieces that begin with a space are what stands between the spaces of other texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    first = (parts["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    by_word = first.get("pattern", {}).get("Regex") == _WORD and [x["type"] for x in parts["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
    specials = [x["content"] for x in parts["added_tokens"]]

    def split(text: str) -> list[str]:
        if by_word and PLAIN.fullmatch(text) and not any(x in text for x in specials):
            return _PLAIN_WORD.findall(text.lower())
        return [" " + x for x in text.replace("\n", " ").split(" ")]

    def ids_of(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_many(pieces: list[str]) -> list[bytes]:
        words = [p for p in pieces if p[0] != " "]
        ids = []
        for at in range(0, len(words), 256):  # many in one call
            part = words[at : at + 256]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            cuts = np.flatnonzero(np.diff(np.asarray(e.word_ids), prepend=-1)).tolist()
            if len(cuts) != len(part):
                ids += ids_of(part)
                continue
            raw = array("I", e.ids).tobytes()
            ids += [raw[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(e)], strict=True)]
        if len(words) == len(pieces):
            return ids
        known, odd = iter(ids), iter(ids_of([p[1:] for p in pieces if p[0] == " "]))
        return [next(odd) if p[0] == " " else next(known) for p in pieces]

    return ChunkCoder(encode_many, split, 300_000)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's token pieces of at most ``capacity`` ids, with the ids themselves where asked for; null text is empty and still has its end id."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer)
        for whole in batches:
            for batch in slices(whole):
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, dtype="<i4"))
                columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
        # the worker goes on to other stages, which need the memory
        coder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES + IDS * with_ids)


class _Open:
    """Lengths that still have pieces, as a bit mask; counts by length."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.tolist()
        self.mask = sum(1 << w for w, c in enumerate(self.n) if c)

    def most(self, limit: int) -> int:
        """The greatest length with pieces that is at most ``limit``, or 0."""
        return (self.mask & ((2 << limit) - 1)).bit_length() - 1 if limit > 0 and self.mask & ((2 << limit) - 1) else 0

    def smallest(self, k: int) -> list[int]:
        """The k least lengths, with repeats; fewer where fewer pieces are left."""
        out, mask = [], self.mask
        while mask and len(out) < k:
            w = (mask & -mask).bit_length() - 1
            out += [w] * min(self.n[w], k - len(out))
            mask &= mask - 1
        return out

    def take(self, w: int, k: int = 1) -> None:
        self.n[w] -= k
        if not self.n[w]:
            self.mask ^= 1 << w

    def put(self, w: int) -> None:
        self.n[w] += 1
        self.mask |= 1 << w


def _longest_pair(items: _Open, room: int) -> tuple[int, int]:
    """The two pieces with the greatest sum that is at most ``room``, longer first; (0, 0) if none."""
    best, w = (0, 0), items.most(room - 1)
    while w and 2 * w >= sum(best):
        items.take(w)
        other = items.most(min(room - w, w))
        items.put(w)
        if other and w + other > sum(best):
            best = (w, other)
        w = items.most(w - 1)
    return best


def _longest_second(items: _Open, room: int) -> int:
    """The greatest length that a pair's shorter piece can have within ``room``."""
    b = items.most(room // 2)
    while b:
        above = items.most(room - b)
        if items.n[b] > 1 or above > b:
            return b
        b = items.most(b - 1)
    return 0


def reduce_dominated(counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The sets of lengths that dominance fixes, with multiplicities, and the counts of what is left."""
    items, fixed = _Open(counts), []
    for j in range(capacity, 0, -1):
        while items.n[j]:
            # what may stand beside one j: all that is open, longer pieces included
            room = capacity - j
            items.take(j)
            k = items.most(room)
            low = items.smallest(3)
            chosen = None
            if not k:
                chosen = (j,)
            elif k == room:
                chosen = (j, k)
            elif len(low) < 2 or low[0] + low[1] > room:
                chosen = (j, k)
            elif len(low) < 3 or sum(low) > room:
                r, s = _longest_pair(items, room)
                if r + s <= k:
                    chosen = (j, k)
                elif r == k and _longest_second(items, room) <= s:
                    # no pair has a longer first piece, nor a longer second one
                    chosen = (j, r, s)
            items.put(j)
            if chosen is None:
                break
            # fewer pieces leave fewer sets that could beat it, so it holds as long as it can be taken
            times = min(items.n[w] // chosen.count(w) for w in chosen)
            fixed.append((chosen, times))
            for w in chosen:
                items.take(w, times)
    return fixed, np.asarray(items.n)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first: sets of lengths with multiplicities. Sequences with the same pieces are one entry."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(held: tuple[int, ...], n: int, room: int) -> None:
        nonlocal mask
        if n:
            by_room[room].append((held, n))
            mask |= 1 << room

    for w in range(capacity, 0, -1):
        left = int(counts[w])
        while left:
            fits = mask >> w
            room = w + (fits & -fits).bit_length() - 1 if fits else capacity
            # a sequence that has taken one is the fullest that can take the next
            most = room // w
            held, n = by_room[room].pop() if fits else ((), -(-left // most))
            if not by_room[room]:
                mask &= ~(1 << room)
            full = min(n, left // most)
            put(held + (w,) * most, full, room - most * w)
            left, n = left - full * most, n - full
            if n and left:
                put(held + (w,) * left, 1, room - left * w)
                left, n = 0, n - 1
            put(held, n, room)
    return [x for xs in by_room for x in xs]


class Places:
    """Where the pieces of each length go: runs of sequences, in the order of the pieces' ranks among those of their length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        fixed, left = reduce_dominated(counts, capacity)
        runs, first = [], 0
        for lengths, times in fixed + best_fit(left, capacity):
            at = 0
            for w in lengths:
                runs.append((w, first, times, at))
                at += w
            first += times
        table = np.asarray(sorted(runs), dtype=np.int64).reshape(-1, 4)
        self.length, self.first, times, self.at = table.T
        total = np.cumsum(times) - times
        new = np.diff(self.length, prepend=0) != 0
        self.rank = total - total[np.flatnonzero(new)][np.cumsum(new) - 1] if len(table) else total

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence (from 0) of each piece and its place there."""
        k = np.searchsorted((self.length << 40) + self.rank, (lengths << 40) + ranks, side="right") - 1
        return self.first[k] + ranks - self.rank[k], self.at[k]


def ranks_of(ordered: np.ndarray) -> np.ndarray:
    """The rank (from 0) of each of some ordered lengths among its equals."""
    return np.arange(len(ordered)) - np.searchsorted(ordered, ordered)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its sequence (from 0) and its place there."""
    lengths = np.asarray(lengths, dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    ranks = np.empty(len(lengths), dtype=np.int64)
    ranks[order] = ranks_of(lengths[order])
    return Places(np.bincount(lengths, minlength=capacity + 1), capacity).of(lengths, ranks)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and before the last two ids, where asked for.

    A null text is an empty document of one id. Repeated rows are packed each; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    cut = pieces(docs, path, capacity, end_id, with_ids)
    cut = written(cut) if with_ids else checkpoint(cut)
    shards = max(1, -(-docs.count() // shard))
    # by the piece's place in the written table, so that rows that repeat an id, or have none, are dealt evenly as well
    cut = cut.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    places = Places(counts, capacity)
    earlier = W.partitionBy("length").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = cut.groupBy("shard", "length").count().select(F.col("shard").alias("of_shard"), F.col("length").alias("of_length"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))

    def pack(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], kind="stable")
        first = np.zeros(capacity + 1, dtype=np.int64)
        first[before["of_length"].to_numpy()] = before["before"].to_numpy()
        length = pdf["length"].to_numpy()
        seq, at = places.of(length, first[length] + ranks_of(length))
        return pdf.assign(sequence_id=seq, offset=at).drop(columns="shard")

    return cut.groupBy("shard").cogroup(before.groupBy("of_shard")).applyInPandas(pack, PIECES + IDS * with_ids + PLACE)


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, shard: int = SHARD // 8) -> DataFrame:
    """sequence_id and ids: the packed sequences themselves, each the ids of its pieces by offset, without padding."""
    placed = best_fit_packing(docs, tokenizer, capacity, end_id, shard, with_ids=True)
    together = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return together.select("sequence_id", F.flatten("parts.ids").alias("ids"))
