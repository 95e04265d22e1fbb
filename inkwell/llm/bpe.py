"""Byte-level BPE by prefix dynamic programming.

Of the segmentations of a byte string into tokens exactly one is what the merges by rank would give,
and every prefix of an encoded string is encoded by the tokens that end there. So it is enough to store
for each prefix its one valid last token: the token t that ends at i is valid if the last token p of the
prefix before t and t form a valid pair, that is, if encoding their joined bytes gives (p, t) again.
Following the last tokens back from the end gives the ids. What a prefix holds depends on nothing
behind it, so one table serves all strings: a string that shares a beginning with an earlier one starts
there. Appending bytes leaves what is stored as it is; after an edit only the prefixes behind the edit
are computed again, which ``PrefixTable`` offers.

Whether a pair is valid is found by undoing merges: the two tokens are split back, latest merge first,
and the pair is invalid as soon as a merge across the seam would have come before the one undone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import LETTERS, NUMBERS, PLAIN, ChunkCoder, slices, text_or_empty, tokenizer_path

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


#: Entries that a worker's lookup tables hold at most before they are emptied, and bytes of a string whose prefixes are shared.
LIMIT, SHARED = 150_000, 64


class Vocabulary:
    """Ranks of byte strings, with what the pair test needs: the two tokens each token was merged from."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        #: The last token of every byte prefix met so far.
        self.last: dict[bytes, int] = {}
        #: Lengths of tokens by their last three bytes.
        sizes: dict[bytes, set[int]] = {}
        for t in ranks:
            sizes.setdefault(t[-3:], set()).add(len(t))
        self.sizes = {k: tuple(sorted(v | {i for i in range(1, len(k)) if k[-i:] in ranks}, reverse=True)) for k, v in sizes.items()}
        #: Tokens that their own bytes are not encoded as.
        self.broken: set[int] = set()
        self.halves = functools.lru_cache(maxsize=None)(self._halves)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, data: bytes) -> list[int]:
        """Ids by repeated merging of the lowest rank: the definition, used to split tokens and in tests."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens the last merge of this token joined; None for a single byte."""
        data = self.tokens[token]
        if len(data) == 1:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b != data)
            if rank == 1 << 60:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def valid(self, left: int, right: int) -> bool:
        """Whether the ids (left, right) stay apart, as they are, when their bytes are encoded together."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self.pairs[left << 32 | right] = self._valid(left, right)
        return known

    def _valid(self, left: int, right: int) -> bool:
        limit = 1 << 60
        while True:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right])
            if rank is not None and rank < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            # undo the later merge of the two, and keep the side at the seam; the left one would come first among equals
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token alone; a few tokens of a rank file are not."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(self.tokens[token]) == [token]
            if not known:
                self.broken.add(token)
        return known

    def last_token(self, data: bytes, end: int, last: Callable[[int], int]) -> int:
        """The valid last token of data[:end]; ``last`` gives that of shorter prefixes, by their length."""
        ranks, pairs = self.ranks, self.pairs
        for size in self.sizes.get(data[max(0, end - 3) : end]) or self._sizes(data[max(0, end - 3) : end]):
            if size > end:
                continue
            token = ranks.get(data[end - size : end])
            if token is None or token in self.broken:
                continue
            if size == end:
                if self.whole(token):
                    return token
                continue
            left = last(end - size)
            known = pairs.get(left << 32 | token)
            if (self.valid(left, token) if known is None else known) and self.whole(token):
                return token
        raise ValueError("a byte has no token")

    def _sizes(self, tail: bytes) -> tuple[int, ...]:
        """The lengths of tokens at the end of a tail that no longer token has, greatest first."""
        if len(self.sizes) > LIMIT:
            return tuple(k for k in range(len(tail), 0, -1) if tail[-k:] in self.ranks)
        found = self.sizes[tail] = tuple(k for k in range(len(tail), 0, -1) if tail[-k:] in self.ranks)
        return found

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern: itself where it is a token, else by the last tokens of its prefixes."""
        ranks, n = self.ranks, len(data)
        if (token := ranks.get(data)) is not None:
            return [token]
        if n > SHARED:  # its prefixes would fill the table; none of them is likely to come again
            return PrefixTable(self, data).ids()
        last, sizes, pairs, broken = self.last, self.sizes, self.pairs, self.broken
        if len(last) > LIMIT:
            last.clear()
        if len(pairs) > LIMIT:
            pairs.clear()
        k = n - 1
        while k and data[:k] not in last:
            k -= 1
        for end in range(k + 1, n + 1):
            tail = data[end - 3 : end] if end > 2 else data[:end]
            for size in sizes.get(tail) or self._sizes(tail):
                # the same test as in last_token, without its calls
                start = end - size
                if start < 0 or (token := ranks.get(data[start:end])) is None or token in broken:
                    continue
                if start:
                    left = last[data[:start]]
                    known = pairs.get(left << 32 | token)
                    if not (self.valid(left, token) if known is None else known):
                        continue
                if self.whole(token):
                    last[data[:end]] = token
                    break
            else:
                raise ValueError("a byte has no token")
        out = []
        while n:
            out.append(last[data[:n]])
            n -= len(self.tokens[out[-1]])
        return out[::-1]


class PrefixTable:
    """The last token of every prefix of one byte string; prefixes are only ever added or cut off."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes; the prefixes already stored stay valid."""
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.v.last_token(self.data, end, self.last.__getitem__))

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; only prefixes longer than ``start`` are computed again."""
        tail = self.data[stop:]
        del self.last[start + 1 :]
        self.data = self.data[:start]
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.v.tokens[out[-1]])
        return out[::-1]


_PLAIN_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\\s{L}{N}]+|\\s+(?!\\S)|\\s+".replace("{L}", LETTERS).replace("{N}", NUMBERS)


@functools.lru_cache(maxsize=4)
def piece_encoder(v: Vocabulary) -> ChunkCoder:
    """Encodes texts by the matches of the pattern, each of which is encoded by itself, once."""
    import public_tokenizers

    plain = re.compile(_PLAIN_PATTERN).findall if v.pattern.pattern == public_tokenizers.PATTERN else None
    split = lambda text: plain(text) if plain and PLAIN.fullmatch(text) else v.pattern.findall(text)
    return ChunkCoder(lambda pieces: [array("I", v.encode(p.encode())).tobytes() for p in pieces], split, LIMIT)


def decode(v: Vocabulary, ids: bytes) -> bytes:
    return b"".join(map(v.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str | None, pattern: str | None) -> Vocabulary:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return Vocabulary.from_file(path or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids binary (little-endian unsigned 32-bit). A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(_vocabulary(path, pattern))
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(coder.encode(batch.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path, pattern)
        for whole in batches:
            for batch in slices(whole, "ids"):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array([decode(v, x) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded again.

    Both ways in one pass, so that the ids stay in the worker. Null is empty; repeated rows each have theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(path, pattern)
        coder = piece_encoder(v)
        for whole in batches:
            for batch in slices(whole):
                n, ids_hash, text_hash = [], [], []
                for ids in coder.encode(batch.column("text").to_pylist()):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(decode(v, ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ENCODED)
