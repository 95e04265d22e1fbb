"""Shared helpers of the training-data operators: scratch space, Arrow batches and fast token lookup."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that one step of a Python operator holds at once.
SLICE_BYTES = 4 << 20


#: glibc's malloc_trim, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else what the context has. Where neither is set a temporary one serves in local mode; on a cluster that is an error."""
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
    if own.isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder. For tables of a few numbers per row; Spark removes the files when they are not used any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again. For larger tables; the files stay."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a key from which they are dealt to ``PARTS`` tasks, and such keys at most; beyond these, keys have fewer rows than the last of them.
HEAVY, PARTS, MOST_HEAVY = 500, 64, 2_000


def least_hashed(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the least hash of a column. Rows far beyond them are left out first, so that no task gets n rows from every partition."""
    total = rows.count()
    if total > 4 * n:
        rows = rows.where(F.xxhash64(column) < F.lit((2 * n << 64) // total - (1 << 63)))
    return rows.orderBy(F.xxhash64(column), column).limit(n)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts add up to ``most`` bytes; a longer text stands alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and the next stage needs it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class ChunkCoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, looked up piece by piece.

    ``split`` cuts a text into pieces, ``encode_many`` gives the ids of pieces not seen yet. A full
    table becomes the old one, from which pieces that come again are moved back: at most ``limit``
    pieces and a batch's are held twice, and frequent ones stay.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]], limit: int = 200_000):
        self.encode_many, self.split, self.limit = encode_many, split, limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        parts = [self.split(t) for t in texts]
        known, old = self.known, self.old
        new = set().union(*parts).difference(known) if parts else set()
        if new:
            known.update((c, old[c]) for c in new & old.keys())
            if pieces := [c for c in new if c not in old]:
                known.update(zip(pieces, self.encode_many(pieces), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def forget(self) -> None:
        """Empty the tables and return their memory to the system."""
        self.known, self.old = {}, {}
        give_back()


def _of(kind: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(33, 0x250) if unicodedata.category(chr(c))[0] == kind)


#: Classes of the letters and the numbers below U+0250, for Python's ``re``, which is twice as fast as ``regex`` with \\p{L}.
LETTERS, NUMBERS = _of("L"), _of("N")
#: Texts to which those classes apply: no rarer spaces or controls, and no letter whose lower case is two.
PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u012f\u0131-\u024f]*")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file; ``folder`` overrides where it is looked for."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
