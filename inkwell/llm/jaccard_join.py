"""Exact similarity join on word shingles by a token-group matrix.

A document's tokens are the hashes of its distinct 5-word shingles. Equal sets are one node from the
first step on. Similar nodes are put into groups, the matrix holds which tokens occur in which group,
and a node is compared with the members of a group only if the group's tokens can hold enough of its
own.

Groups: nodes that share a pair of min-hashes are compared with a few leaders among them, which gives a
bounded number of comparisons per node; verified links join nodes into groups. Thousands of near copies become one
group here without being paired with each other, and groups are only ever joined by verified links.

Matrix: in a total order of all tokens, two sets with Jaccard similarity t have a common token among
their first n - ceil(t n) + 1 (the prefix), so the matrix needs the prefixes alone. The order puts tokens
that are frequent in a sample of the texts last, so that passages in many documents do not make them
candidates. A token in one node only is dropped in the partition it is dealt to, one in a single group
after the groups are known. Tokens that several nodes of a slice share are known to be shared there
and then: their rows are dealt at random, and only one witness of them goes by the token. Joins by a
token, node or component that many rows have rest on Spark's own splitting of skewed partitions.

Bound: if a node's last token in common with a member, within the prefixes, is its i-th, and c of the
first i are in the group, the two have no more in common than c and what the shorter one has behind.
Groups whose greatest bound over the matches falls short are not opened. In an opened group the node is
held against each member by sketches (the parity of the number of tokens in each of some classes),
which bound the symmetric difference from below; what remains is verified on the texts.

Links between groups and within them give the components, by large and small stars.
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

from inkwell.llm.common import checkpoint, slices, text_or_empty, written
from inkwell.llm.components import connected_components
from inkwell.llm.words import LOWER, mix, shingle_hashes, word_hashes

WORDS = 5
#: Similarity of a link, in hundredths.
SIMILAR = 75
#: Min-hashes by which leaders are found, and leaders of a bucket. More of them only save work later.
ROUNDS, LEADERS = 4, 8
#: Frequent tokens that are put last in the order, at most (8 MB); one text in so many is looked at for them, and in so many of these a token must be.
FREQUENT, SAMPLED, OFTEN = 1 << 20, 32, 3
#: Nodes of a group that are compared at once with as many others.
BLOCK = 1_000
#: Size of the filter that goes to the scan of the texts: 8 MB.
FILTER_BITS = 1 << 26
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], dtype=np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, 62 bits wide, A-Z lower-cased."""
    return [np.unique(shingle_hashes(h, words) >> np.uint64(2)).astype(np.int64) for h in word_hashes([t.translate(LOWER) for t in texts])]


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _node(tokens: np.ndarray) -> int:
    return _hash(tokens.tobytes())


def _minima(tokens: np.ndarray) -> list[int]:
    """Hashes of pairs of min-hashes: two sets agree in one with the square of their similarity."""
    least = np.array([mix(tokens.view(np.uint64) ^ x).min() for x in _SALTS[:ROUNDS]], dtype=np.uint64)
    return mix(least + np.uint64(3) * np.roll(least, 1)).view(np.int64).tolist()


def _sketch(tokens: np.ndarray) -> bytes:
    """A bit per class of tokens, set if their number is odd, for at least twice as many classes as tokens, a power of two."""
    bits = 1 << max(7, (2 * len(tokens) - 1).bit_length())
    return np.packbits(np.bincount(tokens & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """How many classes two sketches differ in: no more than the tokens that only one of the sets has."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_BASE = "doc_id long, text_hash long, node long, n long, minima array<long>, sketch binary"


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """For each document the hash of its text, its node (the set's hash), set size, min-hashes and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                sets = shingle_sets(texts, words)
                minima = [_minima(s) if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(_hash, texts), pa.int64()), pa.array(map(_node, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(minima, pa.list_(pa.int64())), pa.array([_sketch(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "text_hash", "node", "n", "minima", "sketch"])

    return docs.mapInArrow(run, _BASE)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The tokens that are most frequent in a sample of the texts, sorted; only the order of tokens depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                chosen = {h: t for t in batch.column("text").cast(pa.binary()).to_pylist() if (h := _hash(t)) % SAMPLED == 0}
                sets = [s for s in shingle_sets(list(chosen.values()), words) if len(s)]
                if sets:
                    token, times = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(times, pa.int64())], ["token", "times"])

    counts = docs.mapInArrow(run, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    counts = checkpoint(counts.withColumn("step", F.floor(8 * F.log2("times")).cast("int")))
    # from which step on there are few enough, by the number of tokens of every step
    room, least = FREQUENT, None
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    if least is None:
        return np.empty(0, dtype=np.int64)
    return np.sort(counts.where(F.col("step") >= least).select("token").toArrow().column("token").to_numpy())


def _filter(hashes: DataFrame) -> np.ndarray:
    """A bit for the low bits of each hash, in a table of ``FILTER_BITS``: of fixed size, whatever the input. Bits are gathered by 64 before they come here."""
    at = F.col("text_hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.select(F.shiftright(at, 6).cast("int").alias("place"), bit.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, dtype="<i8")
    out[found.column("place").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _packed(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """text_hash, packed: the texts whose hash may be wanted, compressed; of copies in a partition one."""
    spread = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, bits = zstandard.ZstdCompressor(level=3), spread.value
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                found = {}
                for t in batch.column("text").cast(pa.binary()).to_pylist():
                    h = _hash(t)
                    at = h & (FILTER_BITS - 1)
                    if bits[at >> 3] >> (at & 7) & 1 and h not in seen:
                        seen.add(h)
                        found[h] = t
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([zip_.compress(t) for t in found.values()], pa.binary())], ["text_hash", "packed"])

    return docs.mapInArrow(run, "text_hash long, packed binary")


def _possible(pairs: DataFrame, similar: int, schema: str) -> DataFrame:
    """The pairs whose sketches do not differ in more places than sets so similar can."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("u_sketch", "v_sketch", "u_n", "v_n")), strict=True)
            keep = [(100 + similar) * differing(a, b) <= (100 - similar) * (n + m) for a, b, n, m in rows]
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    return pairs.select(*columns, "u_sketch", "v_sketch", "u_n", "v_n").mapInArrow(run, schema)


def _opened(asking: DataFrame, members: DataFrame, sketches: DataFrame, similar: int) -> DataFrame:
    """The pairs (u, v) of a node that asks for a group and a member of it whose sketches and sizes allow a link.

    Both sides of a group are split into blocks of about ``BLOCK`` nodes, and each pair of blocks is one
    piece of work: no task holds more than two blocks, and only pairs that pass leave it.
    """
    parts = lambda side, name: side.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    split = parts(asking, "u_parts").join(parts(members, "v_parts"), "grp")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(split, "grp").join(sketches, "node").withColumn("u_part", part("u_parts")).withColumn("v_part", every("v_parts")).select(*[F.col(c).alias(c) for c in ("grp", "u_part", "v_part")], *[F.col(c).alias(f"u_{c}") for c in ("node", "n", "sketch")])
    right = members.join(split, "grp").join(sketches, "node").withColumn("v_part", part("v_parts")).withColumn("u_part", every("u_parts")).select(*[F.col(c).alias(c) for c in ("grp", "u_part", "v_part")], *[F.col(c).alias(f"v_{c}") for c in ("node", "n", "sketch")])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        classes: dict[int, list[int]] = {}
        rows = b.column("v_sketch").to_pylist()
        for k, x in enumerate(rows):
            classes.setdefault(len(x), []).append(k)
        size, name = b.column("v_n").to_numpy(), b.column("v_node").to_numpy()
        blocks = {w: (np.frombuffer(b"".join(rows[k] for k in ks), dtype=np.uint8).reshape(len(ks), w), np.array(ks)) for w, ks in classes.items()}
        us, vs = [], []
        for u, n, sketch in zip(*(a.column(c).to_pylist() for c in ("u_node", "u_n", "u_sketch")), strict=True):
            own = np.frombuffer(sketch, dtype=np.uint8).reshape(1, -1)
            for block, ks in blocks.values():
                m = size[ks]
                keep = (100 * n >= similar * m) & (100 * m >= similar * n)
                if not keep.any():
                    continue
                x, y = own, block[keep]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                near = ks[keep][(100 + similar) * apart <= (100 - similar) * (n + m[keep])]
                us.append(np.full(len(near), u))
                vs.append(name[near])
        return pa.table({"u": pa.array(np.concatenate(us) if us else [], pa.int64()), "v": pa.array(np.concatenate(vs) if vs else [], pa.int64())})

    keys = ["grp", "u_part", "v_part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similar: int) -> DataFrame:
    """The pairs (u, v) of nodes whose texts' sets are similar enough; ``nodes`` has n, sketch and text_hash of each node.

    Pairs whose sketches differ in more places than sets so similar can are dropped first. Texts that no pair needs stay where they are: a filter of fixed size, in which every hash that is
    wanted has its bit, goes to the scan. Where it is full it lets all texts pass, and the join decides.
    """
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("text_hash").alias(f"{end}_text"), F.col("sketch").alias(f"{end}_sketch"), F.col("n").alias(f"{end}_n")), end)

    pairs = checkpoint(_possible(pairs, similar, "u long, v long, u_text long, v_text long"))
    wanted = pairs.select(F.col("u_text").alias("text_hash")).unionByName(pairs.select(F.col("v_text").alias("text_hash"))).distinct()
    texts = _packed(docs, _filter(wanted)).dropDuplicates(["text_hash"])
    both = pairs.join(texts.select(F.col("text_hash").alias("v_text"), F.col("packed").alias("b")), "v_text").join(texts.select(F.col("text_hash").alias("u_text"), F.col("packed").alias("a")), "u_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        recent: dict[int, np.ndarray] = {}

        def tokens(node: int, data: bytes) -> np.ndarray:
            got = recent.get(node)
            if got is None:
                if len(recent) >= 64:
                    recent.pop(next(iter(recent)))
                got = recent[node] = shingle_sets([unzip.decompress(data)], words)[0]
            return got

        for batch in batches:
            for part in slices(batch, "a", 1 << 20):
                keep = []
                for u, v, a, b in zip(*(part.column(c).to_pylist() for c in ("u", "v", "a", "b")), strict=True):
                    x, y = tokens(u, a), tokens(v, b)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= similar * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v")], ["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _prefixes(docs: DataFrame, frequent: np.ndarray, words: int, similar: int) -> DataFrame:
    """key, token, node, at: the prefix of every set in the order that has frequent tokens last.

    ``at`` has the set's size in its upper half and the place (from 1) in its lower. The key is the token
    and the token null, but for tokens that are shared within the slice: these rows have a random key,
    and one witness of them, whose ``at`` is -1, has the token as its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, most=8 << 20):
                rows = []
                # whole sets are held for a part of the slice only, of the others the prefixes
                for s in (s for part in slices(batch, most=1 << 20) for s in shingle_sets(part.column("text").cast(pa.binary()).to_pylist(), words)):
                    k = _node(s)
                    if not len(s) or k in seen:
                        continue
                    seen.add(k)
                    size = len(s)
                    p = size - -(-similar * size // 100) + 1
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        s = np.sort(s | ((frequent[at] == s).astype(np.int64) << np.int64(62)))
                    rows.append((s[:p].copy(), k, size))
                if not rows:
                    continue
                count = np.array([len(r[0]) for r in rows])
                token = np.concatenate([r[0] for r in rows])
                node = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), count)
                size = np.repeat(np.array([r[2] for r in rows], dtype=np.int64), count)
                place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count) + 1
                _, first, back, times = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
                shared = times[back] > 1
                key = np.where(shared, mix(token.view(np.uint64) ^ mix(node.view(np.uint64))).view(np.int64), token)
                w = first[times > 1]
                columns = [np.concatenate(x) for x in ((key, token[w]), (token, token[w]), (node, node[w]), (size << 32 | place, np.full(len(w), -1)))]
                given = np.concatenate([~shared, np.ones(len(w), dtype=bool)])
                yield pa.RecordBatch.from_arrays([pa.array(x, mask=given if k == 1 else None) for k, x in enumerate(columns)], ["key", "token", "node", "at"])

    return docs.mapInArrow(run, "key long, token long, node long, at long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Null and empty texts have no shingles and are linked with nothing: their component is their own id.
    Rows that repeat an id each have the component of their own text; a null id is never a component's.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = written(_profile(docs, words))
    frequent = _frequent(docs, words)
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("sketch").alias("sketch"))
    by_hash = nodes.select("node", "n", F.posexplode("minima").alias("round", "hash"))
    # a bucket's leaders are the least nodes of its parts, so that few members are like none of them
    leaders = by_hash.groupBy("round", "hash", F.pmod(F.xxhash64("node"), F.lit(LEADERS)).alias("part")).agg(F.min(F.struct("node", "n")).alias("leader"))
    fits = lambda a, b: (F.lit(100) * a >= F.lit(similar) * b) & (F.lit(100) * b >= F.lit(similar) * a)
    led = by_hash.join(leaders, ["round", "hash"]).where(F.col("node") > F.col("leader.node")).where(fits(F.col("n"), F.col("leader.n")))
    links = checkpoint(verified(checkpoint(led.select(F.col("node").alias("u"), F.col("leader.node").alias("v")).distinct()), nodes, docs, words, similar))
    groups = connected_components(links).withColumnRenamed("component", "grp")

    # the matrix: prefix tokens of more than one node, then of more than one group
    key, in_order = W.partitionBy("key"), W.partitionBy("key").orderBy("node")
    prefixes = _prefixes(docs, frequent, words, similar).withColumns({"before": F.lag("node").over(in_order), "lo": F.min("node").over(key), "hi": F.max("node").over(key)})
    shared = prefixes.where("at >= 0 AND (token IS NOT NULL OR lo < hi) AND NOT node <=> before")
    shared = shared.select(F.coalesce("token", "key").alias("token"), "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place"))
    grouped = written(shared.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node")))
    several = grouped.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    cells = written(grouped.join(several, "token", "left_semi"))
    alone = cells.groupBy("grp").agg(F.min("node").alias("member"), F.max("node").alias("other")).select("grp", F.when(F.col("member") == F.col("other"), F.col("member")).alias("only"))
    matrix = cells.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("room")).join(alone, "grp")

    def possible(common, n, m):
        """Whether sets of n and m members with at most so many in common can be similar enough."""
        return F.lit(100 + similar) * common >= F.lit(similar) * (n + m)

    q = cells.select("token", "node", "n", "place", F.col("grp").alias("own"))
    met = q.join(matrix, "token").where("own > grp").where((F.lit(100) * F.col("most") >= F.lit(similar) * F.col("n")) & (F.lit(100) * F.col("n") >= F.lit(similar) * F.col("least")))
    # a member whose last match is this one has no more in common than the matches so far and what either has behind it
    met = met.withColumn("c", F.row_number().over(W.partitionBy("node", "grp").orderBy("place")))
    hits = met.groupBy("node", "grp").agg(F.first("only").alias("only"), F.first("n").alias("n"), F.min("least").alias("least"), F.max(F.col("c") + F.least(F.col("n") - F.col("place"), F.col("room"))).alias("common"))
    opened = checkpoint(hits.where(possible(F.col("common"), F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * similar / 100)))).select("node", "grp", "only"))
    # a group of one node is opened by now; of the others each member that has a token of the matrix is held against the node by its sketch
    pairs = _opened(opened.where("only IS NULL").select("grp", "node"), cells.select("grp", "node").distinct(), nodes.select("node", "n", "sketch"), similar)
    pairs = pairs.unionByName(opened.where("only IS NOT NULL").select(F.col("node").alias("u"), F.col("only").alias("v")))
    more = verified(pairs, nodes, docs, words, similar)
    components = connected_components(links.unionByName(more))

    known = nodes.select("node", "doc_id").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = known.join(least, "component").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
