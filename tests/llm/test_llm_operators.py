"""Each training-data operator against a brute-force version, a library, a round trip or held-out accuracy, on small tables with odd rows."""

import base64
import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, common, exact_dedup, html_text, jaccard_join, line_dedup, media, packing, quality, queries, substring_dedup, toxicity
from inkwell.llm import words as w
from inkwell.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [(901, None), (902, ""), (903, " \n\t"), (904, "é𝔘漢 ​x" * 3), (905, "x" * 70_000), (906, "a b c"), (907, "a b c")]


def frame(spark, rows, schema=SCHEMA):
    """With columns whose names clash with those the operators use inside, and several partitions."""
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in ("key", "node", "digest", "packed", "line", "n", "label", "shard", "token", "first", "text_hash", "extra", "part", "kept", "__keep", "__digest", "__text", "__id", "t1")})
    return df.repartition(3)


def corpus(seed=5, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)] + ["a", "b", "É"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))] for _ in range(25)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            k = rng.randrange(len(t) + 1)
            t[k:k] = passage[rng.randrange(10) :]
        text = rng.choice([" ", " ", "\n", "  "]).join(t)
        rows.append((i, text.upper() if i % 7 == 0 else text))
    return rows + ODD


@pytest.fixture(scope="module")
def rows():
    return corpus()


# ---- exact dedup -------------------------------------------------------------------------------


@pytest.mark.parametrize("nodes", [1, 4, 40])
def test_exact_dedup(spark, rows, nodes):
    rows = rows + [(2000, "a  bc"), (2001, "ab\tc")]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
    expected = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    got = exact_dedup.exact_dedup(frame(spark, rows), nodes=nodes).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == expected
    assert len(got) == len(rows)
    kept = exact_dedup.deduplicate(frame(spark, rows + rows[:5])).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, e in expected.items() if e[2])


def test_large_groups_of_copies_are_split(spark, rows, monkeypatch):
    expected = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    kept = sorted(r["doc_id"] for r in exact_dedup.deduplicate(frame(spark, rows)).collect())
    monkeypatch.setattr(exact_dedup, "HEAVY", 1)
    assert sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str) == expected
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(frame(spark, rows)).collect()) == kept


def test_exact_dedup_of_partitions_of_several_batches(spark):
    rows = [(i, f"text {i % 13}") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
        kept = exact_dedup.deduplicate(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (i % 13, 5 if i % 13 < 8 else 4) for i in range(60)}
    assert sorted(r["doc_id"] for r in kept) == list(range(13))


def test_exact_dedup_keeps_apart_what_only_shares_a_digest(spark):
    runs = spark.createDataFrame([("ab", 1, 5, 7, 3), ("ab", 2, 5, 9, 4), ("ab", 1, 5, 7, 2)], "digest string, second long, n_bytes long, length long, doc_id long")
    assert sorted((r["best_id"], r["n"]) for r in exact_dedup.merge_tree(runs).collect()) == [(2, 2), (4, 1)]


def test_deduplicate_keeps_texts_that_share_an_id(spark):
    rows = [(1, "a b"), (1, "c"), (1, "c"), (2, "ab"), (2, "d"), (3, "d e"), (3, "de"), (None, "f"), (None, "f"), (None, "g"), (4, "g")]
    kept = exact_dedup.deduplicate(frame(spark, rows)).collect()
    # (2, "ab") is a dropped copy of (1, "a b") though (2, "d") stays
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "f"), (1, "a b"), (1, "c"), (2, "d"), (3, "d e"), (4, "g")]


# ---- packing -----------------------------------------------------------------------------------


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    got = packing.best_fit_packing(frame(spark, rows), capacity=256, shard=64).toPandas()
    for i, t in rows:
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.tolist() == [len(ids[k : k + 256]) for k in range(0, len(ids), 256)]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[k : k + 256].tobytes()) for k in range(0, len(ids), 256)]
        assert own.start.tolist() == list(range(0, len(ids), 256))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        assert s.length.sum() <= 256


def test_packed_sequences_hold_the_ids(spark, rows):
    held = {r["sequence_id"]: np.asarray(r["ids"], dtype="<u4") for r in packing.packed_sequences(frame(spark, rows), capacity=256).collect()}
    placed = packing.best_fit_packing(frame(spark, rows), capacity=256).collect()
    assert sum(map(len, held.values())) == sum(r["length"] for r in placed)
    assert all(zlib.crc32(held[r["sequence_id"]][r["offset"] :][: r["length"]].tobytes()) == r["ids_crc32"] for r in placed)


class Runs:
    """In place of a table: gives the function that its batches would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_word_tables_are_emptied_after_a_task(spark):
    path = packing.tokenizer_path("word_bpe_49k.json")
    coder = packing.word_tokenizer(path)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c", "d e f g"]})
    cut = packing.pieces(Runs(), path)
    for _ in range(2):
        assert [x for b in cut(iter([batch, batch])) for x in b.column("length").to_pylist()] == [4, 5, 4, 5]
        assert not coder.known and not coder.old


def test_prefixes_hold_few_whole_sets():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 4_000).tolist())) for _ in range(190)]
    run = jaccard_join._prefixes(Runs(), np.empty(0, dtype=np.int64), 5, 75)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    try:
        rows = sum(x.num_rows for x in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
    finally:
        tracemalloc.stop()
    assert rows == 190 * (3_996 - 2_997 + 1)
    assert peak < 7


def test_shards_are_packed_together(spark):
    rows = [(i, "a " * n) for i, n in enumerate([13, 5] * 40)]
    got = packing.best_fit_packing(frame(spark, rows), capacity=20, shard=8).toPandas()
    assert got.sequence_id.nunique() == 40
    assert (got.groupby("sequence_id").length.sum() == 20).all()
    assert not got.duplicated(["sequence_id", "offset"]).any()


def test_rows_without_id_are_dealt_evenly(spark):
    got = packing.best_fit_packing(spark.createDataFrame([(None, "a")] * 64, SCHEMA).repartition(4), capacity=20, shard=8)
    assert got.count() == 64
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first() == (20, 7)


def test_best_fit_is_the_one_by_one_rule():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 60))), reverse=True)
        rooms = []
        for n in lengths:
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 20) - n)
        sets = packing.best_fit(np.bincount(lengths, minlength=21), 20)
        assert sorted(20 - sum(s) for s, n in sets for _ in range(n)) == sorted(rooms)
        assert sorted(x for s, n in sets for x in s * n) == sorted(lengths)


def best_packing(lengths, capacity):
    """The least number of sequences, by trying all."""
    best = len(lengths)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            go(k + 1, rooms[:i] + [rooms[i] - lengths[k]] + rooms[i + 1 :])
        go(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_dominance_never_costs_a_sequence():
    rng = random.Random(3)
    for _ in range(150):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))]
        fixed, left = packing.reduce_dominated(np.bincount(lengths, minlength=21), 20)
        remaining = [k for k, c in enumerate(left) for _ in range(c)]
        assert sorted([x for s, n in fixed for x in s * n] + remaining) == sorted(lengths)
        assert all(sum(s) <= 20 for s, _ in fixed)
        assert sum(n for _, n in fixed) + best_packing(remaining, 20) == best_packing(lengths, 20)


def test_packing_is_tight():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 300, 5_000), 2048)
    seq, at = packing.pack_lengths(lengths, 2048)
    assert len(set(seq)) <= -(-lengths.sum() // 2048) + 2
    assert (at + lengths).max() <= 2048


# ---- byte-level BPE ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return bpe._vocabulary(None, None)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(vocabulary, library):
    rng = random.Random(2)
    coder = bpe.piece_encoder(vocabulary)
    texts = [t or "" for _, t in corpus()] + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(32, 0x3000), 32, 10, 39, 0x1F600 + rng.randrange(60)])) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["a  b", " \n x", "x \n", "  ", "it's I'll 'S", "\x1c\x1d a\x85b", "z" * 5000, "<|endoftext|>"]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(t), t
        assert bpe.decode(vocabulary, ids) == t.encode()


def test_prefix_tables_append_and_edit(vocabulary):
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"theanionst \xc3\xa9") for _ in range(rng.randrange(1, 40)))
        cut = rng.randrange(len(data) + 1)
        table = bpe.PrefixTable(vocabulary, data[:cut])
        table.append(data[cut:])
        assert table.ids() == vocabulary.merged(data)
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, len(data) + 1)
        table.edit(a, b, b"ing")
        assert table.ids() == vocabulary.merged(data[:a] + b"ing" + data[b:])


def test_bpe_query(spark, rows, library):
    got = {r["doc_id"]: r for r in bpe.encoding_digests(frame(spark, rows)).collect()}
    for i, t in rows:
        ids = np.asarray(library.encode_ordinary(t or ""), dtype="<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    both = bpe.decode_documents(bpe.encode_documents(frame(spark, rows)))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in both.collect()} == {i: (t or "").encode() for i, t in rows}


# ---- substring dedup ---------------------------------------------------------------------------


def windows_brute(rows):
    first, words = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words[i] = (t or "").encode().split()
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, x in words.items():
        keep = [True] * len(x)
        for k in range(len(x) - 12):
            if first[tuple(x[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        kept = [a for a, b in zip(x, keep, strict=True) if b]
        out[i] = (len(x), len(x) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "heavy", "listed", "chunk"), [(4_000, 500, 1_000_000, 30_000), (2, 500, 1_000_000, 30_000), (2, 1, 0, 50)])
def test_substring_dedup(spark, rows, hot, heavy, listed, chunk, monkeypatch):
    """Also with single windows for most anchors, with copies and anchors split, and in small chunks."""
    for name, value in (("HOT", hot), ("HEAVY", heavy), ("MOST_HOT", listed), ("CHUNK", chunk)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = rows + [(3000, "a " * 40), (3001, "a " * 13), (3002, rows[5][1])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == windows_brute(rows)


def test_substring_dedup_of_rows_without_id_or_with_equal_ids(spark):
    t = " ".join(f"x{k}" for k in range(20))
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, [(None, t), (4, t), (4, t), (4, t + " y"), (5, "q " + t)])).collect())
    assert got == [(-1, 0), (4, 0), (4, 0), (4, 0), (5, 20)]


def test_a_text_of_megabytes_and_a_passage_in_most_documents(spark):
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(40)]
    long = [f"v{rng.randrange(10**6)}" for _ in range(200_000)]
    rows = [(5_000, " ".join([*long, *passage, *long]))] + [(i, " ".join([*(f"u{i}.{k}" for k in range(20)), *passage[i % 3 :]])) for i in range(1, 900)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == windows_brute(rows)


def test_automaton_matches():
    rng = random.Random(6)
    for _ in range(80):
        sequences = [([rng.choice("abc") for _ in range(rng.randrange(3, 12))], rng.randrange(50)) for _ in range(6)]
        automaton = substring_dedup.Automaton()
        for s, d in sequences:
            automaton.add(s, d)
        automaton.finish()
        for q in [s for s, _ in sequences] + [[rng.choice("abcd") for _ in range(9)]]:
            for n in (2, 3, 4):
                expected = [min((d for s, d in sequences if any(s[i : i + n] == q[k : k + n] for i in range(len(s)))), default=None) for k in range(len(q) - n + 1)]
                assert automaton.match(q, n) == expected


# ---- line dedup --------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a == b or a[k + (len(a) == len(b)) :] == b[k + 1 :]


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(8)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 40))) for _ in range(30)]

    def changed(s):
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.randrange(len(s) + 1)
            s = s[:p] + rng.choice("abé ") + s[p + (rng.random() < 0.5) :] if rng.random() < 0.7 else s[:p] + s[p + 1 :]
        return s

    rows = [(i, "\n".join(changed(rng.choice(base)) for _ in range(rng.randrange(0, 8)))) for i in range(70)] + [(200, None), (201, ""), (202, "x" * 3000), (203, "x" * 1500 + "y" + "x" * 1499)]
    expected = lines_brute(spark, rows)
    for listed in (line_dedup.LISTED, 0):
        monkeypatch.setattr(line_dedup, "LISTED", listed)
        got = line_dedup.line_dedup(frame(spark, rows)).collect()
        assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_lines"]) for r in got) == sorted((i, n, n - len(k), k) for (i, _), (n, k) in expected.items())


def test_lines_of_rows_without_id_have_neighbours(spark):
    rows = [(None, "a line of text\nanother one"), (1, "a line of texts\nanother one"), (2, "a line of text"), (3, "anotherr one")]
    got = {r["doc_id"]: r["kept_lines"] for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {None: [0, 1], 1: [], 2: [], 3: []}


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "aaa bbb ccc"), (1, "aaa bbb ccd\nx\nyy zz"), (None, "aaa bbb ccd\nzz"), (None, "q\nzz"), (1, "aaa bbb ccc"), (2, "yy zzz")]
    expected = lines_brute(spark, rows)
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_lines"], r["kept_lines"]) for r in got))) == sorted(str((i, *expected[i, t])) for i, t in rows)
    texts = sorted(map(str, ((r["doc_id"], r["text"]) for r in line_dedup.kept_texts(frame(spark, rows)).collect())))
    assert texts == sorted(str((i, "\n".join(t.split("\n")[k] for k in expected[i, t][1]))) for i, t in rows)


def lines_brute(spark, rows):
    """(id, text): how many lines, and the numbers of those that stay."""
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    known, out = [], {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        own = [(k, x) for k, s in enumerate((t or "").split("\n")) if (x := s.strip(" \t\x0b\x0c\r"))]
        kept = []
        for k, x in own:
            if not any(near(x, y) for y in known):
                kept.append(k)
            known.append(x)
        out[i, t] = (len(own), kept)
    return out


def test_kept_texts(spark):
    rows = [(1, " a line\n\nother\r\nother"), (2, "a lime\nnew one"), (None, None), (3, "")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.kept_texts(frame(spark, rows)).collect()}
    assert got == {1: " a line\n\nother\r", 2: "new one", None: "", 3: ""}


def test_line_dedup_has_no_python(spark):
    plan = line_dedup.line_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---- similarity join ---------------------------------------------------------------------------


def components_brute(rows):
    sets = {}
    for i, t in rows:
        x = (t or "").encode().translate(w.LOWER).split()
        sets[i] = {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if x else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("rounds", [4, 0])
def test_near_duplicates(spark, rows, rounds, monkeypatch):
    """Without leaders every link must be found by the matrix."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == components_brute(rows)


def test_groups_that_few_members_do_not_join(spark, monkeypatch):
    """Chains: groups of which one member alone is similar enough to one of the other group, and borderline texts."""
    monkeypatch.setattr(jaccard_join, "LEADERS", 1)
    rng = random.Random(21)
    rows, k = [], 0
    for _ in range(6):
        t = [f"c{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(25):
            t = list(t)
            for _ in range(rng.choice([1, 1, 2])):
                t[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
            rows.append((k, " ".join(t)))
            k += 1
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == components_brute(rows)


def test_least_hashed_is_the_whole_order(spark):
    df = spark.range(5_000).withColumnRenamed("id", "i")
    expected = [r["i"] for r in df.orderBy(F.xxhash64("i"), "i").limit(300).collect()]
    assert sorted(r["i"] for r in common.least_hashed(df, "i", 300).collect()) == sorted(expected)
    assert common.least_hashed(df.limit(5), "i", 300).count() == 5


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in [*range(50, 80), 100]}


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(w, "STRETCH", 64)
    texts = [(t or "").encode() for _, t in corpus(9)]
    known = {}
    for h, t in zip(w.word_hashes(texts), texts, strict=True):
        assert len(h) == len(t.split())
        for x, y in zip(h.tolist(), t.split(), strict=True):
            assert known.setdefault(y, x) == x
    assert len(set(known.values())) == len(known)


# ---- transport streams -------------------------------------------------------------------------


def test_media_round_trip(spark, rows):
    got = {r["doc_id"]: r for r in media.read_back(media.store(frame(spark, rows))).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = media.pad(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0
        assert "jumps=0;repeated=0;errors=0" in r["feature"]
        assert r["pts"] == [media.TICKS * k for k in range(len(payload) // 576)]
        assert r["access_points"] == list(range(0, len(payload) // 576, 16))
    assert got[906]["media_sha256"] == got[907]["media_sha256"]


def test_timeline(spark):
    r = media.timeline(media.store(spark.createDataFrame([(1, "x" * 10_000)], SCHEMA))).first()
    assert r["unit_bytes"] == [576] * 18
    assert r["pts"] == [media.TICKS * k for k in range(18)]
    assert r["access_points"] == [0, 16]


def test_parser_sees_faults():
    payload = bytes(range(256)) * 9 * 16
    stream = media.write_stream(payload)
    good = media.read_stream(stream)
    assert good.payload == payload
    assert good.access_points == [0, 16, 32, 48]
    assert good.pts[:3] == [0, media.TICKS, 2 * media.TICKS]
    n = media.PACKET
    lost = media.read_stream(stream[: 12 * n] + stream[13 * n :])
    assert lost.discontinuities == 1
    twice = media.read_stream(stream[: 13 * n] + stream[12 * n :])
    assert (twice.repeated, twice.discontinuities, twice.payload) == (1, 0, payload)
    assert media.read_stream(b"\x00" * 376).errors == 2
    assert media.read_stream(stream[: 5 * n + 7]).errors >= 1
    assert media.read_stream(None) == media.read_stream(b"") == media.Stream()


def test_parser_ignores_other_streams():
    payload = b"z" * 5760
    stream = media.write_stream(payload)
    other = bytes([0x47, 0x42, 0x00, 0x10]) + b"\x11" * 184
    mixed = b"".join(stream[k : k + 188] + other for k in range(0, len(stream), 188))
    assert media.read_stream(mixed).payload == payload


# ---- pages -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crf():
    return html_text.trained_model()


def test_held_out_layouts(crf):
    good = total = 0
    for page, truth in html_text.labelled_pages(120, seed=99):
        blocks = html_text.leaf_blocks(page)
        gold = html_text.label_blocks(blocks, truth)
        total += len(gold)
        good += sum(a == b for a, b in zip(crf.decode(blocks), gold, strict=True))
    assert good / total > 0.97


def test_viterbi_is_the_best_labelling(crf):
    from itertools import product

    for page, _ in html_text.labelled_pages(12, seed=5):
        blocks = html_text.leaf_blocks(page)[:10]
        s = crf.scores(blocks)
        value = lambda y: sum(s[i][k] for i, k in enumerate(y)) + sum(crf.steps[a][b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert value(crf.decode(blocks)) == pytest.approx(max(map(value, product((0, 1), repeat=len(blocks)))))


PAGE = """<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<!-- x --><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  one,
goes on.<br><p>Second &eacute;&nbsp;one.</p><ul><li>item</ul></article><section class="comments"><p>Nice.</p></section><form>Name <input></form><footer>&copy; me</footer></body></html>"""


def test_page_text(crf):
    assert html_text.main_text(PAGE, crf) == "A & B\nFirst one, goes on.\nSecond é one.\nitem"
    assert html_text.main_text(None, crf) == html_text.main_text("", crf) == html_text.main_text("<script>x", crf) == ""


WRITTEN = [
    # a blog with a sidebar to the left and a date under the heading
    (
        """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>On bread | A blog</title><link rel="stylesheet" href="/s.css"></head><body>
<div id="top"><a href="/">A blog</a> <a href="/about">About</a></div><div class="sidebar"><h3>Archive</h3><ul><li><a href="/1">January</a></li><li><a href="/2">February</a></li></ul></div>
<div id="content"><h1>On bread</h1><p>Bread is flour, water, salt and time, and most of the work is done by the last of them while you sleep.</p>
<p>The dough should feel soft &ndash; not wet &ndash; when it leaves the bowl, and it should come back slowly when you press it with a finger.</p></div>
<div class="footer">Copyright 2024. All rights reserved. <a href="/imprint">Imprint</a></div></body></html>""",
        "On bread\nBread is flour, water, salt and time, and most of the work is done by the last of them while you sleep.\nThe dough should feel soft – not wet – when it leaves the bowl, and it should come back slowly when you press it with a finger.",
    ),
    # news with header and nav elements, an advert inside the article, a quotation and comments
    (
        """<html><head><title>News</title><style>.a{color:red}</style></head><body><header><nav><a href="/w">World</a><a href="/s">Sport</a></nav></header><main><article>
<h1>River reaches its highest level in ten years</h1><p>The river rose by two metres during the night, and the town has closed both of its bridges to all traffic until further notice.</p>
<div class="advertisement"><a href="//x">Shop now and save</a></div><blockquote><p>We have not seen this much water since the dam was built, said the mayor on Tuesday morning.</p></blockquote>
<p>Schools will stay closed on Wednesday, and the council asks people to keep away from the banks of the river.</p></article></main>
<section id="comments"><h3>Comments</h3><p>First!</p><p>Stay safe everyone.</p></section><footer><p>Contact us</p></footer><script>track("x");</script></body></html>""",
        "River reaches its highest level in ten years\nThe river rose by two metres during the night, and the town has closed both of its bridges to all traffic until further notice.\nWe have not seen this much water since the dam was built, said the mayor on Tuesday morning.\nSchools will stay closed on Wednesday, and the council asks people to keep away from the banks of the river.",
    ),
    # documentation with a list, code and a cookie notice, without end tags of p and li
    (
        """<html><head><title>Manual</title></head><body><div class="cookie-notice">We use cookies. <button>Accept</button></div><nav class="menu"><ul><li><a href="#a">Install<li><a href="#b">Use</ul></nav>
<article><h2>Installing the tool</h2><p>Download the archive for your system, check its signature, and unpack it into a folder of your choice.
<ul><li>On a server the folder must be readable by the service account.<li>On a laptop your home folder will do.</ul><pre>tool --init
tool --check</pre><p>The second command prints a line for every problem that it finds &amp; how to mend it.</article>
<form action="/q"><label>Search</label><input name="q"></form></body></html>""",
        "Installing the tool\nDownload the archive for your system, check its signature, and unpack it into a folder of your choice.\nOn a server the folder must be readable by the service account.\nOn a laptop your home folder will do.\ntool --init tool --check\nThe second command prints a line for every problem that it finds & how to mend it.",
    ),
    # nothing but a menu and a form
    ("""<html><body><nav><a href="/">Home</a><a href="/l">Login</a></nav><form><input name="u"><input name="p"><button>Send</button></form><footer>&copy; 2024</footer></body></html>""", ""),
]


@pytest.mark.parametrize("k", range(len(WRITTEN)))
def test_written_pages(crf, k):
    assert html_text.main_text(WRITTEN[k][0], crf) == WRITTEN[k][1]


def test_pages_without_end_tags(crf):
    assert html_text.main_text(PAGE.replace("</head>", ""), crf) == html_text.main_text(PAGE, crf)
    assert html_text.main_text(PAGE.replace("</head><body>", ""), crf) == html_text.main_text(PAGE, crf)
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    assert texts("<head><title>x</title>Bare text<p>b") == ["Bare text", "b"]
    for tag in ("select", "video", "audio", "object", "canvas", "template", "svg", "math"):
        assert texts(f"<article><p>a</p><{tag}><p>b</p></article><p>c")[-2:] == ["b", "c"], tag
    for tag in ("select", "video", "audio", "object", "canvas", "template"):
        assert texts(f"<p>a</p><{tag}><p>b</p></{tag}><p>c") == ["a", "c"], tag


def test_formulas_and_drawings_have_text():
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    formula = '<math><semantics><mrow><mi>x</mi><mspace width="1"/><mo>=</mo><mn>1</mn></mrow><annotation encoding="t">x &gt; y</annotation></semantics></math>'
    assert texts(f"<p>Let {formula} hold.</p><p>b") == ["Let x=1 hold.", "b"]
    assert texts('<svg><path d="m"/><g><text>Axis</text></g></svg><p>b') == ["Axis", "b"]


def test_pages_query(spark, crf):
    df = frame(spark, [(1, "u", PAGE), (2, None, None), (3, "v", "<"), (3, "v", "<")], "page_id long, url string, html string")
    got = html_text.extract(df, crf).collect()
    assert len(got) == 4
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    query = queries.op9_html(spark, SF)
    assert query.columns == ["page_id", "url", "text", "n_chars"]
    assert query.where("n_chars > 0").count() >= 45


# ---- classifiers -------------------------------------------------------------------------------


def accuracy(spark, scored, label, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    joined = scored.where("held_out").join(labels, "doc_id").select("score", "predicted", label).toPandas()
    rank = joined.score.rank()
    ones = joined[label] == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    return auc, (joined.predicted == joined[label]).mean()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op2_quality(spark, sf)
    auc, right = accuracy(spark, scored, "quality", sf)
    assert auc > 0.98
    assert right > 0.96


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op10_toxicity(spark, sf).cache()
    auc, right = accuracy(spark, scored, "toxic", sf)
    assert auc > 0.95
    assert right > 0.94
    cell = {(r["toxic"], r["predicted"]): r["count"] for r in scored.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert cell[1, 1] / (cell[1, 1] + cell[0, 1]) > 0.7
    assert cell[1, 1] / (cell[1, 1] + cell[1, 0]) > 0.9


def test_ridge_is_the_closed_form_over_all_rows(spark):
    """The normal equations, summed by partition, against one solution over the rows together."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.repartition(5), labels)
    chosen = {r["__id"]: r["label"] for r in quality.labelled_sample(labels, "quality", 3, 1, 10**6).collect()}
    kept_back = {r["i"] for r in spark.createDataFrame([(i,) for i in chosen], "i long").where(F.pmod(F.xxhash64("i", F.lit(quality.SEED)), F.lit(5)) == 0).collect()}
    x = {r["doc_id"]: quality.statistics(r["text"] or "") for r in docs.collect() if r["doc_id"] in chosen}
    every = np.array([x[i] for i in x])
    std = every.std(axis=0)
    z = lambda ids: quality.fourier((np.array([x[i] for i in ids]) - every.mean(axis=0)) / np.where(std > 0, std, 1), model.w, model.b)
    train = [i for i in x if i not in kept_back]
    a, y = z(train), np.array([chosen[i] for i in train], dtype=float)
    beta = np.linalg.solve(a.T @ a + quality.RIDGE * len(x) * np.eye(a.shape[1]), a.T @ y)
    assert np.allclose(z(list(x)) @ beta, model.raw(every), atol=1e-5)


def test_risk_estimator_reaches_the_least_risk():
    """Against a search over all weights of one feature, where the corrected risk is plain to write down."""
    positive, unlabelled = toxicity.Sparse([[0]] * 80 + [[]] * 20), toxicity.Sparse([[0]] * 150 + [[]] * 850)
    prior = 0.15

    def risk(w, b):
        loss = lambda f: np.log1p(np.exp(-f))
        on, off = w + b, b
        p_plus, p_minus = 0.8 * loss(on) + 0.2 * loss(off), 0.8 * loss(-on) + 0.2 * loss(-off)
        return prior * p_plus + max(0.0, 0.15 * loss(-on) + 0.85 * loss(-off) - prior * p_minus)

    w, b = toxicity.fit_nnpu(positive, unlabelled, 1, prior, steps=2_000)
    grid = min(risk(x, y) for x in np.arange(-2, 9, 0.1) for y in np.arange(-6, 2, 0.1))
    assert risk(w[0], b) < grid + 0.01


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_odd_rows_and_without_labels(spark, module, label):
    docs = frame(spark, [*ODD, (None, "x"), (906, "a b c")])
    labels = spark.createDataFrame([], f"doc_id long, {label} int")
    out = module.score(docs, module.fit(docs, labels)).collect()
    assert len(out) == len(ODD) + 2
    assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    empty = frame(spark, [])
    assert module.score(empty, module.fit(empty, labels)).count() == 0


def test_held_out_rows_do_not_matter(spark):
    """Other labels on held-out rows give the same scores."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_scores(docs, x).orderBy("doc_id").toPandas().score for x in (labels, turned))
    assert np.allclose(a, b)


def test_isotonic_values_never_fall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    at, value = quality.isotonic(x, (rng.random(300) < 1 / (1 + np.exp(-x))).astype(float))
    assert (np.diff(at) > 0).all()
    assert (np.diff(value) >= 0).all()


def test_risk_estimator_finds_the_feature():
    rng = np.random.default_rng(1)
    positive = toxicity.Sparse([[0, int(rng.integers(1, 20))] for _ in range(200)])
    unlabelled = toxicity.Sparse([([0] if rng.random() < 0.1 else []) + [int(rng.integers(1, 20))] for _ in range(2000)])
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 20, 0.1)
    assert weights[0] > 3
    assert weights[0] + bias > 0 > bias


# ---- tables without rows, and the registry -------------------------------------------------------


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, exact_dedup.deduplicate, packing.best_fit_packing, bpe.encoding_digests, substring_dedup.substring_dedup, line_dedup.line_dedup, jaccard_join.near_duplicates, lambda d: media.read_back(media.store(d))])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


REPEATED = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f g")]


@pytest.mark.parametrize(
    ("run", "columns", "expected"),
    [
        (exact_dedup.exact_dedup, ("doc_id", "keep_id", "group_size", "kept"), [(None, 1, 3, False), (None, None, 1, True), (1, 1, 3, True), (1, 1, 3, True), (2, 2, 1, True)]),
        (packing.best_fit_packing, ("doc_id", "piece", "start", "length"), [(None, 0, 0, 7), (None, 0, 0, 1), (1, 0, 0, 7), (1, 0, 0, 7), (2, 0, 0, 8)]),
        (bpe.encoding_digests, ("doc_id", "n_tokens"), [(None, 6), (None, 0), (1, 6), (1, 6), (2, 7)]),
        (substring_dedup.substring_dedup, ("doc_id", "n_words", "n_removed"), [(None, 6, 0), (None, 0, 0), (1, 6, 0), (1, 6, 0), (2, 7, 0)]),
        (line_dedup.line_dedup, ("doc_id", "n_lines", "n_removed", "kept_lines"), [(None, 1, 0, [0]), (None, 0, 0, []), (1, 1, 1, []), (1, 1, 1, []), (2, 1, 0, [0])]),
        (jaccard_join.near_duplicates, ("doc_id", "n_shingles", "component_id"), [(None, 2, 1), (None, 0, None), (1, 2, 1), (1, 2, 1), (2, 3, 2)]),
        (lambda d: media.read_back(media.store(d)), ("doc_id", "n_bytes", "payload_bytes"), [(None, 11, 576), (None, 0, 576), (1, 11, 576), (1, 11, 576), (2, 13, 576)]),
    ],
)
def test_rows_without_id_and_repeated_rows(spark, run, columns, expected):
    out = run(frame(spark, REPEATED)).select(*columns).collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(str, r)) for r in c.sql(queries.ORACLE_SQL[name]).project(", ".join(columns)).fetchall())


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
