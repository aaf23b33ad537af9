"""Vector codes, periodic runs and token files against brute force and on awkward rows."""

import dataclasses
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tablemill.llm import periodic, queries, tokenfiles, vectorcodes  # noqa: E402
from tablemill.session import fresh_folder  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ROWS = "vec_id long, embedding array<float>, label int, codes string, trees string"


# --- vector codes ---


def codes_by_hand(rows, parts, entries, rounds):
    """The contract word by word: rows are (id, integer components), sorted."""
    width = len(rows[0][1]) // parts
    cut = np.array([v for _, v in rows], dtype=np.int64).reshape(len(rows), parts, width)
    books = cut[:entries].swapaxes(0, 1).copy()
    for turn in range(rounds + 1):
        gap = ((cut[:, :, None, :] - books[None]) ** 2).sum(3)
        near = gap.argmin(2)
        if turn == rounds:
            return near.tolist(), gap.min(2).sum(1).tolist(), books
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = cut[near[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(x) // len(mine) for x in mine.sum(0)]


@pytest.mark.parametrize("n,width,spread", [(700, 8, 0.1), (300, 16, 30.0), (40, 8, 0.01), (5, 4, 1.0)])
def test_codes_equal_brute_force(spark, n, width, spread):
    rng = np.random.default_rng(n)
    centers = rng.normal(0, spread, (9, width))
    vectors = (centers[rng.integers(0, 9, n)] + rng.normal(0, spread / 8, (n, width))).astype(np.float32)
    vectors[n // 2 :: 7] = vectors[0]  # copies
    ids = rng.permutation(3 * n)[:n].tolist()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>").repartition(5)
    found, books = vectorcodes.compress(table, "vec_id", "embedding", parts=4, entries=16)
    rows = sorted((i, [math.floor(float(x) * 256) for x in v]) for i, v in zip(ids, vectors))
    near, error, want = codes_by_hand(rows, 4, 16, 2)
    got = {r.vec_id: (r.codes, r.error) for r in found.collect()}
    assert np.array_equal(books.entries, want)
    assert got == {i: (c, e) for (i, _), c, e in zip(rows, near, error)}


def test_tree_prunes_and_owns_whole_balls():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-9, 9, (900, 4)) + c for c in (0, 500, -700)])
    tree = vectorcodes.grow(points)
    assert tree.count[0] == len(points) and (tree.total[0] == points.sum(0)).all()
    for b in range(len(tree.count)):
        inside = tree.points[tree.start[b] : tree.end[b]]
        assert np.sqrt(((inside - tree.center[b]) ** 2).sum(1)).max() <= tree.radius[b] * (1 + 1e-9) + 1e-9
    entries = np.array([[0] * 4, [500] * 4, [-700] * 4, [0] * 4])
    blind = dataclasses.replace(tree, points=np.full_like(tree.points, 10**6))  # each ball is one entry's, so no point is looked at
    nearest, sums, counts = vectorcodes.own(blind, entries)
    assert counts.tolist() == [900, 900, 900, 0]
    assert (nearest[tree.place] == np.repeat([0, 1, 2], 900)).all() and (sums[:3] == points.reshape(3, 900, 4).sum(1)).all()


def test_codes_of_awkward_rows(spark):
    good = [0.5, -0.25, 0.001, -0.001]
    rows = [(1, good, 1, "x", "y"), (2, None, 1, "x", "y"), (3, [0.5, None, 1.0, 1.0], 1, "x", "y"), (4, [float("nan")] * 4, 1, "x", "y"), (5, [float("inf")] * 4, 1, "x", "y"),
            (6, [], None, "x", "y"), (7, [1.0, 2.0], 1, "x", "y"), (None, good, None, "x", "y"), (1, good, 1, "x", "y"), (8, [3e38, 0.0, 0.0, 0.0], None, "x", "y")]
    table = spark.createDataFrame(rows, ROWS)
    found, books = vectorcodes.compress(table, "vec_id", "embedding", ["label"], parts=2)
    got = found.collect()
    # four usable rows: equal parts share the entry with the lowest index
    assert sorted((r.vec_id is None, r.vec_id, r.label, r.codes) for r in got if r.vec_id is not None) == [(False, 1, 1, [0, 0]), (False, 1, 1, [0, 0]), (False, 8, None, [2, 2])]
    assert [r.codes for r in got if r.vec_id is None] == [[0, 0]] and all(r.error == 0 for r in got)
    assert books.entries[0].tolist() == [[128, -64], [128, -64], [vectorcodes.LIMIT, 0], [128, -64]] and books.entries[1][0].tolist() == [0, -1]
    empty, none = vectorcodes.compress(table.limit(0), "vec_id", "embedding", ["label"])
    assert empty.count() == 0 and none.entries.size == 0 and empty.columns == ["vec_id", "label", "codes", "error"]
    with pytest.raises(ValueError):
        vectorcodes.compress(table, "vec_id", "embedding", parts=3)


# --- periodic runs ---


def runs_by_hand(words):
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                out.setdefault((i, j + q), q)  # a smaller period came first
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng, seen = np.random.default_rng(11), 0
    for _ in range(2500):
        n, kinds = int(rng.integers(0, 130)), int(rng.integers(1, 7))
        codes = rng.integers(0, kinds, n)
        for _ in range(int(rng.integers(0, 4))):
            a, p, stop = (int(x) for x in (rng.integers(0, n + 1), rng.integers(1, 16), rng.integers(5, 70)))
            for i in range(a + p, min(n, a + stop)):
                codes[i] = codes[i - p]
        words = [b"%d" % c for c in codes]
        want = runs_by_hand(words)
        seen += len(want)
        assert periodic.periodic_runs(words) == want
    assert seen > 500


def test_segments_hold_all_runs_and_every_word_twice():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3000, 5000)
    codes[1000:1300] = np.resize(codes[1000:1040], 300)
    found = periodic.segments(codes)
    assert any(a <= 1000 and b >= 1300 for a, b in found)
    assert all(np.unique(codes[a:b], return_counts=True)[1].min() >= 2 for a, b in found)
    assert sum(b - a for a, b in found) < 5000


def test_long_texts_of_few_words():
    assert periodic.periodic_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    words = [b"%d" % (i % 70_000) for i in range(150_000)]
    assert periodic.periodic_runs(words) == [(0, 150_000, 70_000)]


def test_collapse(spark):
    tail = "x y z " * 5
    rows = [(1, None, "p", "q"), (1, "", "p", "q"), (2, "one two\x1fthree", "p", "q"), (None, "head " + tail + "end", "p", "q"), (None, "head " + tail + "end", "p", "q"), (3, "a b c d e f", "p", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, __loop string").drop("__loop")
    docs = docs.withColumn("again", F.when(F.col("doc_id") == 3, F.struct(F.lit(2).cast("long").alias("start"), F.lit(1).cast("long").alias("period"))))
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(docs, "text", "again").collect()}
    assert got[1, None] == ([], "") and got[1, ""] == ([], "")
    assert got[2, rows[2][1]] == ([], rows[2][1])  # other white space does not part words
    assert got[None, rows[3][1]] == ([(1, 15, 3)], "head x y z end")
    assert got[3, "a b c d e f"] == ([], "a b c c c c")
    assert periodic.collapse(docs, "text").count() == len(rows) and periodic.collapse(docs.limit(0), "text").count() == 0
    assert periodic.collapse(docs, "text").columns == ["doc_id", "text", "again", "runs", "collapsed"]


# --- token files ---


def whole(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(BPE)
    return [known.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_cut_texts_give_the_ids_of_whole_texts(spark):
    rng = np.random.default_rng(2)
    signs = ["a", "Zebra", "é", "ß", "7", "_", " ", "  ", "\n", "\t", " ", " ", "\x1f", "'s", "'", "don't", ".", "—", "日本", "🙂", "<|endoftext|>", "\r\n", "́", "१२", "x" * 40, "'ll", "(", ")", ",", ".\n", "\u0301", "\x85", "\u2003", "µ", "ª", "Ɐ", "ʼn", "-", "\n\n"]
    texts = ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(0, 40))) for _ in range(3000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = tokenfiles.Pieces(BPE, "<u2")
    assert words.cut
    assert [np.frombuffer(words.encode(t), "<u2").tolist() for t in texts] == [i[:-1] for i in whole(texts)]
    assert not tokenfiles.Pieces(public_tokenizers.path("word_bpe_49k.json"), "<u2").cut


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 70_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, n) for _ in range(2))
    made = tokenfiles.perfect_hash(a, b)
    assert np.array_equal(np.sort(made.slots(a, b)), np.arange(n))
    assert len(made.bits) * 8 <= 64 * 8 + 5 * n  # a few bits a key
    other = made.slots(b, a)
    assert ((other >= -1) & (other < max(n, 1))).all()
    with pytest.raises(ValueError):
        tokenfiles.perfect_hash(np.zeros(2, np.int64), np.zeros(2, np.int64))


def test_token_files_round_trip(spark):
    texts = ["plain text", None, "", "word " * 30_000, "same", "same", "other"] + [f"text number {i} of many" for i in range(400)]
    ids = [7, 3, None, 5, 9, 9, 9] + [100 + i for i in range(400)]
    rows = list(zip(ids, texts)) + [(50, f"hot {i}") for i in range(300)] + [(None, "second null")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string").coalesce(3)
    folder = fresh_folder(spark, "tokens")
    tokenfiles.write(docs, folder, BPE, shard_bytes=4000, bucket_keys=100)
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.count() > 5
    # the payload files behind each other are all documents in order
    data = b"".join(tokenfiles.store(folder)[0].open_input_file(f"{tokenfiles.store(folder)[1]}/ids-{r.shard:05d}.bin").read() for r in manifest.orderBy("shard").collect())
    kept = np.frombuffer(data, "<u2").tolist()
    keys = tokenfiles.keys_of(docs)
    assert keys.count() == len(rows)
    places = tokenfiles.lookup(folder, keys, turn="turn")
    got = tokenfiles.checksums(folder, tokenfiles.fetch(folder, places)).collect()
    at = 0
    for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.turn)):
        assert r.start == at and kept[at : at + r.n] == r.ids and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n
    assert at == len(kept)
    sets = lambda pairs: sorted((k is None, k or 0, i) for k, i in pairs)
    assert sets((r.doc_id, r.ids) for r in got) == sets(zip([r[0] for r in rows], whole([r[1] for r in rows])))
    missing = spark.createDataFrame([(10_000 + i, "x") for i in range(500)], "doc_id long, start string")
    absent = tokenfiles.fetch(folder, tokenfiles.lookup(folder, missing)).collect()
    assert len(absent) == 500 and all(r.shard is None and r.start is None and r.ids is None for r in absent)


def test_token_files_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = fresh_folder(spark, "tokens")
    tokenfiles.write(docs, folder, BPE)
    some = spark.createDataFrame([(1,)], "doc_id long")
    assert [tuple(r) for r in tokenfiles.lookup(folder, some).collect()] == [(1, None, None, None, None)]
    assert tokenfiles.checksums(folder, tokenfiles.lookup(folder, some)).first().ids_crc32 is None


def test_token_query_equals_whole_encoding(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op13_tokenfiles(spark, folder).collect()}
    at, want = 0, {}
    for r, ids in zip(docs, whole([r.text for r in docs])):
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
