"""A large group of near copies joins by a few pairs for each member."""

import itertools
import random

from pyspark.sql import functions as F

from tablemill.llm import ngram


def test_cloud_of_near_copies(spark, monkeypatch):
    """Copies with tails of 4 to 9 words of their own: a pair links when both tails have 13 words or fewer."""
    rng = random.Random(3)
    body = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*body, *(f"t{i}x{k}" for k in range(rng.randint(4, 9)))])) for i in range(160)]
    rows += [(1000 + i, f"quite another text number {i} with words of its own n{i}") for i in range(20)]
    sets = {i: set(ngram.shingles(t, 4).tolist()) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)

    monkeypatch.setattr(ngram, "FEW_PAIRS", 30, raising=False)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in ngram.linked_components(docs).collect()}
    assert got == {i: root(i) for i in sets}


def test_trials_take_few_pairs_and_find_the_near_ones(spark):
    """600 sets of one signature in 200 groups of equal maps: a trial joins most of them by few pairs each."""
    rng = random.Random(5)
    maps = [[rng.getrandbits(63), rng.getrandbits(63)] for _ in range(200)]
    rows = [("s", i, True, i, 600, 100, maps[i % 200]) for i in range(600)]
    frame = spark.createDataFrame(rows, "sig string, id long, own boolean, comp long, rows long, n long, m array<long>")
    pairs = {(r.a, r.b) for r in ngram.neighbours(frame, 0, 85).collect()}
    assert all(a < b and a % 200 == b % 200 for a, b in pairs)  # other maps rule out a link
    assert len(pairs) >= 380  # two for each group, but where other groups have the same bits
    assert len(pairs) < len(rows)


def test_words_by_bytes():
    """Only A-Z is lowered and only ASCII white space parts words, whatever else Unicode calls so."""
    same = [("ÀB c d e", "Àb C D E"), ("a\x0bb\x0cc d e", "A b C\td\re")]
    for x, y in same:
        assert ngram.shingles(x, 4).tolist() == ngram.shingles(y, 4).tolist()
    other = [("À b c d", "à b c d"), ("a\x85b c d e", "a b c d e"), ("a\x1cb c d e", "a b c d e"), ("a\xa0b c d e", "a b c d e")]
    for x, y in other:
        assert ngram.shingles(x, 4).tolist() != ngram.shingles(y, 4).tolist()
    assert len(ngram.shingles("a b a b a b a b", 4)) == 2
