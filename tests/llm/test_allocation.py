"""Cost-based allocation of the n-gram join: no link is lost, shared passages make no candidates."""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tablemill.llm import ngram  # noqa: E402


def pairs(rng, sizes, percent):
    """Sets of the given sizes with partners as unlike as a link allows."""
    for n in sizes:
        pool = rng.integers(0, 2**63, 2 * n + 2).astype(np.uint64)
        differ = n * (100 - percent) // percent
        drop = int(rng.integers(0, differ + 1))
        a, b = np.unique(pool[:n]), np.unique(pool[drop : n + int(rng.integers(0, differ - drop + 1))])
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common):
            yield tuple(sorted((a, b), key=len))


def test_units_spent_find_every_link():
    """Whatever the signatures cost: the set that looks finds its partner, and both keep an equal segment."""
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        bands = ngram.Bands(percent)
        for small, large in pairs(rng, rng.integers(1, 300, 2000), percent):
            band = bands.of(len(small))
            if not band.differ:
                assert len(small) == len(large)
                continue
            cost = {}
            sides = []
            for s in (small, large):
                sigs, tags = ngram.segments(s, band)
                tags = np.broadcast_to(tags, len(sigs))
                for g in sigs:
                    cost.setdefault(int(g), (int(rng.integers(1, 50)), int(rng.integers(0, 50))))
                sides.append((sigs.tolist(), tags.tolist()))
            if band.deletions:
                for one, two in (sides, sides[::-1]):
                    spent = ngram.units(one[1], *zip(*(cost[g] for g in one[0])))
                    assert sum({(-1 - t) >> 3: u for t, u in zip(one[1], spent)}.values()) >= band.differ + 1
                    gone = lambda t: ((-1 - t) >> 2) & 1
                    assert any(g == h and gone(t) + gone(k) <= 1 and u > gone(t) + gone(k) for g, t, u in zip(*one, spent) for h, k in zip(*two))
            else:
                kept = [set(sorted(g, key=lambda x: (-cost[x][0], x))[t[0] :]) for g, t in sides]
                assert kept[0] & kept[1]


def test_units_are_cheapest():
    """Against all allocations of up to six segments."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(200):
        parts, spare = int(rng.integers(1, 7)), int(rng.integers(2, 4))
        rows = [(-1 - ((p << 3) | (4 * d) | spare), int(rng.integers(1, 9)), int(rng.integers(0, 9))) for p in range(parts) for d in (0, 1, 1)]

        def price(given):
            total = 0
            for tag, w, d in rows:
                u, gone = given[(-1 - tag) >> 3], ((-1 - tag) >> 2) & 1  # noqa: B023
                total += (w if u == 2 else 0) if gone else ((w - 1) * (u > 0) + d * (u == 2))
            return total

        spent = ngram.units(*zip(*rows))
        got = {(-1 - r[0]) >> 3: u for r, u in zip(rows, spent)}
        allowed = [g for g in itertools.product((0, 1, 2), repeat=parts) if sum(g) >= 2 * parts - spare]
        assert price(got) == min(price(dict(enumerate(g))) for g in allowed)


def test_a_passage_of_many_unlike_documents_makes_no_candidates(spark):
    """Half of each text is the same; every twentieth document has a near copy."""
    passage = " ".join(f"shared{i}" for i in range(60))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(i, f"{passage} {own(i)}") for i in range(3000)]
    rows += [(10_000 + i, f"{passage} {own(i)} end") for i in range(0, 3000, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram.sets(docs, "doc_id", "text", 4, 85)
    signed = ngram.index(found)
    counts = signed.groupBy("sig").agg(F.count("*").alias("whole"))
    shared = signed.join(counts.filter("whole > 1"), "sig").withColumns({"short": F.lit(0).cast("long"), "lead": F.lit(0).cast("long"), "parted": F.lit(False)})
    kept = ngram.allocated(shared, docs.filter("false").select(F.col("doc_id").alias("id")))
    assert shared.filter("whole > 100").count() > 2 * len(rows)
    assert kept.groupBy("sig").count().filter("count > 10").count() == 0
    got = {r.id: r.component_id for r in ngram.linked_components(docs).collect()}
    assert got == {i: i - 10_000 if i >= 10_000 else i for i, _ in rows}


def test_equal_sets_of_a_task_are_signed_once(spark):
    """Copies carry no signatures of their own, yet all are linked, under repeated and null ids too."""
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text) for i in range(40, 0, -1)] + [(41, text + " end"), (41, "other words of one id " * 3), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    signed = ngram.sets(docs, "doc_id", "text", 4, 85)
    assert signed.filter("id < 41 and size(own) > 0").count() == 1
    assert signed.filter("n > 0").count() == 43 and signed.filter("id is null and size(own) > 0").count() == 0
    got = {r.id: r.component_id for r in ngram.linked_components(docs).collect()}
    assert got == {None: None, **{i: 1 for i in range(1, 42)}}
