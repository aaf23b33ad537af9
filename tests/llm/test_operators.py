"""The operators against brute force and on awkward rows: nulls, empty texts and tables, repeated rows, clashing columns."""

import pickle
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tablemill.llm import decontam, extraction, langid, lattice, mixing, ngram, pii, queries, sharding, toxicity, warc  # noqa: E402
from tablemill.llm.common import components, spread_join  # noqa: E402
from tablemill.session import fresh_folder  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, taken string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, equal and repeated documents, with columns that operators add themselves."""
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "one two three four five six", "en", None, 27), (4, "one two three four five six", "en", "b", 27),
            (4, "one two three four five six", "en", "b", 27), (None, "seven eight nine", "en", "b", 16), (5, long, "la", "b", len(long)), (6, "123 456", None, "c", 7)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 50), (7, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "a", "b").collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_spread_join_keeps_all_rows(spark):
    rows = spark.range(9000).withColumn("k", F.when(F.col("id") < 6000, 0).otherwise(F.col("id") % 50))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert spread_join(rows, groups, "k", "n", ["id"]).select("id").distinct().count() == 9000


def test_apportionment_equals_highest_quotients(spark):
    weights = [("a", 53.0), ("b", 24.0), ("c", 23.0), ("d", 0.0), ("e", 0.4)]
    for seats in (0, 1, 7, 100):
        table = spark.createDataFrame([(0, k, w, seats) for k, w in weights], "g int, k string, w double, s int")
        got = {r.k: r.quota for r in mixing.apportion(table, ["g"], "k", "w", "s").collect()}
        claims = sorted((-w / (2 * j - 1), k) for k, w in weights if w for j in range(1, seats + 1))[:seats]
        assert got == {k: sum(c[1] == k for c in claims) for k, _ in weights}


def test_mix(spark, odd):
    docs = odd.withColumn("size", queries.word_count("text"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert rows == mixing.mix(docs).collect()
    assert mixing.mix(docs.limit(0)).count() == 0
    sums = {}
    for r in rows:
        sums.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= max(16, 0.02 * t) for t, n in sums.values())
    emitted = corpus_pipeline.mix_sources(spark, odd, FOLDER)
    assert emitted.columns == odd.columns
    assert emitted.agg(F.sum(queries.word_count("text"))).first()[0] == sum(r.taken for r in rows)


def test_mix_of_sources_thin_in_every_shard(spark):
    rows = [(i, "big", 100) for i in range(4000)] + [(5000 + i, "short", 5) for i in range(100)] + [(6000 + i, "some", 20) for i in range(60)] + [(7000 + i, "short", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for cap in (3.0, 2.5):
        got = mixing.mix(docs, cap=cap, rows_per_shard=8)
        assert got.count() == len(rows)
        for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
            assert abs(r.taken - r.target) <= 16, (cap, r)
    cut = got.filter("source = 'short' and try_mod(taken, size) > 0").count()
    assert cut <= 2 * 13


def test_shards(spark, odd):
    many = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.range(300).select(F.lit(1).cast("long"), F.lit("t")))
    rows = sharding.shuffle_shards(many, ["doc_id", "text"], rows_per_block=100).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, sizes.values())) == [162] * 1 + [163] * 7 if 1303 % 8 == 7 else max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    assert len({r.shard for r in rows if r.doc_id == 1}) == 8  # equal rows are spread as well
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shuffle_shards(many, ["doc_id", "text"], rows_per_block=100).collect()))
    assert sharding.shuffle_shards(odd, ["doc_id", "text"]).count() == 8 and sharding.shuffle_shards(odd.limit(0), ["doc_id"]).count() == 0


def test_large_hypergeometric_numbers():
    rng = np.random.default_rng(1)
    draws = [sharding.draw(rng, 4 * 10**9, 6 * 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(draws) - 400_000) < 500 and 200 < np.std(draws) < 800


def test_warc_round_trip(spark):
    body = "<html>" + "x" * 200
    pages = spark.createDataFrame([(3, "u 1\n", body), (1, None, body), (2, "u", None), (None, "n", body), (4, "ü", "<p>ä"), (1, None, body)], "page_id long, url string, html string")
    folder = fresh_folder(spark, "warc")
    manifest = warc.write(warc.records(pages), folder, shard_bytes=300, file_bytes=700)
    got = sorted(((r.key, r.uri, r.record_type, r.refers_to, bytes(r.payload).decode() if r.payload is not None else None, r.payload_bytes) for r in warc.read(spark, folder).collect()), key=str)
    n = len(body)
    assert got == sorted([(3, "u 1\n", "revisit", 1, None, n), (1, None, "response", None, body, n), (1, None, "response", None, body, n),
                          (2, "u", "response", None, "", 0), (None, "n", "revisit", 1, None, n), (4, "ü", "response", None, "<p>ä", 5)], key=str)
    again = fresh_folder(spark, "warc")
    other = warc.write(warc.records(pages.repartition(5)), again, shard_bytes=300, file_bytes=700)
    assert sorted(r.digest for r in manifest.collect()) == sorted(r.digest for r in other.collect()) and manifest.count() > 1
    empty = fresh_folder(spark, "warc")
    warc.write(warc.records(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def test_viterbi_and_its_shortcut_agree():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = -rng.exponential(2.0, size=(rng.integers(1, 30), 3))
        path = langid.viterbi([s], 4.0)[0]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value([k] * len(s)) for k in range(3))
        assert value(path) >= best - 1e-9
        one, stays = langid.constant_path(s, np.zeros(len(s), np.int64), 1, 4.0)
        assert not stays[0] or abs(value(path) - value([one[0]] * len(s))) < 1e-9


def test_language(spark, odd):
    found = queries.op4_language(spark, FOLDER).filter("held_out").join(queries.table(spark, FOLDER, "documents").select("doc_id", "lang"), "doc_id")
    right, total = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.95 * total
    train = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate([("the house and the garden were green", "en"), ("das haus und der garten waren gruen", "de"), ("дом и сад были зелёные", "ru")])], "doc_id long, text string, lang string")
    model = langid.train(train)
    texts = spark.createDataFrame([("the house was green and the garden too das haus war und der garten auch",), ("дом и сад",), (None,), ("12 !",), ("漢字",)], "text string")
    rows = texts.select(langid.language(spark, "text", model, penalty=2.0).alias("r")).collect()
    assert [s.lang for s in rows[0].r.spans] == ["en", "de"] and rows[1].r.lang == "ru"
    assert rows[2].r.lang == rows[3].r.lang == "und" and rows[2].r.score == 0
    nothing = langid.train(train.limit(0))
    assert odd.select(langid.language(spark, "text", nothing).alias("r")).filter("r.lang <> 'und'").count() == 0
    assert corpus_pipeline.language(spark, odd, FOLDER).columns == odd.columns


def jaccard_components(docs, words, percent):
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    up = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if v in (a, b) else v for k, v in up.items()}
    return {i: (len(s), up[i]) for i, s in sets.items()}


def test_ngram_join_finds_every_link(spark):
    rng = np.random.default_rng(9)
    texts = []
    for n in (1, 2, 3, 4, 6, 9, 12, 18, 25, 40, 70, 120):
        base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        for k in range(6):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.integers(0, n)] = f"z{rng.integers(0, 100)}"
            texts.append(" ".join(copy + ["Tail"] * (k % 2)))
    docs = spark.createDataFrame(list(enumerate([*texts, None, ""])), "doc_id long, text string")
    for words, percent in ((4, 85), (1, 60)):
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram.linked_components(docs, words=words, percent=percent).collect()}
        assert got == jaccard_components(docs, words, percent)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(2)
    bands = ngram.Bands(85)
    for _ in range(3000):
        n = int(rng.integers(1, 150))
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[(k := int(rng.integers(0, n // 6 + 1))) : n + int(rng.integers(0, n // 6 + 1))])
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            small, large = sorted((a, b), key=len)
            band = bands.of(len(small))
            assert len(np.intersect1d(ngram.signatures(small, band), ngram.signatures(large, band))), (n, k)


def test_lattice_points_are_nearest():
    x = np.random.default_rng(3).normal(size=(200, 8)) * 2
    point = lattice.nearest_e8(x)
    near = ((x - point) ** 2).sum(1)
    for v in lattice.minimal_vectors():
        assert (near <= ((x - point - v) ** 2).sum(1) + 1e-12).all()


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    rows = [(i, [float(x) for x in base[i % 60] + rng.normal(size=24) * 0.12]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, rows[0][1]), (1005, [1e-200] * 3), (1006, [2e-200] * 3), (None, rows[1][1])]
    vectors = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, kept string")
    got = {r.vec_id: r for r in lattice.near_duplicates(vectors).collect()}
    x = lattice.unit(np.array([r[1] for r in rows[:400]]))
    links = (x @ x.T >= 0.9).sum() - 400
    found = sum(got[i].n_links for i in range(400))
    assert found >= 0.9 * links
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1004))
    assert got[1004].component_id == 0 and got[1005].component_id == got[1006].component_id == 1005
    assert lattice.near_duplicates(vectors.limit(0)).count() == 0


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "One, two three four five six"), (2, None), (None, "seven eight"), (3, "..."), (1, "one TWO three four five six")], "item_id long, text string")
    rows = {r.doc_id: r.overlap for r in decontam.overlaps(odd, items).collect()}
    assert rows[3].n_words == 6 and [tuple(x) for x in rows[3].ranges] == [(0, 6)] and rows[3]["items"] == ["1"]
    assert rows[1].n_words == 0 and rows[None].ranges and rows[None]["items"] == [] and not rows[5].ranges
    split = decontam.overlaps(odd, items, block_bytes=20)
    assert {r.doc_id: r.overlap for r in split.collect()} == rows
    assert decontam.overlaps(odd, items.limit(0)).filter(F.size("overlap.ranges") > 0).count() == 0
    assert decontam.overlaps(odd.limit(0), items).count() == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_holds_the_base_spans(spark, odd):
    rng = np.random.default_rng(8)
    alphabet = list("0123456789" * 3 + "+@@..- ab(")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, size=rng.integers(0, 80)))
        assert [s for s in pii.find(text) if s[1] < 4] == base_spans(text), text
    assert [(pii.KINDS[k]) for _, k, _ in pii.find("IBAN DE89 3704 0044 0532 0130 00, see ftp://me:pw@host/x")] == ["account", "url"]
    assert odd.select(F.size(pii.pii_spans("text"))).count() == 8


def test_extraction(spark):
    page = ('<html><body><nav><a href=x>Home</a></nav><div class="cookie notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b>\ttext, long enough.'
            '<p>Second block of text.<script>var a="</p>";</script></article><div class="comments"><p>A reader says something.</p></div><footer>end</footer>')
    pages = queries.table(spark, FOLDER, "pages")
    trees = extraction.train(pages, limit=60)
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div"), (5, "<p>" * 3000 + "x")], "page_id long, html string")
    got = {r.page_id: r.text for r in rows.select("page_id", extraction.main_text(spark, "html", trees).alias("text")).collect()}
    assert got[1] == "Title & more\nFirst bold text, long enough.\nSecond block of text." and got[2] == got[3] == got[4] == ""
    assert extraction.train(pages.limit(0)) is None
    for r in pages.select("html", extraction.main_text(spark, "html", trees).alias("text")).limit(40).collect():
        root = extraction.parse(r.html)
        nodes = extraction.preorder(root)
        extraction.mark(nodes)
        assert r.text == extraction.kept_text(nodes, [n.label == 1 for n in nodes])


def test_parse_keeps_what_follows_drawings_and_formulas():
    def whole(page):
        nodes = extraction.preorder(extraction.parse(page))
        return extraction.kept_text(nodes, [True] * len(nodes))

    assert whole('<article><p>one <svg class="icon" />two</p><p>three <math/>four</p></article>') == "one two\nthree four"
    assert whole("<p>a<svg><svg><title/><path d='M0'/></svg><style/><desc>no</desc></svg> b</p>c") == "a b\nc"
    assert whole("<p>a<template><template><p>no</p></template><p>no</p></template>b</p><p>c") == "ab\nc"
    assert whole("<p>x <math><mi>y</mi><annotation>no</annotation></math> <noscript>z</noscript></p>") == "x y z"
    assert whole("<div>a <select><option>no</select>b</div><div><select><option>no</div>c<script>no</script>") == "a b\nc"


def test_toxicity(spark, odd):
    docs = spark.createDataFrame([(i, f"some words here {i % 7} you {'idiot' if i % 5 == 0 else 'friend'} number") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("label")).filter("doc_id < 200")
    index = toxicity.learn(docs, labels)
    rows = {r.doc_id: r.r for r in docs.select("doc_id", toxicity.toxicity(spark, "text", index).alias("r")).collect()}
    assert all((r.score >= 0.7) == (i % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    assert rows[0].evidence and "idiot" in rows[0].terms
    dense = np.zeros((len(index.vocabulary), len(index.labels)))
    term = np.searchsorted(index.cuts[:, -1], np.arange(len(index.at)), "right")
    dense[term, index.at] = index.weight
    q = np.arange(len(index.vocabulary))
    w = np.linspace(1, 2, len(q)) / np.linalg.norm(np.linspace(1, 2, len(q)))
    _, cos = index.nearest(q, w, 10)
    assert np.allclose(cos, np.sort(w @ dense)[::-1][:10])
    assert odd.select(toxicity.toxicity(spark, "text", index)["score"].alias("s")).filter("s is null").count() == 0
    none = toxicity.learn(docs.limit(0), labels.limit(0))
    assert docs.select(toxicity.toxicity(spark, "text", none)["score"].alias("s")).filter("s <> 0").count() == 0


def test_pipeline_stages(spark, odd):
    docs = queries.table(spark, FOLDER, "documents")
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    want = {i for i, (_, c) in jaccard_components(docs, 5, 80).items() if c == i}
    assert {r.doc_id for r in kept.collect()} == want
    clean = corpus_pipeline.decontaminate(spark, odd, FOLDER)
    assert clean.count() == 8 and clean.columns == odd.columns
    assert corpus_pipeline.near_duplicates(spark, odd, FOLDER).select("doc_id").collect().count((4,)) == 0


def test_parity_maps_rule_out_no_link(spark):
    rng = np.random.default_rng(12)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 90)).astype(np.uint64)]))
        band = ngram.band_of(min(len(a), len(b)), 80)
        maps = [ngram.parities(s, band) for s in (a, b)]
        for one, two in zip(*maps):
            assert sum(int(x).bit_count() for x in (one ^ two).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_toxicity_counts_rare_words(spark):
    """One toxic word in 200 examples, others in four each; no text is judged without its words."""
    toxic = ["idiot"] * 200 + [f"vile{c}" for c in "abcdefghij" for _ in range(4)]
    rows = [(i, f"a text of number{i % 97} with {w} said", 1) for i, w in enumerate(toxic)]
    rows += [(1000 + i, f"a text of number{i % 97} with kind{i % 50} said", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    index = toxicity.learn(docs.drop("label"), docs.drop("text"))
    assert {t for r in rows for t in toxicity.terms(r[1])} == set(index.vocabulary) and (index.idf > 0).all()
    new = spark.createDataFrame([(f"a text of number3 with vile{c} said",) for c in "abcdefghij"] + [("a text of kind3",)], "text string")
    got = [r.r for r in new.select(toxicity.toxicity(spark, "text", index).alias("r")).collect()]
    assert all(r.score >= 0.7 for r in got[:10]) and got[10].score < 0.3 and got[10].evidence


def test_the_toxicity_index_stays_off_the_driver(spark):
    """What the driver holds does not grow with the terms of the examples; a file of the shared folder does."""
    docs = spark.createDataFrame([(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}{'x' * (k % 7)}" for k in range(200))) for i in range(60)], "doc_id long, text string")
    index = toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("label")))
    assert len(index.vocabulary) > 1000 and len(pickle.dumps(index)) < 10_000
    assert index.load() is index.load()
    kind, twin = index.load(), docs.filter("doc_id in (3, 29)")  # equal texts of both labels
    assert kind.labels.tolist() == [float(int(i) % 3 == 0) for i in kind.ids]
    assert twin.select(toxicity.toxicity(spark, "text", index).alias("r")).filter("size(r.evidence) = 3").count() == 2
    blank = toxicity.learn(docs.withColumn("text", F.lit(None).cast("string")), docs.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("label")).filter("label < 2"))
    assert {r.s for r in twin.select(toxicity.toxicity(spark, "text", blank)["score"].alias("s")).collect()} == {blank.empty}
