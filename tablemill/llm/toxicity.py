"""Toxicity by votes of the nearest labelled examples under the exact cosine of weighted TF-IDF over all their terms."""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.common import Scratch
from tablemill.llm.warc import store
from tablemill.session import fresh_folder

GAP = re.compile(r"[\W\d_]+")
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows learned from, the first in a seeded order.
EXAMPLES = 20_000
#: From so many standard deviations between the labels on a term has its full IDF weight, which leaves no room for chance.
SURE = 5.0
#: Below that its weight falls with this power, so that the many chance terms of a text do not drown the telling ones.
DOUBT = 4
#: But never under this share of the IDF weight: every term of the examples counts.
LEAST = 1e-3
NEIGHBOURS = 25
#: Cosines that differ by less than this are compared in double precision before one is passed over.
SLACK = 1e-5
#: Postings read in about the time that the whole cosine of one example takes.
WORTH = 2000
#: Terms are read in tiers of so many and the rest, by the length they have in all examples together.
TIERS = (2048, 8192, 32768)
#: Lengths of word beginnings that are terms besides whole words.
BEGINNINGS = (4, 5, 6)


def words(text: str | None) -> str:
    """Lower-case words with one space before, between and after."""
    return f" {GAP.sub(' ', (text or '').lower())} ".replace("  ", " ")


def parts(word: str) -> list[str]:
    """Terms of a word: the whole word (" word ") and, if it is longer, its beginnings (" wor")."""
    return [f" {word} ", *[f" {word[:n]}" for n in BEGINNINGS if len(word) > n]]


def terms(text: str | None) -> set[str]:
    return {t for w in set(words(text).split()) for t in parts(w)}


@dataclass
class Index:
    """Unit vectors of the examples, by term for finding the nearest and by example for their cosines."""

    vocabulary: list[str]
    idf: np.ndarray  # with the share of it that the term's certainty leaves
    telling: np.ndarray  # whether a term has its full IDF weight
    labels: np.ndarray
    ids: np.ndarray
    at: np.ndarray  # postings: positions of examples, term after term
    weight: np.ndarray  # postings: weights in single precision
    cuts: np.ndarray  # terms x 2: where a term's postings begin and end
    tier: np.ndarray  # tier of each term
    tails: np.ndarray  # tiers x examples: length of what a vector has behind a tier
    term: np.ndarray  # vectors: term numbers, example after example
    exact: np.ndarray  # vectors: weights in double precision
    edges: np.ndarray  # where the vector of an example begins, and the end of the last
    empty: float  # share of label 1 among examples without terms
    prior: float
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    room: np.ndarray | None = None  # zeros, one for each term, between two queries

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the ``k`` nearest examples; ties go to the earlier one.

        Terms are read tier by tier. What the tiers behind add to a cosine is no more than the product of the lengths
        that query and example have there. Once that can lift only few examples to the k-th cosine so far, the whole
        cosines of these are taken, the foremost first; no other example can be among the nearest.
        """
        examples = len(self.labels)
        if not examples or not len(term):
            return np.zeros(0, np.int64), np.zeros(0)
        tier = self.tier[term]
        order = np.argsort(tier, kind="stable")
        ends = np.searchsorted(tier[order], np.arange(len(self.tails)), "right").tolist()
        cuts = self.cuts[term[order]]
        read = np.concatenate([[0], np.cumsum(cuts[:, 1] - cuts[:, 0])])
        length = np.sqrt(np.append(np.cumsum(np.square(weight[order])[::-1])[::-1], 0.0))
        found, done = np.zeros(examples), 0
        if leave >= 0:
            found[leave] = -9.0
        for look, tails in zip(ends, self.tails):
            if look > done:
                lists = cuts[done:look].tolist()
                held = np.concatenate([self.weight[a:z] * w for (a, z), w in zip(lists, weight[order[done:look]].astype(np.float32))])
                found += np.bincount(np.concatenate([self.at[a:z] for a, z in lists]), held, examples)
                done = look
            elif done:
                continue
            worst = np.partition(found, -k)[-k] if examples >= k else -1.0
            most = found + (length[done] * tails + SLACK)
            near = np.flatnonzero(most >= worst)
            if len(near) * WORTH <= read[-1] - read[done]:
                break
        if done == len(term):
            near = near[found[near] > 0]
        near = near[near != leave]
        if self.room is None:
            self.room = np.zeros(len(self.vocabulary))
        query = self.room
        query[term] = weight
        cos = np.full(len(near), -1.0)
        foremost = np.argpartition(-found[near], k - 1) if len(near) > k else np.arange(len(near))
        self.cosines(query, near, foremost[:k], cos)
        if len(near) > k:
            self.cosines(query, near, foremost[k:][most[near[foremost[k:]]] >= cos[foremost[:k]].min()], cos)
        query[term] = 0.0
        first = np.argsort(-cos, kind="stable")[:k]
        first = first[cos[first] > 0]
        return near[first], cos[first]

    def cosines(self, query: np.ndarray, near: np.ndarray, places: np.ndarray, out: np.ndarray) -> None:
        """Put the cosines of the examples ``near[places]`` with a query, spread over all terms, into ``out[places]``."""
        for place, a, z in zip(places.tolist(), self.edges[near[places]].tolist(), self.edges[near[places] + 1].tolist()):
            out[place] = query.take(self.term[a:z]) @ self.exact[a:z]

    def vote(self, cos: np.ndarray, at: np.ndarray) -> float:
        """Share of label 1 among the neighbours, nearer ones counting more; the prior counts as one distant neighbour."""
        w = 1.0 / (1.05 - np.minimum(cos, 1.0))
        return float((w @ self.labels[at] + self.prior) / (w.sum() + 1.0))

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.curve))


def rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x by pooling neighbours, as points to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            p = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p[0], blocks[-1][1] + p[1], blocks[-1][2] + p[2]]
    # one success and one failure are added to each pool, so a small pool is not certain
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1.0) for b in blocks]))


def reader(vocabulary: list[str]):
    """Function from a text to the numbers of its terms, in order, and how often each occurs.

    When not ``counted``, the numbers come in any order and some repeat, without how often.
    """
    number = {t: i for i, t in enumerate(vocabulary)}
    known: dict[str, np.ndarray] = {}

    def read(text: str | None, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        found = Counter(WORD.findall((text or "").lower()))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(known) >= 200_000:
            known.clear()
        for w in (w for w in found if w not in known):
            known[w] = np.array([number[t] for t in parts(w) if t in number], np.int64)
        own = [known[w] for w in found]
        every = np.concatenate(own)
        if not counted:
            return every, np.zeros(0)
        term, place = np.unique(every, return_inverse=True)
        times = np.fromiter(found.values(), float, len(found))
        return term, np.bincount(place, np.repeat(times, np.fromiter(map(len, own), np.int64, len(own))), len(term))

    return read


def weigh(term: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vector as term numbers and weights."""
    w = (1 + np.log(n)) * idf[term]
    return term, w / (np.sqrt(w @ w) or 1.0)


@dataclass
class Stored:
    """An index as a file of the shared folder; a process reads it when it first needs it, and keeps one."""

    path: str
    empty: float
    prior: float
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def load(self) -> Index:
        index = kept("index", self.path, pickle.load)
        index.curve = self.curve
        return index

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.load(), name)


HELD: dict[str, tuple[str, object]] = {}


def kept(kind: str, path: str, read):
    """What ``read`` makes of a file of the shared folder; a process keeps the last of each kind."""
    if HELD.get(kind, ("",))[0] != path:
        if kind != "reader":  # a reader of terms alone is of no use beside an index, nor an older index
            HELD.clear()
        disk, name = store(path)
        with disk.open_input_file(name) as file:
            HELD[kind] = (path, read(file))
    return HELD[kind][1]


def table_of(path: str, columns: list[str] | None = None) -> pa.Table:
    disk, name = store(path)
    with disk.open_input_file(name) as file:
        return pq.ParquetFile(file).read(columns)


def column(path: str, name: str) -> list:
    return table_of(path, [name]).column(name).to_pylist()


def vocabulary_of(path: str):
    """Reader for the terms of a file, in its order."""
    return kept("terms", path, lambda file: reader(pq.ParquetFile(file).read(["term"]).column("term").to_pylist()))


def learn(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "label", examples: int = EXAMPLES, seed: int = 5) -> Stored:
    """Build the index from ``labelled`` (``key``, ``label`` 0 or 1, one row for each key) and the texts in ``docs``.

    At most ``examples`` labelled rows, the first by a seeded hash of the key, are learned from: they give the
    vocabulary, which is all their terms, and the example vectors. Document frequencies for the IDF weights are
    counted over all of ``docs``. A term whose document counts do not differ between the labels beyond doubt
    keeps only a share of its weight, down to ``LEAST``: under IDF alone the names and rare words of a text
    outweigh what its label depends on. Terms, counts, vectors and the index go through the shared folder; the
    driver holds the votes of the examples.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    keys = labelled.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    keys = keys.orderBy(F.xxhash64(F.lit(seed), "k"), "k").limit(examples)  # keys and labels only
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(keys), "k").dropDuplicates(["k"])
    rows = scratch.settle(rows, "examples")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[int]] = {}
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"]):
                for term in terms(t):
                    sums.setdefault(term, [0, 0])[y] += 1
            if len(sums) > 200_000:
                yield pd.DataFrame([(t, a, b) for t, (a, b) in sums.items()], columns=["term", "no", "yes"])
                sums = {}
        yield pd.DataFrame([(t, a, b) for t, (a, b) in sums.items()], columns=["term", "no", "yes"])

    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    words_at, counts_at, vectors_at = None, [], []
    if n0 and n1:
        table = rows.mapInPandas(count, "term string, no long, yes long").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        # as many terms as the examples have, so one task sorts them and one builds the index
        table = scratch.settle(table.coalesce(1).sortWithinPartitions("term"), "terms")
        words_at = max(table.inputFiles(), key=lambda path: _rows(path))
        counts_at = scratch.settle(document_frequencies(docs, text, words_at).coalesce(1), "frequencies").inputFiles()
        vectors_at = scratch.settle(vectors(rows, words_at), "vectors").inputFiles()
    folder = fresh_folder(spark, "toxicity")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        HELD.clear()
        for _ in batches:
            index = assemble(words_at, counts_at, vectors_at, n0, n1)
            disk, root = store(folder)
            disk.create_dir(root, recursive=True)
            name = f"index-{uuid.uuid4().hex}.pickle"  # a task that runs again writes a file of its own
            with disk.open_output_stream(f"{root}/{name}") as file:
                pickle.dump(index, file, protocol=5)
            yield pd.DataFrame({"name": [name], "n": [len(index.labels)], "empty": [index.empty], "prior": [index.prior]})

    made = spark.range(1).coalesce(1).mapInPandas(build, "name string, n long, empty double, prior double").first()
    scratch.drop(rows)
    index = Stored(f"{folder}/{made['name']}", made["empty"], made["prior"])
    if made["n"]:
        index.curve = rising(*judged(spark, index, made["n"]))
    return index


def _rows(path: str) -> int:
    disk, name = store(path)
    with disk.open_input_file(name) as file:
        return pq.ParquetFile(file).metadata.num_rows


def assemble(words_at: str | None, counts_at: list[str], vectors_at: list[str], n0: int, n1: int) -> Index:
    """The index from the files of terms, document frequencies and example vectors; they are as many as the examples give."""
    vocabulary: list[str] = column(words_at, "term") if words_at else []
    trust = df = np.zeros(0)
    total = 0
    if vocabulary:
        no, yes = (np.array(column(words_at, c), float) for c in ("no", "yes"))
        p = (no + yes + 1.0) / (n0 + n1 + 2.0)
        z = np.abs(yes / n1 - no / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
        trust = np.clip((z / SURE) ** DOUBT, LEAST, 1.0)
        df = np.zeros(len(vocabulary) + 1)
        for path in counts_at:
            df[np.array(column(path, "term"), np.int64) + 1] = column(path, "n")
        total, df = int(df[0]), df[1:]
    idf = (np.log((1.0 + total) / (1.0 + df)) + 0.01) * trust
    keys, y, size = np.zeros(0, object), np.zeros(0), np.zeros(0, np.int64)
    term = n = np.zeros(0, np.int32)
    if vectors_at:
        made = pa.concat_tables([table_of(path) for path in vectors_at])
        made = made.take(pa.array(np.argsort(np.array(made["k"].to_pylist(), object).astype(str), kind="stable")))
        keys, y = np.array(made["k"].to_pylist(), object), made["y"].to_numpy().astype(float)
        size = np.diff(np.frombuffer(made["terms"].combine_chunks().buffers()[1], np.int32, len(y) + 1)).astype(np.int64) // 4
        if size.any():
            term, n = (np.frombuffer(made[c].combine_chunks().buffers()[2], np.int32, size.sum()) for c in ("terms", "n"))
        del made
    ids, labels = keys[size > 0], y[size > 0]
    none = y[size == 0]
    edges = np.concatenate([[0], np.cumsum(size[size > 0])])
    exact = np.log(n)
    del n
    exact += 1
    exact *= idf[term]
    if len(ids):
        exact /= np.repeat(np.sqrt(np.add.reduceat(exact * exact, edges[:-1])), np.diff(edges))
    tier, tails = tiers(term, exact, edges, len(vocabulary))
    order = np.argsort(term, kind="stable").astype(np.int32 if len(term) < 1 << 31 else np.int64)
    at = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(edges))[order]
    weight = exact[order].astype(np.float32)
    ends = np.searchsorted(term[order], np.arange(len(vocabulary)), "right")
    begins = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])
    prior = (n1 + 0.5) / (n0 + n1 + 1.0) if n0 + n1 else 0.0
    return Index(
        vocabulary, idf, trust >= 1.0, labels, ids, at, weight, np.stack([begins, ends], 1), tier, tails, term, exact, edges,
        (none.sum() + prior) / (len(none) + 1.0) if n0 + n1 else 0.0, prior,
    )


def tiers(term: np.ndarray, exact: np.ndarray, edges: np.ndarray, terms_held: int) -> tuple[np.ndarray, np.ndarray]:
    """The tier of each term, and how long each vector is behind each tier."""
    tier = np.full(terms_held, len(TIERS), np.int8)
    by_length = np.argsort(-np.bincount(term, np.square(exact), terms_held), kind="stable")
    for number, size in reversed(list(enumerate(TIERS))):
        tier[by_length[:size]] = number
    tails = np.zeros((len(TIERS) + 1, len(edges) - 1))
    for number in range(len(TIERS) if len(term) else 0):
        held = np.square(exact)
        held[tier[term] <= number] = 0.0
        tails[number] = np.sqrt(np.add.reduceat(held, edges[:-1]))
    return tier, tails


def judged(spark: SparkSession, index: Stored, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vote and label of every example that has terms, each judged by the others."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.load()
        for pdf in batches:
            votes = []
            for j in pdf["id"]:
                own = slice(ix.edges[j], ix.edges[j + 1])
                at, cos = ix.nearest(ix.term[own], ix.exact[own], NEIGHBOURS, leave=j)
                votes.append(ix.vote(cos, at) if len(at) else ix.prior)
            yield pd.DataFrame({"id": pdf["id"], "vote": votes, "label": ix.labels[pdf["id"]]})

    found = spark.range(size).repartition(max(1, size // 500)).mapInPandas(judge, "id long, vote double, label double").toPandas().sort_values("id")
    return found["vote"].to_numpy(), found["label"].to_numpy()


def document_frequencies(docs: DataFrame, text: str, words_at: str) -> DataFrame:
    """``n``, the number of documents that hold each ``term`` (by number), over all documents; under -1 that of all."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, rows, sums = vocabulary_of(words_at), 0, np.zeros(_rows(words_at), np.int64)
        for pdf in batches:
            rows += len(pdf)
            for t in pdf["t"]:
                sums[read(t, counted=False)[0]] += 1  # a repeated number adds one, too
        held = np.flatnonzero(sums)
        yield pd.DataFrame({"term": [-1, *held], "n": [rows, *sums[held]]})

    return docs.select(F.col(text).alias("t")).mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def vectors(rows: DataFrame, words_at: str) -> DataFrame:
    """Term numbers and counts of the examples, as bytes of 32-bit integers."""
    def vector(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = vocabulary_of(words_at)
        for pdf in batches:
            made = [[x.astype(np.int32).tobytes() for x in read(t)] for t in pdf["t"]]
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "terms": [m[0] for m in made], "n": [m[1] for m in made]})

    key = rows.schema["k"].dataType.simpleString()
    return rows.mapInPandas(vector, f"k {key}, y int, terms binary, n binary")


RESULT = "score double, evidence array<struct<example:string,cosine:double,label:int>>, terms array<string>"


def toxicity(spark: SparkSession, text: str | Column, index: Stored, neighbours: int = NEIGHBOURS, shown: int = 3) -> Column:
    """Struct of the calibrated score, the nearest examples and the terms of the text that tell the labels apart beyond doubt.

    All terms known from the examples count for the score. A text without any (null and empty ones too) gets the share of label 1 among the examples without
    any, and no evidence. Under an index without labels of both kinds every score is that of the prior.
    """

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ix = index.load()
        read, known = kept("reader", index.path, lambda _: reader(ix.vocabulary)), {}
        for texts in batches:
            out = []
            for t in texts:
                term, n = read(t)
                if not len(term):
                    out.append((ix.empty, [], []))
                    continue
                sign = hashlib.blake2b(term.tobytes() + n.tobytes(), digest_size=16).digest()
                if sign not in known:
                    at, cos = ix.nearest(*weigh(term, n, ix.idf), neighbours)
                    score = ix.calibrated(ix.vote(cos, at)) if len(at) else ix.prior
                    if len(known) >= 20_000:  # results of equal vectors are kept, up to a bound
                        known.clear()
                    known[sign] = (score, [{"example": str(ix.ids[i]), "cosine": float(c), "label": int(ix.labels[i])} for i, c in zip(at[:shown], cos[:shown])])
                out.append((*known[sign], [ix.vocabulary[i].strip() for i in term[ix.telling[term]]]))
            yield pd.DataFrame(out, columns=["score", "evidence", "terms"])

    return judge.asNondeterministic()(text)
