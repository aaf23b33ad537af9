"""Near duplicates among embeddings: E8 lattice hashing in several tables, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import Scratch, components, spread_join
from tablemill.llm.ngram import scramble

#: With these, pairs at a cosine of exactly 0.9 meet with probability 0.95, at 0.95 with 0.999.
TABLES, PROBES, SCALE = 6, 4, 0.8
#: Members of a cell that are compared with others as one block.
BLOCK = 1024
#: Heavily filled cells are sent to all tasks up to this many, and joined beyond it.
HEAVY_CELLS = 100_000
#: Cosines this close to the threshold are computed anew with exact sums.
CLOSE = 1e-9


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of size 1, or eight of 1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd turn the worst coordinate the other way."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision, safe for very large and very small numbers."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the cell of each row in each table, and of the ``probes`` next nearest cells of each."""
    dim = x.shape[1]
    short = minimal_vectors()
    own = np.empty((len(x), tables), np.uint64)
    near = np.empty((len(x), tables, probes), np.uint64)

    def name(points: np.ndarray, table: int) -> np.ndarray:
        h = np.full(len(points), scramble(np.array([seed * 1_000_003 + table * 1009 + dim * 65_537], np.uint64))[0])
        for c in range(8):
            h = scramble(h ^ np.rint(2 * points[:, c]).astype(np.int64).view(np.uint64))
        return h

    for t in range(tables):
        p = x @ np.random.default_rng([seed, t, dim]).normal(size=(dim, 8)) * scale
        point = nearest_e8(p)
        own[:, t] = name(point, t)
        order = np.argsort(-((p - point) @ short.T), axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            near[:, t, k] = name(point + short[order[:, k]], t)
    return own, near


class Members:
    """Rows of one cell as arrays."""

    def __init__(self, pdf: pd.DataFrame, tables: int):
        self.id = pdf["id"].to_numpy(np.int64)
        self.n = pdf["n"].to_numpy(np.int64)
        self.raw = np.stack(pdf["v"].to_numpy())
        self.unit = unit(self.raw)
        self.own = np.stack(pdf["own"].to_numpy())
        self.near = np.stack(pdf["near"].to_numpy()).reshape(len(pdf), tables, -1)
        self.visits = pdf["visits"].to_numpy(bool)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a.astype(float) / np.abs(a).max(), b.astype(float) / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))


def linked(a: Members, b: Members, same: bool, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that link and whose first meeting place is this one.

    a are members of the cell; a row of b is a member of it or visits it. Two vectors can meet in several
    tables and ways; the first table counts, and in it: both in one cell, else the smaller id visiting, else
    the other.
    """
    cos = a.unit @ b.unit.T
    x, y = np.nonzero(cos >= threshold - CLOSE)
    if same:
        x, y = x[x < y], y[x < y]
    for k in np.flatnonzero(np.abs(cos[x, y] - threshold) <= CLOSE):
        cos[x[k], y[k]] = threshold if exact_cosine(a.raw[x[k]], b.raw[y[k]]) >= threshold else -1
    real = (cos[x, y] >= threshold) & (a.id[x] != b.id[y])
    x, y = x[real], y[real]
    out_x, out_y = [], []
    for at in range(0, len(x), 50_000):
        i, j = x[at : at + 50_000], y[at : at + 50_000]
        one = a.own[i] == b.own[j]
        b_visits = (b.near[j] == a.own[i][:, :, None]).any(2)
        a_visits = (a.near[i] == b.own[j][:, :, None]).any(2)
        first = (one | b_visits | a_visits).argmax(1)
        row = np.arange(len(i))
        here = np.where(one[row, first], 0, np.where(np.where(b.id[j] < a.id[i], b_visits[row, first], ~a_visits[row, first]), 1, 2))
        good = (first == table) & (here == np.where(b.visits[j], 1, 0))
        out_x.append(i[good])
        out_y.append(j[good])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_x or none), np.concatenate(out_y or none)


def groups_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bool, pd.DataFrame]]:
    """(whether a new group begins, rows of one group) over batches sorted by place."""
    last = None
    for pdf in batches:
        keys = pdf["place"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield keys[s] != last, pdf.iloc[s:e]
            last = keys[s]


FOUND = "a long, b long, n long"


def comparer(tables: int, threshold: float):
    """Compare the members of each place with each other and with what else comes there, block by block."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base: list[Members] = []
        size = 0
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def note(a: Members, b: Members, same: bool, table: int) -> None:
            x, y = linked(a, b, same, table, threshold)
            if not len(x):
                return
            for one, other, i, j in ((a, b, x, y), (b, a, y, x)):
                n = np.bincount(i, weights=other.n[j], minlength=len(one.id)).astype(np.int64)
                k = np.flatnonzero(n)
                counts.append((one.id[k], n[k]))
            # only that they are connected is handed on, not every pair
            ids, inverse = np.unique(np.concatenate([a.id[x], b.id[y]]), return_inverse=True)
            p, q = inverse[: len(x)], inverse[len(x) :]
            label = np.arange(len(ids))
            while True:
                low = np.minimum(label[p], label[q])
                new = label.copy()
                np.minimum.at(new, p, low)
                np.minimum.at(new, q, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
            rest = np.flatnonzero(label != np.arange(len(ids)))
            edges.append((ids[label[rest]], ids[rest]))

        def flush() -> Iterator[pd.DataFrame]:
            if counts:
                yield pd.DataFrame({"a": np.concatenate([c[0] for c in counts]), "b": None, "n": np.concatenate([c[1] for c in counts])}).astype({"b": "Int64"})
            if edges:
                yield pd.DataFrame({"a": np.concatenate([e[0] for e in edges]), "b": np.concatenate([e[1] for e in edges]), "n": 0}).astype({"b": "Int64"})
            counts.clear()
            edges.clear()

        for new, rows in groups_of(batches):
            if new:
                base, size = [], 0
            other = rows["other"].to_numpy(bool)
            table = int(rows["t"].iloc[0])
            if not other.all():
                mine = rows[~other]
                if size or len(rows) > 1:
                    members = Members(mine, tables)
                    for b in base:
                        note(b, members, False, table)
                    note(members, members, True, table)
                    base.append(members)
                else:
                    base.append(Members(mine, tables))
                size += len(mine)
            if other.any() and size:
                more = rows[other]
                for s in range(0, len(more), 4096):
                    part = Members(more.iloc[s : s + 4096], tables)
                    for b in base:
                        note(b, part, False, table)
            if sum(len(c[0]) for c in counts) > 100_000:
                yield from flush()
        yield from flush()

    return compare


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES,
    scale: float = SCALE, seed: int = 23,
) -> DataFrame:
    """Vectors with a cosine of ``threshold`` or more that meet in a lattice cell, and their components.

    Equal vectors form a class that is hashed once and never compared. In each table a vector is projected on
    eight random directions and decoded to the nearest point of E8; it is a member of that cell and visits
    the ``probes`` next nearest ones. Members are compared with each other and with visitors in double
    precision; a pair counts at its first meeting place alone. Cells with more than ``BLOCK`` members are cut
    into blocks, each compared with the later ones, so no task holds more than a block. What leaves a task is
    counts and who is connected, not pairs. Every vector is hashed; nothing is capped or sampled.

    Returns the columns of ``vectors`` and n_links long, component_id (smallest ``key`` reachable), kept
    boolean; columns of those names are replaced. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Rows that repeat a key are
    vectors of their own; a null key is never the name of a component that has another.
    """
    scratch = Scratch(vectors.sparkSession)
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    names = ["n_links", "component_id", "kept"]
    rows = vectors.select(F.struct(*[c for c in vectors.columns if c not in names]).alias("__row"), F.col(key).alias("__key"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumn("id", F.when(F.col("fine"), F.xxhash64(F.lit(seed), F.size("v"), "v")))
    # two hashes make a false equality of two vectors unthinkable; the first alone names the class
    rows = rows.withColumn("__twin", F.when(F.col("fine"), F.xxhash64(F.lit(seed + 1), "v")))
    classes = rows.filter("fine").groupBy("id", "__twin").agg(F.min("__key").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = scratch.settle(classes.withColumn("id", F.col("id").bitwiseXOR(F.shiftleft("__twin", 1))), "classes")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["v"].map(len)
            for _, part in pdf.groupby(lengths):
                for at in range(0, len(part), 2000):
                    some = part.iloc[at : at + 2000]
                    own, near = cells(unit(np.stack(some["v"].to_numpy())), tables, probes, scale, seed)
                    yield pd.DataFrame({"id": some["id"], "n": some["n"], "v": some["v"], "own": list(own.view(np.int64)), "near": list(near.reshape(len(some), -1).view(np.int64))})

    kind = classes.schema["v"].dataType.simpleString()
    placed = scratch.settle(classes.select("id", "n", "v").mapInPandas(hashed, f"id long, n long, v {kind}, own array<long>, near array<long>"), "hashed")
    sent = placed.select("*", F.posexplode(F.concat("own", "near")).alias("pos", "cell"))
    sent = sent.withColumn("visits", F.col("pos") >= tables).withColumn("t", F.when(F.col("visits"), F.floor((F.col("pos") - tables) / probes)).otherwise(F.col("pos")).cast("int"))
    sent = sent.drop("pos")
    heavy = placed.select(F.explode("own").alias("cell")).groupBy("cell").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    heavy = scratch.settle(heavy.select("cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("cuts")), "heavy")
    sent = sent.join(F.broadcast(heavy) if heavy.count() <= HEAVY_CELLS else heavy, "cell", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    block = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("cuts")).cast("int")
    # a member is the base of its own block and meets the blocks before it; a visitor meets all blocks
    upto = F.when(F.col("visits"), F.col("cuts") - 1).otherwise(block)
    sent = sent.withColumn("block", block).withColumn("at", F.explode(F.sequence(F.lit(0), upto)))
    sent = sent.withColumn("other", F.col("visits") | (F.col("at") < F.col("block"))).withColumn("place", F.xxhash64("cell", "at"))
    sent = sent.select("place", "t", "other", "visits", "id", "n", "v", "own", "near")
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = sent.repartition(parts, "place").sortWithinPartitions("place", "other")
    found = scratch.settle(dealt.mapInPandas(comparer(tables, threshold), FOUND), "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    joined = components(found.filter("b is not null"), "a", "b")
    state = classes.select("id", "least", "n").join(links, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    state = scratch.settle(state.withColumn("component", F.coalesce("component", "id")), "state")
    smallest = scratch.settle(state.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c")), "smallest")
    state = spread_join(state, smallest, "component", "c", ["id"])
    state = state.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component_id"), "n")
    state = scratch.settle(state, "named")
    out = rows.withColumn("id", F.coalesce(F.col("id").bitwiseXOR(F.shiftleft("__twin", 1)), F.xxhash64(F.lit(0), "__key")))
    good = spread_join(out.filter("fine"), state, "id", "n", ["__key"]).select("__row", "__key", "n_links", "component_id")
    lone = out.filter("not fine").select("__row", "__key", F.lit(0).cast("long").alias("n_links"), F.col("__key").alias("component_id"))
    every = good.unionByName(lone)
    return every.select("__row.*", "n_links", "component_id", F.coalesce(F.col("__key") == F.col("component_id"), F.col("__key").isNull()).alias("kept"))
