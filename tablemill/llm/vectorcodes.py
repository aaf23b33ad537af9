"""Product codes of vectors: integer codebooks refined over metric trees of the vectors' parts.

Vectors travel in blocks of a few thousand rows. For each part position a block holds one metric tree over its
distinct parts, grown middle-out: about the square root of the points become anchors, each owning the points
nearest to it, the anchors' balls are merged pairwise into a tree above, and the points of each anchor are
treated likewise below. A ball caches the number and the sum of its parts. To assign parts to codebook entries a
ball inherits its parent's list of candidate entries and strikes those that some other entry beats everywhere
in the ball; a ball with one candidate left is owned whole, and its cached sums stand for all its parts. Trees
are written once to the shared folder and read by every round. Numbers are integers, so results do not depend
on how rows are dealt to blocks.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.common import Scratch

#: Rows of one block at most; a block's trees are one row of the written table.
BLOCK_ROWS = 4096
#: Distinct points up to which a ball is not divided further.
LEAF = 24
#: Scaled components stay within this, so that squared distances are exact in 64 bits for parts of 64 components.
LIMIT = 1 << 27
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]`` are integer components; with fewer vectors than entries there are fewer entries."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


# --- trees ---


@dataclass
class Tree:
    """Balls in arrays; ball 0 is the root and holds points ``start`` to ``end`` of the tree's own order."""

    points: np.ndarray  # distinct points, in the tree's order
    weight: np.ndarray  # rows that have the point
    place: np.ndarray  # of each row: its point
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    total: np.ndarray  # cached sums
    count: np.ndarray  # cached counts


def anchors(points: np.ndarray) -> np.ndarray:
    """Owner of every point among about sqrt(n) anchors; a new anchor begins at the point farthest from its owner.

    A point no farther from its owner than half the way to the new anchor cannot change hands, so its distance
    is not computed.
    """
    n = len(points)
    owner = np.zeros(n, np.int64)
    pivots = [points[0]]
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    for k in range(1, int(np.ceil(np.sqrt(n)))):
        far = int(away.argmax())
        if away[far] == 0:
            break
        new = points[far]
        half = np.sqrt(((np.array(pivots) - new) ** 2).sum(1)) / 2
        may = np.flatnonzero(away > half[owner] * (1 - 1e-9))
        d = np.sqrt(((points[may] - new) ** 2).sum(1))
        won = d < away[may]
        owner[may[won]], away[may[won]] = k, d[won]
        pivots.append(new)
    return np.unique(owner, return_inverse=True)[1]


def grow(parts: np.ndarray) -> Tree:
    """The metric tree over the rows of ``parts`` (at least one)."""
    points, place, weight = np.unique(parts, axis=0, return_inverse=True, return_counts=True)
    exact, place = points.astype(np.int64), place.reshape(-1)
    spot = points.astype(np.float64)
    balls: list[list] = []  # center, radius, points, left, right

    def ball(members: np.ndarray) -> int:
        """A tree over ``members``; the number of its topmost ball."""
        owner = anchors(spot[members]) if len(members) > LEAF else np.zeros(len(members), np.int64)
        groups = owner.max() + 1
        if groups == 1:
            w = weight[members]
            center = (spot[members] * w[:, None]).sum(0) / w.sum()
            balls.append([center, np.sqrt(((spot[members] - center) ** 2).sum(1).max()), members, -1, -1, w.sum()])
            return len(balls) - 1
        order = np.argsort(owner, kind="stable")
        tops = [ball(members[g]) for g in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1)]
        return merge(tops)

    def merge(tops: list[int]) -> int:
        """Join balls pairwise, always the two whose common ball is smallest."""
        tops = np.array(tops)
        center, radius, mass = (np.array([balls[t][i] for t in tops], dtype=np.float64) for i in (0, 1, 5))

        def common(i: int) -> np.ndarray:
            w = mass / (mass + mass[i])
            gap = np.sqrt(((center - center[i]) ** 2).sum(1))
            return np.maximum(gap * (1 - w) + radius, gap * w + radius[i])

        cost = np.array([common(i) for i in range(len(tops))])
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(tops) - 1):
            i, j = divmod(int(cost.argmin()), len(cost))
            i, j = min(i, j), max(i, j)
            radius[i], both = cost[i, j], mass[i] + mass[j]
            center[i], mass[i] = (center[i] * mass[i] + center[j] * mass[j]) / both, both
            balls.append([center[i].copy(), radius[i], None, tops[i], tops[j], both])
            tops[i] = len(balls) - 1
            cost[j, :] = cost[:, j] = np.inf
            row = common(i)
            row[np.isinf(cost).all(1)] = np.inf
            row[i] = np.inf
            cost[i, :] = cost[:, i] = row
        return int(tops[i])

    ball(np.arange(len(points)))
    # number balls from the root down and points in the order of the leaves
    ranked, todo, order, span, filled = [], [len(balls) - 1], [], {}, 0
    while todo:
        b = todo.pop()
        ranked.append(b)
        if balls[b][3] < 0:
            order.append(balls[b][2])
            span[b] = (filled, filled + len(balls[b][2]))
            filled = span[b][1]
        else:
            todo += [balls[b][4], balls[b][3]]
    number = {b: i for i, b in enumerate(ranked)}
    for b in reversed(ranked):  # children come after their ball
        if balls[b][3] >= 0:
            span[b] = (span[balls[b][3]][0], span[balls[b][4]][1])
    order = np.concatenate(order)
    start, end = (np.array([span[b][i] for b in ranked], np.int64) for i in (0, 1))
    sums = np.vstack([np.zeros((1, exact.shape[1]), np.int64), np.cumsum(exact[order] * weight[order][:, None], 0)])
    rows = np.concatenate([[0], np.cumsum(weight[order])])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Tree(
        exact[order], weight[order], back[place], np.array([balls[b][0] for b in ranked]), np.array([balls[b][1] for b in ranked], dtype=np.float64), start, end,
        *(np.array([number[balls[b][i]] if balls[b][i] >= 0 else -1 for b in ranked], np.int64) for i in (3, 4)), sums[end] - sums[start], rows[end] - rows[start],
    )


def own(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry of each distinct point, sum of each entry's parts, their counts), ties to the lower index."""
    e = entries.astype(np.float64)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    first = np.unique(entries, axis=0, return_index=True)[1]
    nearest = np.empty(len(tree.points), np.int64)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    at = np.zeros(1, np.int64)
    lists = np.zeros((1, len(entries)), bool)
    lists[0, first] = True  # an entry that repeats an earlier one never is nearest
    while len(at):
        d = ((tree.center[at][:, None] - e[None]) ** 2).sum(2)
        best = np.where(lists, d, np.inf).argmin(1)
        least = d[np.arange(len(at)), best]
        # farther than the best entry from every point of the ball: the ball lies beyond the plane between the two
        lists &= d - least[:, None] <= 2 * tree.radius[at][:, None] * apart[best] + 1e-9 * (1 + d)
        whole = lists.sum(1) == 1
        for ball, entry in zip(at[whole], best[whole]):
            nearest[tree.start[ball] : tree.end[ball]] = entry
        np.add.at(sums, best[whole], tree.total[at[whole]])
        np.add.at(counts, best[whole], tree.count[at[whole]])
        leaf = ~whole & (tree.left[at] < 0)
        if leaf.any():
            size = tree.end[at[leaf]] - tree.start[at[leaf]]
            spot = np.concatenate([np.arange(tree.start[b], tree.end[b]) for b in at[leaf]])
            row, entry = np.nonzero(np.repeat(lists[leaf], size, axis=0))  # candidates only, by point and then by entry
            gap = ((tree.points[spot[row]] - entries[entry]) ** 2).sum(1)
            begin = np.searchsorted(row, np.arange(len(spot)))
            hit = gap == np.minimum.reduceat(gap, begin)[row]
            found = np.minimum.reduceat(np.where(hit, entry, len(entries)), begin)
            nearest[spot] = found
            np.add.at(sums, found, tree.points[spot] * tree.weight[spot][:, None])
            np.add.at(counts, found, tree.weight[spot])
        open_ = ~whole & ~leaf
        at, lists = np.concatenate([tree.left[at[open_]], tree.right[at[open_]]]), np.vstack([lists[open_], lists[open_]])
    return nearest, sums, counts


# --- tables ---


def usable(vectors: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    """Rows with a whole finite vector of the commonest length, its components scaled to integers, and that length."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad)
    widths = kept.groupBy(F.size(column).alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    width = widths["w"] if widths else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    whole = F.transform(column, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))
    return kept.filter(F.size(column) == width).withColumn(column, whole), width


def plant(rows: DataFrame, column: str, parts: int) -> DataFrame:
    """One row for each block: the other columns of its rows and its trees, both as bytes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                block = batch.slice(low, BLOCK_ROWS)
                vectors = block.column(column)
                points = vectors.flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                trees, file = {}, io.BytesIO()
                for p, part in enumerate(np.split(points, parts, axis=1)):
                    trees |= {f"{p}.{k}": v for k, v in vars(grow(part)).items()}
                np.savez(file, **trees)
                rest = pa.BufferOutputStream()
                others = block.select([c for c in block.schema.names if c != column])
                with pa.ipc.new_stream(rest, others.schema) as out:
                    out.write_batch(others)
                yield pa.RecordBatch.from_arrays([pa.array([rest.getvalue().to_pybytes()], pa.binary()), pa.array([file.getvalue()], pa.binary())], ["rows", "trees"])

    return rows.mapInArrow(blocks, "rows binary, trees binary")


def forest(data: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(data)) as held:
        return [Tree(**{k: held[f"{p}.{k}"] for k in Tree.__dataclass_fields__}) for p in range(parts)]


def refine(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with every used entry replaced by the floored mean of its parts.

    Tasks add up their blocks; what is collected has as many rows as the codebooks have numbers.
    """
    parts, entries, width = books.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for data in batch.column("trees").to_pylist():
                for p, tree in enumerate(forest(data, parts)):
                    _, sums, counts = own(tree, books[p])
                    held[p, :, :width] += sums
                    held[p, :, width] += counts
        used = np.argwhere(held)
        values = [used[:, i].astype(np.int32) for i in range(3)] + [held[tuple(used.T)]]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["part", "entry", "place", "total"])

    found = trees.select("trees").mapInArrow(totals, "part int, entry int, place int, total long")
    sums = np.zeros((parts, entries, width + 1), np.int64)
    for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect():
        sums[r["part"], r["entry"], r["place"]] = r["total"]
    counts = sums[:, :, width:]
    return np.where(counts > 0, sums[:, :, :width] // np.maximum(counts, 1), books)


def compress(
    vectors: DataFrame, key: str, column: str, carry: Sequence[str] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors, (key, *carry, codes array<int>, error long), and the codebooks behind them.

    Each component x counts as floor(256 x), held to +-2^27. Every part position's codebook starts from that
    part of the ``entries`` usable vectors with the smallest keys (null keys last, repeated keys by their
    components); each round assigns every part to the nearest entry, ties to the lower index, and moves every
    used entry to the floored mean of its parts. ``error`` is the sum of a vector's squared distances after the
    last round. Vectors that are null, empty, hold null or non-finite components or are not of the commonest
    length (ties: the longer) give no row; repeated rows each give one; an empty table gives empty codebooks.
    """
    scratch = Scratch(vectors.sparkSession)
    names = [key, *[c for c in carry if c != key]]
    kept, width = usable(vectors.select(*names, F.col(column).alias("__vector")), "__vector", parts)
    seeds = kept.select("__vector", key).orderBy(F.col(key).asc_nulls_last(), "__vector").limit(entries).collect()  # one codebook's rows
    books = np.array([r["__vector"] for r in seeds], np.int64).reshape(len(seeds), parts, width // parts).swapaxes(0, 1)
    schema = T.StructType([*kept.select(*names).schema.fields, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not seeds:
        return vectors.sparkSession.createDataFrame([], schema), Codebooks(books)
    trees = scratch.settle(plant(kept, "__vector", parts), "trees")
    for _ in range(rounds):
        books = refine(trees, books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data in zip(batch.column("rows").to_pylist(), batch.column("trees").to_pylist()):
                with pa.ipc.open_stream(rows) as held:
                    others = held.read_all().combine_chunks().to_batches()[0]
                code, error = np.empty((others.num_rows, parts), np.int32), np.zeros(others.num_rows, np.int64)
                for p, tree in enumerate(forest(data, parts)):
                    nearest = own(tree, books[p])[0]
                    gap = ((tree.points - books[p][nearest]) ** 2).sum(1)
                    code[:, p], error = nearest[tree.place], error + gap[tree.place]
                lists = pa.ListArray.from_arrays(np.arange(0, code.size + 1, parts, dtype=np.int32), pa.array(code.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*others.columns, lists, pa.array(error)], [*others.schema.names, "codes", "error"])

    done = scratch.settle(trees.mapInArrow(codes, schema), "codes")
    scratch.drop(trees)
    return done, Codebooks(books)
