"""Nearest reference row by metric trees that tasks read from the shared folder."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import settle

#: Points of one block of the reference, and points up to which a ball is not divided.
BLOCK_POINTS, LEAF_POINTS = 4096, 64
#: Rows that walk down the trees together.
ROWS = 2048


def grow(points: np.ndarray) -> dict[str, np.ndarray]:
    """Balls around ever smaller sets of points, in arrays; ball 0 holds all, ``order`` sorts points by leaf.

    A set is divided by which of two far points is nearer; equal points stay together.
    """
    center, radius, start, end, left = [], [], [], [], []
    order = np.arange(len(points))

    def ball(low: int, high: int) -> int:
        mine = points[order[low:high]]
        middle = mine.mean(0)
        gap = np.sqrt(((mine - middle) ** 2).sum(1))
        me = len(center)
        for held, value in ((center, middle), (radius, gap.max()), (start, low), (end, high), (left, -1)):
            held.append(value)
        return me

    todo = [ball(0, len(points))]
    while todo:
        me = todo.pop()
        low, high = start[me], end[me]
        if high - low <= LEAF_POINTS or radius[me] == 0:
            continue
        mine = points[order[low:high]]
        one = mine[((mine - center[me]) ** 2).sum(1).argmax()]
        from_one = ((mine - one) ** 2).sum(1)
        other = mine[from_one.argmax()]
        nearer = from_one <= ((mine - other) ** 2).sum(1)
        cut = low + int(nearer.sum())
        if cut in (low, high):
            continue
        order[low:high] = np.concatenate([order[low:high][nearer], order[low:high][~nearer]])
        left[me] = ball(low, cut)
        ball(cut, high)
        todo += [left[me], left[me] + 1]
    return {"center": np.array(center), "radius": np.array(radius), "start": np.array(start), "end": np.array(end), "left": np.array(left), "order": order}


class Search:
    """Nearest points so far of some rows; ``pairs`` counts the distances computed."""

    def __init__(self, x: np.ndarray):
        self.x, self.pairs = x, 0
        self.gap, self.id = np.full(len(x), np.inf), np.zeros(len(x), np.int64)

    def visit(self, tree: dict[str, np.ndarray], ball: int = 0, rows: np.ndarray | None = None) -> None:
        """Walk down from a ball with the rows that may have a nearest point in it."""
        rows = np.arange(len(self.x)) if rows is None else rows
        todo = [(ball, rows)]
        while todo:
            ball, rows = todo.pop()
            away = np.sqrt(((self.x[rows] - tree["center"][ball]) ** 2).sum(1))
            # no point of the ball is nearer than this; a little slack for rounding, and equal distances stay in
            least = np.maximum(away - tree["radius"][ball], 0) * (1 - 1e-9)
            rows = rows[least * least <= self.gap[rows] * (1 + 1e-9)]
            if not len(rows):
                continue
            child = tree["left"][ball]
            if child < 0:
                self.compare(rows, tree["points"][tree["start"][ball] : tree["end"][ball]], tree["ids"][tree["start"][ball] : tree["end"][ball]])
                continue
            # each row's nearer half first, so that its other half is more often ruled out
            near = ((self.x[rows] - tree["center"][child]) ** 2).sum(1) <= ((self.x[rows] - tree["center"][child + 1]) ** 2).sum(1)
            todo += [(child, rows[~near]), (child + 1, rows[near]), (child + 1, rows[~near]), (child, rows[near])]

    def compare(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray) -> None:
        self.pairs += len(rows) * len(points)
        squared = ((self.x[rows][:, None, :] - points[None]) ** 2).sum(2)
        least = squared.min(1)
        who = np.where(squared == least[:, None], ids[None], np.iinfo(np.int64).max).min(1)
        better = (least < self.gap[rows]) | (least == self.gap[rows]) & (who < self.id[rows])
        self.gap[rows[better]], self.id[rows[better]] = least[better], who[better]


def usable(vector: str) -> Column:
    """A vector with at least one component, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def blocks(reference: DataFrame, ref_id: str, ref_vector: str, block_points: int = BLOCK_POINTS) -> DataFrame:
    """One row for each block of reference rows: width, root ball, tree."""
    points = reference.where(F.col(ref_id).isNotNull() & usable(ref_vector)).select(F.col(ref_id).cast("long").alias("id"), F.col(ref_vector).cast("array<double>").alias("point"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("point").value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                mine = batch.filter(pa.array(widths == width))
                for low in range(0, mine.num_rows, block_points):
                    part = mine.slice(low, block_points)
                    x = part.column("point").flatten().to_numpy().reshape(-1, width)
                    tree = grow(x)
                    order = tree.pop("order")
                    file = io.BytesIO()
                    np.savez(file, points=x[order], ids=part.column("id").to_numpy()[order], **tree)
                    arrays = [[width], [tree["center"][0].tolist()], [float(tree["radius"][0])], [file.getvalue()]]
                    kinds = [pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], ["width", "center", "radius", "tree"])

    return points.mapInArrow(plant, "width int, center array<double>, radius double, tree binary")


class Forest:
    """Blocks read from their files when first needed; only root balls and a few trees are held."""

    HELD = 8

    def __init__(self, paths: list[str]):
        self.roots: dict[int, list] = {}
        self.files, self.held = {}, {}
        for path in paths:
            disk, name = arrow_fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
            file = pq.ParquetFile(disk.open_input_file(name))
            self.files[path] = file
            for group in range(file.num_row_groups):
                roots = file.read_row_group(group, columns=["width", "center", "radius"]).to_pylist()
                for row, r in enumerate(roots):
                    self.roots.setdefault(r["width"], []).append(((path, group, row), np.array(r["center"]), r["radius"]))

    def tree(self, key: tuple[str, int, int]) -> dict[str, np.ndarray]:
        if key not in self.held:
            while len(self.held) >= self.HELD:
                self.held.pop(next(iter(self.held)))
            data = self.files[key[0]].read_row_group(key[1], columns=["tree"]).column("tree")[key[2]].as_py()
            with np.load(io.BytesIO(data)) as held:
                self.held[key] = {k: held[k] for k in held.files}
        return self.held[key]

    def nearest(self, x: np.ndarray) -> Search:
        """Blocks are visited nearest first; one whose ball is too far from every row is not read."""
        search, roots = Search(x), self.roots.get(x.shape[1], [])
        if roots:
            lows = np.array([np.maximum(np.sqrt(((x - c) ** 2).sum(1)) - r, 0) for _, c, r in roots])
            for i in np.argsort(lows.mean(1)).tolist():
                rows = np.flatnonzero((lows[i] * (1 - 1e-9)) ** 2 <= search.gap * (1 + 1e-9))
                if len(rows):
                    search.visit(self.tree(roots[i][0]), 0, rows)
        return search


def nearest_row(
    df: DataFrame, vector: str, reference: DataFrame, ref_id: str, ref_vector: str, block_points: int = BLOCK_POINTS
) -> DataFrame:
    """Closest reference row by Euclidean distance, as ``nearest_id`` and ``distance``; smallest id on ties.

    The reference is cut into blocks, each a metric tree, and written to the shared folder.
    Tasks hold the root balls, walk batches of rows down the trees and read only blocks whose
    ball may hold a nearer point. Vectors that are null, empty or hold a null or non-finite
    component have no nearest row and are nobody's, nor are reference rows without an id;
    vectors meet only those of their own length, and an empty reference gives nulls.
    """
    held = settle(blocks(reference, ref_id, ref_vector, block_points), "blocks")
    paths = held.inputFiles()
    rest = [c for c in df.columns if c not in ("nearest_id", "distance")]
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField("nearest_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    ready = df.select(*rest, F.when(usable(vector), F.col(vector).cast("array<double>")).alias("_x"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = None
        for batch in batches:
            forest = forest or Forest(paths)
            ids, gaps, found = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            widths = batch.column("_x").value_lengths().fill_null(0).to_numpy()
            for width in np.unique(widths[widths > 0]).tolist():
                mine = np.flatnonzero(widths == width)
                x = batch.column("_x").take(pa.array(mine)).flatten().to_numpy().reshape(-1, width)
                for low in range(0, len(mine), ROWS):
                    got = forest.nearest(x[low : low + ROWS])
                    at = mine[low : low + ROWS]
                    ids[at], gaps[at], found[at] = got.id, np.sqrt(got.gap), np.isfinite(got.gap)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(ids, mask=~found), pa.array(gaps, mask=~found)], schema.names)

    return ready.mapInArrow(search, schema)
