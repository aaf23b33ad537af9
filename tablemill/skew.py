"""Group-wise work that stays balanced when one group holds much of the table.

A window partitioned by a key puts a whole group into one task. Here, groups above about
``tablemill.rowsPerSlice`` rows are cut into slices along their sort order. Each slice
is one window partition; what a slice must know of its neighbours (a running total, a
few edge rows) travels through a table with one row per (hot key, slice). Groups below
the limit take the plain window. Both ways give the same rows.

Which groups are hot and where they are cut comes from one job: a sample of the rows'
keys and whole sort tuples, grouped by key, of which only the cut points of hot keys
reach the driver, about one for each half slice of rows. It is kept for later operators
on the same rows, keys and order (or the reverse order).

Sort orders are lists of column names; a leading ``-`` means descending. As in Spark,
nulls come first ascending and last descending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import settle

ROWS_PER_SLICE = 2_000_000
#: sampled rows for each slice of rows; a key is hot from three quarters of a slice's share on
SAMPLES = 64
#: slices compared at once; longer lists are searched level by level
FAN = 16
_SLICE = "_slice"


def rows_per_slice(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("tablemill.rowsPerSlice", str(ROWS_PER_SLICE)))


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def window(keys: Sequence[str], order: Sequence[str] = ()) -> WindowSpec:
    spec = Window.partitionBy(*[F.col(k) for k in keys])
    return spec.orderBy(*order_columns(order)) if order else spec


def sort_tuple(df: DataFrame, order: Sequence[str]) -> Column:
    """A struct whose natural order is the given one, whatever the columns' types and directions."""
    parts = []
    for o in order:
        name, down = (o[1:], True) if o.startswith("-") else (o, False)
        column = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # numbers survive the way over the driver in any time zone
            column, kind = F.unix_micros(column.cast("timestamp")), T.LongType()
        known = column.isNull() if down else column.isNotNull()
        parts.append(F.struct(known.alias("known"), (_falling(column, kind) if down else column).alias("value")))
    return F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]) if parts else F.lit(0)


def _falling(column: Column, kind: T.DataType) -> Column:
    """A value that falls where the column rises."""
    if isinstance(kind, T.BooleanType):
        return ~column
    if isinstance(kind, T.DateType):
        return -F.unix_date(column)
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.struct(~F.isnan(column), -column)  # a NaN is the largest number
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # other digits for each byte, and an end that lies above them
        return F.concat(F.translate(F.hex(column.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return -column


@dataclass(frozen=True)
class Slicing:
    """Hot keys, each with the sort tuples at which its slices begin.

    ``cuts[i]`` belongs to the key values ``keys[i]``; ``backward`` says that rows are
    wanted in the reverse of the order the cuts were taken in.
    """

    names: tuple[str, ...]
    order: tuple[str, ...]
    keys: list[tuple]
    cuts: list[list]
    tuple_type: T.DataType
    backward: bool = False


def reversed_order(order: Sequence[str]) -> list[str]:
    return [o[1:] if o.startswith("-") else f"-{o}" for o in order]


def slicing(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> Slicing | None:
    """The hot keys of a table and their cut points; None when there are none.

    One column-pruned job over a seeded sample with about ``SAMPLES`` rows for each slice.
    A key whose share of the sample stays below three quarters of a slice is no hot key; one
    with a whole slice of rows is missed once in some hundred thousand cases, and then only
    served by the plain window. The answer is kept with the DataFrame, so operators that
    add columns to the same rows ask once.
    """
    limit, known = rows_per_slice(df), _answers(df)
    names, order = tuple(keys), tuple(order)
    for (n, o, rows), found in known.items():
        if n is None and rows == limit:  # too few rows for any hot key
            return None
        if n == names and rows == limit and (o == order or not order):
            return found
        if n == names and rows == limit and list(o) == reversed_order(order):
            return found and replace(found, order=order, backward=not found.backward)
    bound = row_bound(df.sparkSession, df._jdf.queryExecution().optimizedPlan(), limit)
    if bound is not None and bound <= limit:
        known[None, (), limit] = None
        return None
    known[names, order, limit] = found = _sampled_cuts(df, names, order, limit)
    return found


#: Plan nodes that give no more rows than they get.
_NARROWING = {"Project", "Filter", "Aggregate", "Window", "Sort", "Distinct", "Deduplicate", "SubqueryAlias", "Repartition", "RepartitionByExpression", "RebalancePartitions", "LocalLimit", "GlobalLimit"}


def row_bound(spark: SparkSession, plan, limit: int) -> int | None:
    """A proven upper bound of a plan's rows, or None; a table of no more rows than a slice has no hot key.

    Table sizes come from the footers of Parquet files, and nodes whose output cannot outgrow
    their input pass the bound on. Sums and products stop being of use above the limit.
    """
    known = plan.maxRows()
    if known.isDefined():
        return int(str(known.get()))
    name = plan.nodeName()
    children = plan.children()
    inner = [row_bound(spark, children.apply(i), limit) for i in range(children.size())] if name != "LogicalRelation" else []
    if None in inner:
        return None
    if name == "LogicalRelation":
        relation = plan.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
            return None
        files = list(relation.location().inputFiles())
        return spark.read.parquet(*files).count() if 0 < len(files) <= 64 else None  # footers alone
    if name in _NARROWING:
        return inner[0]
    if name == "Union":
        return sum(inner)
    if name == "Join":
        kind = plan.joinType().toString()
        return inner[0] if kind in ("LeftSemi", "LeftAnti") else inner[0] * inner[1] + inner[0] + inner[1]
    if name == "Generate":  # a list written out in the query
        items = plan.generator().children()
        listed = items.size() == 1 and items.apply(0).getClass().getSimpleName() == "CreateArray"
        return inner[0] * items.apply(0).children().size() if listed else None
    if name == "Expand":
        return inner[0] * plan.projections().size()
    return None


def _sampled_cuts(df: DataFrame, names: tuple[str, ...], order: tuple[str, ...], limit: int) -> Slicing | None:
    share = min(1.0, SAMPLES / limit)
    least = limit + 1 if share == 1 else round(0.75 * SAMPLES)
    slim = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(names)], sort_tuple(df, order).alias("t"))
    drawn = slim.sample(share, seed=7) if share < 1 else slim
    group = [f"k{i}" for i in range(len(names))]
    counted = drawn.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("t")).alias("all")).where(F.col("n") >= least)
    step = max(1, (limit if share == 1 else SAMPLES) // 2)
    picked = F.transform(F.sequence(F.lit(step), F.col("n").cast("int") - 1, F.lit(step)), lambda i: F.get("all", i))
    found = counted.select(*group, F.array_distinct(picked).alias("cuts")).collect()  # a cut for each half slice of hot rows
    if not found:
        return None
    return Slicing(names, order, [tuple(r[g] for g in group) for r in found], [list(r["cuts"]) for r in found], slim.schema["t"].dataType)


def _answers(df: DataFrame) -> dict:
    if "_tablemill_hot" not in df.__dict__:
        df.__dict__["_tablemill_hot"] = {}
    return df.__dict__["_tablemill_hot"]


def spread(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Deal rows out by their keys to as many tasks as they fill slices, where Spark's setting has fewer.

    Only for tables whose size is given or known from Parquet files; hot keys are left to their slices.
    """
    bound = rows if rows is not None else row_bound(df.sparkSession, df._jdf.queryExecution().optimizedPlan(), rows_per_slice(df))
    tasks = -(-bound // rows_per_slice(df)) if bound else 1
    if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) or slicing(df, keys, order) is not None:
        return df
    return same_rows(df.repartition(tasks, *[F.col(k) for k in keys]), df)


def same_rows(out: DataFrame, source: DataFrame) -> DataFrame:
    """Declare that a DataFrame has the rows and keys of another one."""
    out.__dict__["_tablemill_hot"] = _answers(source)
    return out


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key, in which null keys match; a hot key's rows stay where they are.

    Rows of hot keys meet a broadcast of the hot part of the table, at most one row for each
    hot key; only the others are shuffled.
    """
    cuts = slicing(df, keys) if keys else None
    if cuts is None:
        return join_on_keys(df, table, keys)
    hot = _hot_flag(table, keys, cuts).where("_hot").drop("_hot")
    flagged = _hot_flag(df, keys, cuts)
    near = join_on_keys(flagged.where("_hot"), F.broadcast(hot), keys)
    far = join_on_keys(flagged.where(~F.col("_hot")), _hot_flag(table, keys, cuts).where(~F.col("_hot")).drop("_hot"), keys)
    return near.unionByName(far).drop("_hot")


def _hot_flag(df: DataFrame, keys: Sequence[str], cuts: Slicing) -> DataFrame:
    if not keys:
        return df.withColumn("_hot", F.lit(True))
    schema = T.StructType([df.schema[k] for k in keys])
    table = F.broadcast(df.sparkSession.createDataFrame(cuts.keys, schema).withColumn("_hot", F.lit(True)))  # one row for each hot key
    return join_on_keys(df, table, keys).withColumn("_hot", F.coalesce("_hot", F.lit(False)))


def hot_rows(df: DataFrame, keys: Sequence[str], cuts: Slicing, hot: bool) -> DataFrame:
    """The rows of a table whose key is (or is not) hot."""
    return _hot_flag(df, keys, cuts).where(F.col("_hot") == F.lit(hot)).drop("_hot")


def _sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Slicing) -> DataFrame:
    """Add ``_hot`` and ``_slice``; slice numbers follow the sort order inside a key.

    The cut points of a key form a search tree with ``FAN`` branches; a level of it is a
    broadcast table with one row for each child of its nodes and the bounds the child lies
    between, so a row meets at most ``FAN`` of them at a time however many cuts its key has.
    """
    taken_in = reversed_order(order) if cuts.backward else order
    out = _hot_flag(df, keys, cuts).withColumns({"_slice_at": sort_tuple(df, taken_in), "_slice_node": F.lit(0)})
    most = max(map(len, cuts.cuts))
    depth = 1
    while FAN**depth <= most:
        depth += 1
    schema = T.StructType(
        [*[T.StructField(f"_h{i}", df.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("_slice_n", T.IntegerType()), T.StructField("_child", T.IntegerType()), T.StructField("_low", cuts.tuple_type), T.StructField("_high", cuts.tuple_type)]
    )
    for level in range(depth):
        stride = FAN ** (depth - 1 - level)
        nodes = []
        for key, points in zip(cuts.keys, cuts.cuts):
            marks = points[stride - 1 :: stride]  # what parts the children of all nodes of this level, and nodes from each other
            for low in range(0, len(marks), FAN):
                bounds = [None, *marks[low : low + FAN - 1], None]
                nodes += [(*key, low // FAN, i, *bounds[i : i + 2]) for i in range(len(bounds) - 1)]
        table = F.broadcast(df.sparkSession.createDataFrame(nodes, schema))
        same = F.col("_slice_node") == F.col("_slice_n")
        same = same & (F.col("_low").isNull() | (F.col("_low") <= F.col("_slice_at"))) & (F.col("_high").isNull() | (F.col("_slice_at") < F.col("_high")))
        for i, k in enumerate(keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_h{i}"))
        child = F.coalesce("_child", F.lit(0))
        out = out.join(table, same, "left").withColumn("_slice_node", F.col("_slice_node") * FAN + child).drop("_slice_n", "_child", "_low", "_high", *[f"_h{i}" for i in range(len(keys))])
    return out.withColumn(_SLICE, -F.col("_slice_node") if cuts.backward else F.col("_slice_node")).drop("_slice_at", "_slice_node")


_MERGE: dict[str, tuple[Callable, Callable]] = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "count": (F.count, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Add running aggregates (first row of the group up to the current row).

    ``columns`` maps a new name to (kind, input); kinds: sum, count, min, max, last
    (last non-null).
    """
    frame = (Window.unboundedPreceding, Window.currentRow)
    cuts = slicing(df, keys, order)
    if cuts is None:
        spec = window(keys, order).rowsBetween(*frame)
        return same_rows(df.withColumns({n: _MERGE[k][0](c).over(spec) for n, (k, c) in columns.items()}), df)
    parts = _sliced(df, keys, order, cuts)
    inputs = {f"_in_{n}": c for n, (_, c) in columns.items()}
    parts = parts.withColumns(inputs)
    group = [*keys, _SLICE]
    local = window(group, order).rowsBetween(*frame)
    inside = parts.withColumns({f"_loc_{n}": _MERGE[k][0](F.col(f"_in_{n}")).over(local) for n, (k, _) in columns.items()})
    totals = []
    for n, (k, _) in columns.items():
        source = F.col(f"_in_{n}")
        if k == "last":
            totals.append(F.max_by(source, F.when(source.isNotNull(), sort_tuple(df, order))).alias(f"_tot_{n}"))
        else:
            totals.append(_MERGE[k][0](source).alias(f"_tot_{n}"))
    carry = parts.where("_hot").groupBy(*group).agg(*totals)
    before = window(keys, [_SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    outer = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": _MERGE["last"][0]}
    carry = carry.select(*group, *[outer[k](F.col(f"_tot_{n}")).over(before).alias(f"_pre_{n}") for n, (k, _) in columns.items()])
    joined = join_on_keys(inside, F.broadcast(carry), group)  # one row for each slice of a hot key
    result = joined.withColumns({n: _MERGE[k][1](F.col(f"_loc_{n}"), F.col(f"_pre_{n}")) for n, (k, _) in columns.items()})
    extra = [f"{p}{n}" for n in columns for p in ("_in_", "_loc_", "_pre_")]
    return same_rows(result.drop("_hot", _SLICE, *extra), df)


def affine(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Add running states z = factor * (state of the row before) + offset.

    ``columns`` maps a new name to (factor, offset, seed). A row with a null offset leaves the
    state as it is; the state ahead of a group's first other row is that row's seed, and rows
    before it have none. Steps compose, (f, o) after (f', o') is (f f', f o' + o), so each
    slice of a hot key is scanned by itself and the state before it is applied afterwards.
    A scan streams over sorted rows and holds one Arrow batch.
    """
    cuts = slicing(df, keys, order)
    parts = df if cuts is None else _sliced(df, keys, order, cuts)
    group = [*keys] if cuts is None else [*keys, _SLICE]
    steps = {}
    for n, (f, o, q) in columns.items():
        steps |= {f"_f_{n}": F.when(o.isNotNull(), f.cast("double")).otherwise(1.0), f"_o_{n}": o.cast("double"), f"_q_{n}": F.when(o.isNotNull(), q.cast("double"))}
    scanned = _scan(parts.withColumns(steps), group, order, list(columns))
    if cuts is None:
        return same_rows(scanned.select(*df.columns, *[F.col(f"_z_{n}").alias(n) for n in columns]), df)
    # a slice as one step: one row a slice, scanned the same way, hands its state to the next slice
    whole = [c for n in columns for c in (F.col(f"_f_{n}"), F.when(F.col(f"_z_{n}").isNotNull(), F.col(f"_o_{n}")).alias(f"_o_{n}"), F.col(f"_q_{n}"))]
    last = F.max_by(F.struct(*whole), sort_tuple(scanned, order)).alias("_end")
    ends = _scan(scanned.where("_hot").groupBy(*group).agg(last).select(*group, "_end.*"), keys, [_SLICE], list(columns))
    before = window(keys, [_SLICE])
    states = ends.select(*group, *[F.lag(f"_z_{n}").over(before).alias(f"_b_{n}") for n in columns])
    joined = join_on_keys(scanned, states, group)
    state = lambda n: F.coalesce(F.col(f"_f_{n}") * F.col(f"_b_{n}") + F.col(f"_o_{n}"), f"_z_{n}")
    return same_rows(joined.select(*df.columns, *[state(n).alias(n) for n in columns]), df)


def _scan(df: DataFrame, group: Sequence[str], order: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Compose the steps (``_f_<name>``, ``_o_<name>``, ``_q_<name>``) along each group.

    Afterwards ``_f_`` and ``_o_`` are the step from ahead of the group to the row, ``_q_`` is the
    seed of the first row with an offset so far and ``_z_`` the state that follows from it.
    """
    ready = df.withColumn("_head", F.row_number().over(window(group, order)) == 1)  # brings groups together and sorts them
    made = {f"_{x}_{n}" for n in names for x in "foqz"}
    rest = [c for c in df.columns if c not in made]
    out = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(c, T.DoubleType()) for c in sorted(made)]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[float, float, float, bool]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            head = batch.column("_head").to_numpy(zero_copy_only=False)
            cells = {c: batch.column(c) for c in rest}
            for n in names:
                known = batch.column(f"_o_{n}").is_valid().to_numpy(zero_copy_only=False)
                f, o, q = (batch.column(f"_{x}_{n}").fill_null(0.0).to_numpy(zero_copy_only=False) for x in "foq")
                factor, offset, seed, seen = compose(f, o, q, known, head, held.get(n))
                held[n] = factor[-1], offset[-1], seed[-1], bool(seen[-1])
                cells |= {f"_f_{n}": pa.array(factor), f"_o_{n}": pa.array(offset), f"_q_{n}": pa.array(seed, mask=~seen), f"_z_{n}": pa.array(factor * seed + offset, mask=~seen)}
            yield pa.RecordBatch.from_arrays([cells[f.name] for f in out.fields], [f.name for f in out.fields])

    return ready.mapInArrow(work, out)


def compose(
    f: np.ndarray, o: np.ndarray, q: np.ndarray, known: np.ndarray, head: np.ndarray, before: tuple[float, float, float, bool] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inclusive scan of steps in doubling strides, begun anew at every head.

    ``before`` is what the rows ahead of row 0 came to: step, seed, and whether there was an offset.
    """
    factor, offset, closed = f.copy(), o.copy(), head.copy()
    if before is not None and not closed[0]:
        factor[0], offset[0] = factor[0] * before[0], factor[0] * before[1] + offset[0]
    closed[0] = True
    stride = 1
    while not closed.all():
        open_ = np.flatnonzero(~closed)
        back = open_ - stride
        new = factor[open_] * factor[back], factor[open_] * offset[back] + offset[open_], closed[back]
        factor[open_], offset[open_], closed[open_] = new
        stride *= 2
    # the first row with an offset of each group; group 0 goes on from the rows ahead
    group = np.cumsum(head)
    seeds, begins = np.zeros(group[-1] + 1), np.full(group[-1] + 1, len(f))
    if before is not None and before[3]:
        seeds[0], begins[0] = before[2], -1
    at = np.flatnonzero(known)
    first, place = np.unique(group[at], return_index=True)
    fresh = begins[first] >= 0
    seeds[first[fresh]], begins[first[fresh]] = q[at[place[fresh]]], at[place[fresh]]
    return factor, offset, seeds[group], np.arange(len(f)) >= begins[group]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """1-based row number inside each group (or over the whole table when no keys)."""
    return running(df, keys, order, {name: ("count", F.lit(1))})


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, bucket: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``bucket(row number, rows of the group)``, which must not fall as the number rises.

    Slices of hot keys are counted, which says at what number each begins and ends. Only where
    the bucket changes inside a slice are its rows shuffled and numbered, so what moves is a
    slice for each bucket, whatever the number of rows.
    """
    cuts = slicing(df, keys, order)
    if cuts is None:
        ranked = attach(numbered(df, keys, order, "_no"), keys, {"_all": F.count(F.lit(1))})
        return same_rows(ranked.withColumn(name, bucket(F.col("_no"), F.col("_all"))).drop("_no", "_all"), df)
    parts = _sliced(df, keys, order, cuts)
    group = [*keys, _SLICE]
    sizes = parts.where("_hot").groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(window(keys, [_SLICE]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select(*group, "_rows", before.alias("_before"), F.sum("_rows").over(window(keys)).alias("_all"))
    first, last = bucket(F.col("_before") + 1, F.col("_all")), bucket(F.col("_before") + F.col("_rows"), F.col("_all"))
    places = settle(places.select(*group, "_before", "_all", first.alias(name), first.eqNullSafe(last).alias("_steady")), "places")
    placed = join_on_keys(parts, F.broadcast(places), group)
    steady = F.coalesce("_steady", F.lit(False))
    number = F.row_number().over(window(group, order)) + F.coalesce("_before", F.lit(0))
    among = F.coalesce("_all", F.count(F.lit(1)).over(window(group)))
    moved = placed.where(~steady).withColumns({"_no": number, "_among": among}).withColumn(name, bucket(F.col("_no"), F.col("_among")))
    out = [*[F.col(f"`{c}`") for c in df.columns], F.col(name)]
    return same_rows(placed.where(steady).select(*out).unionByName(moved.select(*out)), df)


def bounded(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """Window expressions that look at most ``before`` rows back and ``after`` ahead.

    Each expression receives the window spec. Slices of hot keys are extended by copies
    of the neighbouring edge rows, which are dropped again after the window.
    """
    cuts = slicing(df, keys, order)
    if cuts is None:
        spec = window(keys, order)
        return same_rows(df.withColumns({n: f(spec) for n, f in columns.items()}), df)
    parts = _sliced(df, keys, order, cuts)
    group = [*keys, _SLICE]
    body = [c for c in df.columns if c not in keys]
    forward = window(group, order)
    backward = window(group, reversed_order(order))
    edges = []
    if before:
        edges.append(_edge_rows(parts, keys, group, body, backward, before, -1))
    if after:
        edges.append(_edge_rows(parts, keys, group, body, forward, after, 1))
    everything = parts.drop("_hot").withColumn("_copy", F.lit(False))
    for e in edges:
        everything = everything.unionByName(e)
    done = everything.withColumns({n: f(forward) for n, f in columns.items()})
    return same_rows(done.where(~F.col("_copy")).drop("_copy", _SLICE), df)


def _edge_rows(parts, keys, group, body, spec, rows, side) -> DataFrame:
    """For every slice of a hot key, copies of the ``rows`` rows next to it on one side."""
    edge = parts.where("_hot").withColumn("_no", F.row_number().over(spec)).where(F.col("_no") <= rows)
    held = edge.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_no", *body))).alias("_edge"))
    frame = window(keys, [_SLICE])
    if side < 0:
        near = F.reverse(F.collect_list("_edge").over(frame.rowsBetween(-rows, -1)))
    else:
        near = F.collect_list("_edge").over(frame.rowsBetween(1, rows))
    held = held.select(*group, near.alias("_near"))
    copies = held.select(*group, F.explode(F.slice(F.flatten("_near"), 1, rows)).alias("_row"))
    return copies.select(*group, *[F.col(f"_row.`{c}`").alias(c) for c in body], F.lit(True).alias("_copy"))


def attach(
    df: DataFrame, keys: Sequence[str], columns: Mapping[str, Column], pre_grouped: bool = False, order: Sequence[str] = ()
) -> DataFrame:
    """Add group aggregates to every row (no distinct aggregates).

    With ``pre_grouped`` the aggregates come from a grouping joined back, whatever the
    group sizes; otherwise only hot keys need that. ``order`` names the sort of a later
    window on the same keys, so that both share one sort and one look for hot keys.
    """
    if not keys:
        totals = df.agg(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_t")).scalar()
        out = df.withColumn("_t", totals).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"_t.`{n}`").alias(n) for n in columns])
    elif not pre_grouped and slicing(df, keys, order) is None:
        spec = window(keys, order)
        spec = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order else spec
        out = df.withColumns({n: c.over(spec) for n, c in columns.items()})
    else:
        grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])
        out = join_on_keys(df, grouped, keys) if pre_grouped else lookup(df, grouped, keys)
    return same_rows(out, df)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 1) -> DataFrame:
    """First k rows of each group. Spark keeps k rows per group before the shuffle."""
    if not keys:
        return df.orderBy(*order_columns(order)).limit(k)
    ranked = df.withColumn("_no", F.row_number().over(window(keys, order)))
    return ranked.where(F.col("_no") <= k).drop("_no")


def most_common(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n): most frequent non-null value per group, smallest value on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return top_rows(counts, keys, ["-n", value])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, nulls skipped.

    Groups that fit in a task use Spark's exact ``percentile``. Hot groups are counted
    per distinct value and the wanted ranks are read off the running counts.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(shares)
    cuts = slicing(known, keys)
    if cuts is None:
        got = known.groupBy(*keys).agg(F.percentile("_v", [float(shares[n]) for n in names]).alias("_q"))
        return got.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    flagged = _hot_flag(known, keys, cuts)
    counts = flagged.where("_hot").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, ["_v"], {"_upto": ("sum", F.col("_n"))})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    ranked = join_on_keys(ranked, totals, keys) if keys else ranked.withColumn("_all", totals.scalar())
    aggs = []
    for i, n in enumerate(names):
        spot = F.lit(float(shares[n])) * (F.col("_all") - 1)
        for tag, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("_upto") >= rank + 1) & (F.col("_upto") - F.col("_n") < rank + 1)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("_all").alias("_all"), *aggs)
    picked = []
    for i, n in enumerate(names):
        spot = F.lit(float(shares[n])) * (F.col("_all") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        picked.append((low + (high - low) * (spot - F.floor(spot))).alias(n))
    warm = found.select(*keys, *picked)
    if not keys:
        return warm
    cold = flagged.where(~F.col("_hot")).groupBy(*keys).agg(F.percentile("_v", [float(shares[n]) for n in names]).alias("_q"))
    return warm.unionByName(cold.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]))


def tie_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): tie count ``n``, rows below, dense rank, average rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, keys, [value], {"_upto": ("sum", F.col("n")), "dense": ("count", F.lit(1))})
    below = F.col("_upto") - F.col("n")
    return ranked.withColumns({"below": below, "avg_rank": below + (F.col("n") + 1) / 2}).drop("_upto")
