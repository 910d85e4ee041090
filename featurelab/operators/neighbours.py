"""K-nearest-neighbour classification by boxes of near training rows, or by tiles of a distance kernel.

Training rows are cut into small leaves (halves by the widest column).  A test row first meets
the leaves nearest to it, then only those whose box is no further than its k-th best so far.
The bound is summed as the distances are, and rounding is monotone, so no neighbour is lost.
Where the boxes exclude too little (many columns), distances are computed tile by tile (test
rows x training rows).  Either way the neighbours are the same.

A model of few rows travels to the test rows, which are dealt evenly over tasks.  Beyond
``HELD_ROWS`` the training rows stay on the executors, in cells of about that many near rows.
A test row meets the cell nearest to it, then every other cell whose box is no further than
its k-th best, and the best of all are merged: the neighbours among all rows, while a task
holds one cell and one block of test rows whatever the table sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurelab.functions.keyed import keyed_uniform
from featurelab.functions.ranks import row_position
from featurelab.functions.wide import q
from featurelab.session import TASKS_PER_CORE, cut_lineage, dealt, ship_package

#: The bound that ``j5_nearest_neighbours`` names in its SQL and asks for; nothing else is bounded.
MAX_TRAIN_ROWS = 20_000
#: Training rows of a model that travels to the test rows (8 * F * HELD_ROWS bytes on the driver and
#: twice that in every worker), and of a cell otherwise; twice as many at most.
HELD_ROWS = 20_000
#: Rows drawn per cell, and numbers at most, from which the borders of the cells are found.
DRAWN_PER_CELL, DRAWN_NUMBERS = 64, 1 << 21
#: Numbers in the test rows that are worth another copy of a cell.
WORTH_A_COPY = 1 << 18
TILE_TEST, TILE_TRAIN = 64, 1024
#: The same for sums of steps (long rows of a tile cost less a number), and training rows measured before steps exclude others.
STEP_TEST, STEP_TRAIN, FIRST_TRAIN = 16, 4096, 128
#: Test rows that go through the leaves together and of which bounds are summed together, most rows of a leaf, numbers gathered at a time.
BLOCK_TEST, BOUNDED, LEAF, GATHERED = 256, 32, 32, 1 << 19
#: Leaves are given up for tiles when more than this share of them is left after the first bound.
MOST_LEFT = 0.25


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """Minkowski distances (p-th power of them) of all rows of ``a`` to all of ``b``, summed in column order."""
    out, d = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    for j in range(a.shape[1]):
        np.abs(np.subtract(a[:, j, None], b[None, :, j], out=d), out=d)
        out += d if p == 1 else d ** p
    return out


def _smallest(rows: np.ndarray, dist: np.ndarray, index: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the ``k`` smallest (distance, index) of each of ``n`` rows, which have ``k`` or more."""
    order = np.lexsort((index, dist, rows))
    at = order[np.searchsorted(rows[order], np.arange(n))[:, None] + np.arange(k)]
    return index[at], dist[at]


def _improve(index: np.ndarray, best: np.ndarray, rows: np.ndarray, dist: np.ndarray, new: np.ndarray, k: int) -> None:
    """Merge the candidates (row, distance, training row) into the ``k`` best of their rows."""
    touched, at = np.unique(rows, return_inverse=True)
    old = np.repeat(np.arange(len(touched)), k)
    index[touched], best[touched] = _smallest(np.concatenate((old, at)), np.concatenate((best[touched].ravel(), dist)),
                                              np.concatenate((index[touched].ravel(), new)), len(touched), k)


def nearest(a: np.ndarray, train: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the ``k`` nearest training rows of each row of ``a``; equal
    distances go to the earlier training row."""
    k, n = min(k, len(train)), len(a)
    index, best = np.zeros((n, 0), np.int64), np.zeros((n, 0))
    for lo in range(0, len(train), TILE_TRAIN):
        d = _distances(a, train[lo:lo + TILE_TRAIN], p)
        have = best.shape[1]
        if have == k:                    # only what the tile improves is merged; ties keep what stands first
            r, c = np.nonzero(~(d >= best[:, -1:]))
            if len(r):
                _improve(index, best, r, d[r, c], lo + c, k)
            continue
        want = min(k, have + d.shape[1])
        r, c = np.nonzero(~(d > np.partition(d, want - 1, axis=1)[:, want - 1, None]) if want <= d.shape[1] else np.ones(d.shape, bool))
        old = np.repeat(np.arange(n), have)
        index, best = _smallest(np.concatenate((old, r)), np.concatenate((best.ravel(), d[r, c])),
                                np.concatenate((index.ravel(), lo + c)), n, want)
    return index, best


@dataclass
class Leaves:
    """Training rows in small boxes: ``x`` (leaf, column, place), ``row`` (leaf, place; one past
    the last where empty), the bounds ``lo`` and ``hi`` (column, leaf) of each, and the rows of the smallest leaf."""

    x: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    smallest: int


def _first_of_equal(train: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of equal rows, ascending; they win every tie."""
    _, group = np.unique(train, axis=0, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    group = group.ravel()[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(group, group) < k])


def make_leaves(train: np.ndarray, k: int) -> Leaves | None:
    """Leaves of at most ``LEAF`` rows.  Of equal training rows the first ``k`` suffice.
    None if a number is not finite or there are no rows."""
    if not train.size or not np.isfinite(train).all():
        return None
    parts, todo = [], [_first_of_equal(train, k)]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            parts.append(np.sort(at))
            continue
        x = train[at]
        with np.errstate(over="ignore"):
            at = at[np.argpartition(x[:, np.argmax(np.ptp(x, axis=0))], len(at) // 2)]
        todo += [at[:len(at) // 2], at[len(at) // 2:]]
    width = max(len(at) for at in parts)
    x, row = np.full((len(parts), train.shape[1], width), np.inf), np.full((len(parts), width), len(train), np.int64)
    for i, at in enumerate(parts):
        x[i, :, :len(at)], row[i, :len(at)] = train[at].T, at
    return Leaves(x, row, np.array([train[at].min(axis=0) for at in parts]).T.copy(),
                  np.array([train[at].max(axis=0) for at in parts]).T.copy(), min(len(at) for at in parts))


def box_bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: int) -> np.ndarray:
    """Least distance of each row of ``a`` to each box (column, box), summed as distances are.
    Powers other than 2 may be rounded either way; their bounds are a little lower."""
    bound, spare = np.zeros((len(a), lo.shape[1])), np.empty((BOUNDED, lo.shape[1]))
    for at in range(0, len(a), BOUNDED):  # a few rows at a time stay in the processor's cache
        total, x = bound[at:at + BOUNDED], a[at:at + BOUNDED]
        gap = spare[:len(x)]
        for j in range(len(lo)):         # the distance to a box is that to its nearest point
            v = x[:, j, None]
            np.minimum(np.maximum(v, lo[j], out=gap), hi[j], out=gap)
            np.abs(np.subtract(gap, v, out=gap), out=gap)
            total += gap if p == 1 else gap ** p
    return bound if p in (1, 2) else bound * (1 - 1e-9)


def nearest_by_leaves(a: np.ndarray, leaves: Leaves, k: int, p: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``nearest``, for finite rows, p of 1 or 2 and no more neighbours than training rows;
    None if too many leaves are left after the first bound.  Neighbours beyond the ``limit``
    of a row may be others."""
    n, (n_leaves, dim, width) = len(a), leaves.x.shape

    def gathered(r: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        x, out = leaves.x[leaf], np.zeros((len(r), width))
        for j in range(dim):
            d = np.abs(a[r, j, None] - x[:, j])
            out += d if p == 1 else d ** p
        return out

    bound = box_bounds(a, leaves.lo, leaves.hi, p)
    m = min(n_leaves, -(-k // leaves.smallest) + 1)
    near = np.argpartition(bound, m - 1, axis=1)[:, :m] if m < n_leaves else np.broadcast_to(np.arange(n_leaves), (n, n_leaves))
    r = np.repeat(np.arange(n), m)
    step = max(1, GATHERED // (dim * width))
    d = np.concatenate([gathered(r[lo:lo + step], near.ravel()[lo:lo + step]) for lo in range(0, len(r), step)])
    index, best = _smallest(np.repeat(r, width), d.ravel(), leaves.row[near].ravel(), n, k)
    left = bound <= (best[:, -1:] if limit is None else np.minimum(best[:, -1], limit)[:, None])
    left[np.arange(n)[:, None], near] = False
    r, leaf = np.nonzero(left)
    if len(r) > MOST_LEFT * left.size:
        return None
    for lo in range(0, len(r), step):
        rows, at = r[lo:lo + step], leaf[lo:lo + step]
        d = gathered(rows, at)
        i, j = np.nonzero(d <= best[rows, -1, None])
        if len(i):
            _improve(index, best, rows[i], d[i, j], leaves.row[at[i], j], k)
    return index, best


@dataclass
class Steps:
    """Finite training rows as whole ``step``s above ``lo``, the least of each column: ``at``
    (column, row), so few that sums of all columns fit 16 bits, and the ``rest`` of each row, the sum of what rounding took."""

    at: np.ndarray
    rest: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    step: float

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps and rest of other rows.  Numbers outside a column's range move to its end: no distance grows."""
        x = np.clip(x, self.lo, self.hi) - self.lo
        at = np.rint(x / self.step)
        return at.astype(np.int16), np.abs(x - at * self.step).sum(axis=1)


def make_steps(train: np.ndarray) -> Steps | None:
    """None if there is no range to cut, or more columns than a sum of 16 bits can tell apart."""
    most = np.iinfo(np.int16).max // train.shape[1] - 1
    if not len(train) or most < 100:
        return None
    lo, hi = train.min(axis=0), train.max(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        step = (hi - lo).max() / most
    if not np.isfinite(step) or step < 1e-250:
        return None
    out = Steps(np.zeros((0, 0)), np.zeros(0), lo, hi, float(step))
    at, out.rest = out.of(train)
    out.at = np.ascontiguousarray(at.T)
    return out


def nearest_by_steps(a: np.ndarray, train: np.ndarray, steps: Steps, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``nearest`` for p of 1, finite rows and no more neighbours than training rows; ``limit`` as in
    ``nearest_by_leaves``.  A distance is at least that of the steps less both rests; only rows
    that this lets in are measured."""
    have = min(len(train), max(k, FIRST_TRAIN))
    index, best = nearest(a, train[:have], k, 1)
    at, rest = steps.of(a)
    whole, gap = np.empty((len(a), STEP_TRAIN), np.int16), np.empty((len(a), STEP_TRAIN), np.int16)
    for lo in range(have, len(train), STEP_TRAIN):
        other = steps.at[:, lo:lo + STEP_TRAIN]
        total, d = whole[:, :other.shape[1]], gap[:, :other.shape[1]]
        total[:] = 0
        for j in range(len(other)):
            np.abs(np.subtract(at[:, j, None], other[j], out=d), out=d)
            total += d
        worst = best[:, -1] if limit is None else np.minimum(best[:, -1], limit)
        # a step more, and a little, than rounding of these few sums could take
        most = (worst * (1 + 1e-9) + rest + steps.rest[lo:lo + STEP_TRAIN].max()) / steps.step * (1 + 1e-9) + 1
        r, c = np.nonzero(total <= np.minimum(most, np.iinfo(np.int16).max).astype(np.int16)[:, None])
        if not len(r):
            continue
        dist = np.zeros(len(r))
        for d in np.abs(a.T[:, r] - train.T[:, lo + c]):     # in column order, as all distances
            dist += d
        nearer = dist < best[r, -1]
        if nearer.any():
            _improve(index, best, r[nearer], dist[nearer], lo + c[nearer], k)
    return index, best


class Search:
    """The ``k`` nearest of the training rows ``x``, by leaves as long as they exclude enough, else by tiles (of steps, if p is 1)."""

    def __init__(self, x: np.ndarray, leaves: Leaves | None, k: int, p: int):
        self.x, self.leaves, self.k, self.p = x, leaves, min(k, len(x)), p
        self.steps: Steps | None = None

    def __call__(self, a: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index and distance of the neighbours of each row of ``a``, as ``nearest``; see ``nearest_by_leaves``."""
        finite = len(a) > 0 and np.isfinite(a).all()
        if self.leaves is not None and finite:
            got = nearest_by_leaves(a, self.leaves, self.k, self.p, limit)
            if got is not None:
                return got
            # boxes that exclude little here do so in the other rows too
            self.leaves, self.steps = None, make_steps(self.x) if self.p == 1 else None
        if self.steps is not None and finite:
            parts = [nearest_by_steps(a[lo:lo + STEP_TEST], self.x, self.steps, self.k, None if limit is None else limit[lo:lo + STEP_TEST])
                     for lo in range(0, len(a), STEP_TEST)]
        else:
            parts = [nearest(a[lo:lo + TILE_TEST], self.x, self.k, self.p) for lo in range(0, len(a), TILE_TEST)]
        return (np.concatenate([np.zeros((0, self.k), np.int64), *[i for i, _ in parts]]),
                np.concatenate([np.zeros((0, self.k)), *[d for _, d in parts]]))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """An array column without null rows; null numbers are NaN."""
    flat = batch.column(name).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)


def _lists(values: np.ndarray, good: np.ndarray) -> pa.ListArray:
    """A list per row, null where not ``good``; ``values`` has the good rows."""
    ends = np.concatenate(([0], np.cumsum(good * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~good))


@dataclass
class NeighbourModel:
    """Training rows in key order; ``classes`` ascending, ``label`` the class number of each row."""

    features: list[str]
    x: np.ndarray
    label: np.ndarray
    classes: list[float]
    keys: list
    k: int
    p: int

    def predict(self, test: DataFrame, keep: list[str], deal: bool = True) -> DataFrame:
        """``keep`` columns of every test row, with ``prediction`` (the class of most
        neighbours, the smallest of equals), ``probability`` (share of the neighbours of each
        class, ascending) and ``neighbours`` (positions in ``keys``).  A row with a null
        feature has null in all three, as has every row if the model has no rows.  Without
        ``deal`` the rows stay in the tasks that hold them, where they should be spread evenly."""
        spark = test.sparkSession
        ship_package(spark)
        k, p = min(self.k, len(self.x)), self.p
        model = spark.sparkContext.broadcast((np.asfortranarray(self.x), self.label, make_leaves(self.x, k) if p in (1, 2) else None))
        n_classes, classes = len(self.classes), np.array(self.classes)
        src = test.select(*[q(c) for c in keep], F.array(*[q(f).cast("double") for f in self.features]).alias("_x"))
        schema = T.StructType([*src.schema.fields[:-1], T.StructField("prediction", T.DoubleType()),
                               T.StructField("probability", T.ArrayType(T.DoubleType())),
                               T.StructField("neighbours", T.ArrayType(T.LongType()))])
        dim = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            train, label, leaves = model.value
            search = Search(train, leaves, k, p)
            for whole in batches:
                for lo in range(0, whole.num_rows, BLOCK_TEST):
                    batch = whole.slice(lo, BLOCK_TEST)
                    x = _matrix(batch, "_x", dim)
                    good = ~np.isnan(x).any(axis=1) & bool(len(train))
                    index = search(x[good])[0]
                    votes = np.zeros((len(index), n_classes))
                    np.add.at(votes, (np.arange(len(index))[:, None], label[index]), 1.0)
                    win = np.zeros(batch.num_rows)
                    win[good] = classes[votes.argmax(axis=1)] if len(index) else []
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:-1], pa.array(win, mask=~good), _lists(votes / max(k, 1), good), _lists(index, good)],
                        [f.name for f in schema.fields])

        return (dealt(src) if deal else src).mapInArrow(run, schema)


@dataclass
class Borders:
    """A tree of halves: a row goes to the second child of a node where its number in ``column``
    is above ``value``, until it comes to a node without a column, which has a ``cell``."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    cell: np.ndarray

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(todo := np.flatnonzero(self.column[at] >= 0)):
            node = at[todo]
            at[todo] = self.child[node, (x[todo, self.column[node]] > self.value[node]).astype(int)]
        return self.cell[at]


def make_borders(drawn: np.ndarray, n_cells: int) -> Borders:
    """At most ``n_cells`` cells with about equally many of the ``drawn`` rows, cut across the widest column."""
    column, value, child, cell = [], [], [], []

    def grow(at: np.ndarray, cells: int) -> int:
        me = len(column)
        column.append(-1), value.append(0.0), child.append((0, 0)), cell.append(0)
        x = drawn[at]
        c = int(np.argmax(np.ptp(x, axis=0))) if cells > 1 and len(at) > 1 else -1
        v = np.sort(x[:, c]) if c >= 0 else np.zeros(1)
        if v[0] == v[-1]:
            cell[me] = cell_count[0]
            cell_count[0] += 1
            return me
        cut = v[max(1, len(v) * (cells // 2) // cells) - 1]
        cut = cut if cut < v[-1] else v[np.searchsorted(v, v[-1]) - 1]
        low = x[:, c] <= cut
        some = min(cells - 1, max(1, round(cells * low.mean())))
        column[me], value[me] = c, cut
        child[me] = (grow(at[low], some), grow(at[~low], cells - some))
        return me
    cell_count = [0]
    # only where the borders lie depends on the drawn rows: far numbers may be cut here
    drawn = np.clip(drawn, -1e300, 1e300)
    grow(np.arange(len(drawn)), n_cells)
    return Borders(np.array(column), np.array(value), np.array(child), np.array(cell))


def _numbers(values) -> Column:
    """A literal array of integers, one node of the plan whatever its length."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


@dataclass
class CellModel:
    """All training rows, stored: ``rows`` holds _cell, _row (in which equal distances are ordered:
    the key if it is an integer, else its position), _y, _x.  ``lo`` and ``hi`` (column, cell) are the boxes."""

    features: list[str]
    rows: DataFrame
    classes: list[float]
    lo: np.ndarray
    hi: np.ndarray
    k: int
    p: int

    def _meet(self, test: DataFrame, cell: str, answer: Callable, schema: T.StructType) -> DataFrame:
        """``answer`` (rows of ``test``, the cell they meet as a ``Search``, its _row and _y) of every row.

        The rows of a cell are dealt over as many copies of it as evens out the tasks.  A task
        gets a group's training rows first, then streams its test rows."""
        spark, dim, k, p = test.sparkSession, len(self.features), self.k, self.p
        counts = np.zeros(self.lo.shape[1], np.int64)
        for c, n in test.groupBy(cell).count().collect():
            counts[c] = n
        tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        size = max(-(-int(counts.sum()) // tasks), WORTH_A_COPY // dim, 1)
        copies = -(-counts // size)
        first = np.cumsum(copies) - copies
        groups = max(1, int(copies.sum()))
        parts = min(groups, 4 * tasks)

        def of(values, at: str) -> Column:
            return F.get(_numbers(values), F.col(at))
        train = self.rows.where(of(copies, "_cell") > 0).select(
            F.explode(F.sequence(of(first, "_cell"), of(first + copies - 1, "_cell"))).alias("_group"),
            F.lit(False).alias("_asks"), "_row", "_y", "_x")
        asks = test.withColumn("_asks", F.lit(True)).withColumn(
            "_group", of(first, cell) + F.pmod(F.xxhash64("_id"), of(copies, cell).cast("long")).cast("int"))
        both = train.unionByName(asks, allowMissingColumns=True)
        both = both.repartitionById(parts, F.pmod("_group", F.lit(parts))).sortWithinPartitions("_group", "_asks")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, met = None, [], None
            for batch in batches:
                g, asking = batch.column("_group").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((g[1:] != g[:-1]) | (asking[1:] != asking[:-1])) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                    if hi == lo:
                        continue
                    if g[lo] != group:
                        group, held, met = g[lo], [], None
                    part = batch.slice(lo, hi - lo)
                    if not asking[lo]:
                        held.append((_matrix(part, "_x", dim), part.column("_row").to_numpy(), part.column("_y").to_numpy()))
                        continue
                    if met is None:      # a cell may have no rows
                        none = np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0)
                        x, row, y = (np.concatenate(c) for c in zip(none, *held))
                        order = np.lexsort((y, row))
                        x, held = np.asfortranarray(x[order]), []
                        met = Search(x, make_leaves(x, k) if p in (1, 2) else None, k, p), row[order], y[order]
                    for at in range(0, part.num_rows, BLOCK_TEST):
                        block = part.slice(at, BLOCK_TEST)
                        yield pa.RecordBatch.from_arrays(answer(block, _matrix(block, "_x", dim), *met), [f.name for f in schema.fields])
        return both.mapInArrow(run, schema)

    def predict(self, test: DataFrame, keep: list[str], deal: bool = True) -> DataFrame:
        """As ``NeighbourModel.predict``; ``neighbours`` holds values of _row.  The test rows are
        stored, and dealt to the cells they meet, with or without ``deal``."""
        spark = test.sparkSession
        ship_package(spark)
        k, p, dim, lo, hi = self.k, self.p, len(self.features), self.lo, self.hi
        src = test.select(*[q(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.array(*[q(f).cast("double") for f in self.features]).alias("_x"),
                          F.monotonically_increasing_id().alias("_id"))

        def nearest_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, "_x", dim)
                good = ~np.isnan(x).any(axis=1)
                home = np.zeros(len(x), np.int32)
                for at in range(0, len(x), BLOCK_TEST):
                    home[at:at + BLOCK_TEST] = box_bounds(x[at:at + BLOCK_TEST], lo, hi, p).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, mask=~good)], [*batch.schema.names, "_home"])
        placed = cut_lineage(src.mapInArrow(nearest_cell, T.StructType([*src.schema.fields, T.StructField("_home", T.IntegerType())])))

        def found(index: np.ndarray, dist: np.ndarray, row: np.ndarray, y: np.ndarray, ok: np.ndarray) -> list[pa.ListArray]:
            ends = pa.array(np.concatenate(([0], np.cumsum(ok.sum(axis=1)))).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(v[ok])) for v in (dist, row[index], y[index])]

        def at_home(block: pa.RecordBatch, x: np.ndarray, search: Search, row: np.ndarray, y: np.ndarray) -> list:
            index, dist = search(x)
            worst = dist[:, -1] if index.shape[1] == k else np.full(len(x), np.inf)
            more = ~(box_bounds(x, lo, hi, p) > worst[:, None])
            more[np.arange(len(x)), block.column("_home").to_numpy()] = False
            ends = pa.array(np.concatenate(([0], np.cumsum(more.sum(axis=1)))).astype(np.int32))
            return [block.column("_id"), block.column("_x"), *found(index, dist, row, y, np.ones(dist.shape, bool)), pa.array(worst),
                    pa.ListArray.from_arrays(ends, pa.array(np.nonzero(more)[1].astype(np.int32)))]

        def elsewhere(block: pa.RecordBatch, x: np.ndarray, search: Search, row: np.ndarray, y: np.ndarray) -> list:
            worst = block.column("_worst").to_numpy()
            index, dist = search(x, worst)
            ok = ~(dist > worst[:, None])
            some = ok.any(axis=1)
            return [block.column("_id").filter(pa.array(some)), *found(index[some], dist[some], row, y, ok[some])]
        lists = "_d array<double>, _r array<bigint>, _l array<double>"
        # predicted once: read for the cells still to meet and for the merge
        first = cut_lineage(self._meet(placed.where("_home IS NOT NULL").select("_id", "_x", "_home"), "_home", at_home, T.StructType.fromDDL(
            f"_id bigint, _x array<double>, {lists}, _worst double, _more array<int>")))
        visits = first.select("_id", "_x", "_worst", F.explode("_more").alias("_at"))
        others = self._meet(visits, "_at", elsewhere, T.StructType.fromDDL(f"_id bigint, {lists}"))
        every = first.select("_id", "_d", "_r", "_l").unionByName(others)
        merged = every.groupBy("_id").agg(F.flatten(F.collect_list(F.arrays_zip("_d", "_r", "_l"))).alias("_n"))
        best = merged.select("_id", F.slice(F.array_sort("_n"), 1, k).alias("_n"))
        known = F.array(*[F.lit(c) for c in self.classes])
        share = F.transform(known, lambda c: F.size(F.filter("_n", lambda r: r["_l"] == c)) / F.lit(float(k)))
        voted = best.select("_id", share.alias("probability"), F.transform("_n", lambda r: r["_r"]).alias("neighbours"))
        out = placed.join(voted, "_id", "left")
        win = F.get(known, (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))
        return out.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], win.alias("prediction"), "probability", "neighbours")


def _fit_cells(rows: DataFrame, n: int, classes: list[float], features: list[str], k: int, p: int, seed: int) -> CellModel:
    """``rows`` (_key, _y, _x) in cells of near rows; none is left out but those that k equal ones precede."""
    spark, dim = rows.sparkSession, len(features)
    ship_package(spark)
    if isinstance(rows.schema["_key"].dataType, T.IntegralType):
        number = F.coalesce(F.col("_key").cast("long"), F.lit(2 ** 63 - 1))
        rows = rows.select(number.alias("_row"), "_y", "_x")
    else:
        last = rows.withColumn("_null", F.col("_key").isNull())
        rows = row_position(last, [], "_null", ["_key", "_y"], "_row", HELD_ROWS).select("_row", "_y", "_x")
    n_cells = -(-n // HELD_ROWS)
    draw = max(1, min(DRAWN_PER_CELL * n_cells, DRAWN_NUMBERS // dim))
    drawn = rows.where(F.rand(seed) < draw / n).select("_x").toArrow().column("_x").combine_chunks().flatten()
    borders = make_borders(drawn.to_numpy(zero_copy_only=False).reshape(-1, dim), min(n_cells, max(1, draw // 8)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "_x", dim)
            order = np.lexsort((batch.column("_y").to_numpy(), batch.column("_row").to_numpy()))
            kept = order[_first_of_equal(x[order], k)]
            more = [pa.array(borders.cells_of(x[kept]).astype(np.int32)), pa.array(np.arange(len(kept), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, *more], [*batch.schema.names, "_cell", "_deal"])
    placed = cut_lineage(rows.mapInArrow(place, T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("_cell", "_deal"))])))
    each = [F.struct(F.min(F.get("_x", F.lit(j))), F.max(F.get("_x", F.lit(j)))) for j in range(dim)]
    found = placed.groupBy("_cell").agg(F.count(F.lit(1)), F.array(*each)).collect()
    # a cell that the borders left too large is dealt over several of the same box
    parts = np.ones(max(c for c, *_ in found) + 1, np.int64)
    boxes = np.full((len(parts), dim, 2), np.inf)
    for c, rows_in, box in found:
        parts[c], boxes[c] = (-(-rows_in // HELD_ROWS) if rows_in > 2 * HELD_ROWS else 1), [tuple(b) for b in box]
    first = np.cumsum(parts) - parts
    at = F.get(_numbers(first), "_cell") + F.pmod("_deal", F.get(_numbers(parts), "_cell"))
    boxes = np.repeat(boxes, parts, axis=0)
    return CellModel(list(features), placed.withColumn("_cell", at).drop("_deal"), classes, boxes[:, :, 0].T.copy(), boxes[:, :, 1].T.copy(), min(k, n), p)


def fit_neighbours(train: DataFrame, key: str, features: list[str], target: str, k: int = 6, p: int = 1,
                   max_train_rows: int | None = None, seed: int = 42) -> NeighbourModel | CellModel:
    """A model on all labelled rows of ``train``, or if a caller asks for it on the
    ``max_train_rows`` of smallest keyed random number.

    Distances are sums of absolute differences to the power ``p``; equal distances go to the
    smaller key.  Rows without a target take no part; a labelled row with a null feature is
    an error, since distances to it are not defined: impute first."""
    rows = train.where(q(target).isNotNull()).select(
        q(key).alias("_key"), q(target).cast("double").alias("_y"),
        F.array(*[q(f).cast("double") for f in features]).alias("_x"))
    n, holes, labels = rows.agg(F.count(F.lit(1)), F.count_if(F.exists("_x", lambda v: v.isNull() | F.isnan(v))), F.collect_set("_y")).first()
    if holes:
        raise ValueError(f"{holes} training rows hold a null feature")
    if max_train_rows is not None and max_train_rows < n:
        # far more than enough rows pass the first filter; the sort then takes the exact number
        wanted = (max_train_rows + 10 * max_train_rows ** 0.5 + 100) / n
        picked = rows.withColumn("_u", keyed_uniform(seed, F.lit("knn"), F.col("_key"))).where(F.col("_u") < wanted)
        rows, n = picked.orderBy("_u", "_key").limit(max_train_rows).drop("_u"), max_train_rows
    if n > HELD_ROWS:
        return _fit_cells(rows, n, np.unique(labels).tolist(), features, k, p, seed)
    t = rows.toArrow().sort_by([("_key", "ascending"), ("_y", "ascending")])
    y = t.column("_y").to_numpy()
    classes, label = np.unique(y, return_inverse=True)
    x = t.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(features))
    return NeighbourModel(list(features), x, label.astype(np.int64), classes.tolist(), t.column("_key").to_pylist(), k, p)
