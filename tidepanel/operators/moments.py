"""Moments of individuals: one Arrow pass over the panel, and everything later over its small rows.

A task takes the panel's rows as they lie, by id and time, and works on many
individuals at a time with array operations.  Per individual the pass keeps Z'X
and Z'y, packed a block of individuals a row; per partition it adds up Z'Z or
Z'HZ and keeps the triangles of X and Z.  Since Z'u = Z'y - Z'X b, clustered
weights, second steps and corrections never read rows or instruments again.
Partial sums are folded on executors, ``FAN`` to a task and round by round, until
one row of each kind is left for the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import triangle
from .instruments import CELLS, Equations, Layout, by_period, kernel_rows, of_table, whole_individuals
from .prepare import PanelFrame

#: partial rows that one task folds; each holds up to a dense square of the instruments
FAN = 16
_SCHEMA = "slot int, kind string, a binary, b binary"


def _rows(out) -> pa.RecordBatch:
    slot, kind, a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.string()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["slot", "kind", "a", "b"])


def _array(blob, *shape) -> np.ndarray:
    return np.frombuffer(blob.as_buffer() if hasattr(blob, "as_buffer") else blob, np.float64).reshape(*shape)


def fold(partial: DataFrame, shapes: dict[str, tuple], parts: int, fan: int = FAN) -> dict[str, np.ndarray]:
    """Sum partial rows of each kind; kinds 'r…' are triangles, which are stacked and reduced.

    parts: about how many partials of a kind there are; more only make some tasks fold more.
    """

    def add(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        total = None
        # in the order of slots, so that the same input gives the same sum
        order = np.argsort(group.column("slot").to_numpy(), kind="stable")
        for x in (group.column("a")[int(i)] for i in order):
            if kind.startswith("r"):
                x = _array(x, -1, shapes[kind][1])
                total = x if total is None else triangle(np.concatenate([total, x]))
            else:
                total = _array(x, -1) + (0 if total is None else total)
        return pa.table({"slot": pa.array(group.column("goal")[:1].to_pylist(), pa.int32()), "kind": [kind], "a": pa.array([total.tobytes()], pa.binary())})

    left = partial.select("slot", "kind", "a")
    while True:
        parts = -(-parts // fan)
        left = left.withColumn("goal", F.expr(f"cast(slot % {parts} as int)")).groupBy("kind", "goal").applyInArrow(add, "slot int, kind string, a binary")
        if parts == 1:
            break
    found = {r["kind"]: r["a"] for r in left.collect()}  # one row a kind
    return {kind: _array(found[kind], *((-1, shape[1]) if kind.startswith("r") else shape)) if kind in found else np.zeros(shape) for kind, shape in shapes.items()}


def weighted_sum(e: Equations) -> np.ndarray:
    """Sum over individuals of Z'HZ; H has 2 on the diagonal and -1 where one row's period follows the other's, transformed rows only."""
    d = np.flatnonzero(~e.is_level)
    z = e.z[d]
    # rows lie by individual and period: a period's successor can only be the next row
    next_ = np.flatnonzero((e.cluster[d][1:] == e.cluster[d][:-1]) & (e.t[d][1:] - e.t[d][:-1] == 1))
    cross = z[next_].T @ z[next_ + 1]
    return 2 * (z.T @ z) - cross - cross.T


def by_cluster(e: Equations) -> tuple[np.ndarray, np.ndarray]:
    """(Z'X, Z'y) of each individual that has rows."""
    order = np.argsort(e.cluster, kind="stable")
    cluster, z, x, y = e.cluster[order], e.z[order], e.x[order], e.y[order]
    start = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
    m = np.stack([np.add.reduceat(z * x[:, [j]], start, axis=0) for j in range(x.shape[1])], axis=2)
    return m, np.add.reduceat(z * y[:, None], start, axis=0)


@dataclass
class Moments:
    """Totals on the driver, and the cached rows of individuals."""

    zx: np.ndarray
    zy: np.ndarray
    first: np.ndarray  # Z'Z, or sum of Z'HZ
    r_x: np.ndarray
    r_z: np.ndarray
    n_obs: int
    each: DataFrame
    shape: tuple[int, int]
    parts: int
    cache: DataFrame

    def _over(self, shape: tuple, add) -> np.ndarray:
        """Sum of add(M, g) over blocks of individuals."""
        width, k = self.shape

        def run(batches):
            total = np.zeros(shape)
            for b in batches:
                for a, z in zip(b.column(2), b.column(3)):
                    total += add(_array(a, -1, width, k), _array(z, -1, width))
            yield _rows([(TaskContext.get().partitionId(), "s", total.tobytes(), b"")])

        return fold(self.each.mapInArrow(run, _SCHEMA), {"s": shape}, self.parts)["s"]

    def weighed(self, beta: np.ndarray, keep: list[int]) -> np.ndarray:
        """Sum over individuals of (Z'u)(Z'u)'."""

        def add(m, g):
            g = (g - m @ beta)[:, keep]
            return g.T @ g

        return self._over((len(keep), len(keep)), add)

    def correction(self, beta: np.ndarray, c: np.ndarray, keep: list[int]) -> np.ndarray:
        """Minus the sum of (g c) M + g (M'c)', g at the first step's residuals."""

        def add(m, g):
            g, m = (g - m @ beta)[:, keep], m[:, keep]
            return -np.einsum("i,ilk->lk", g @ c, m) - g.T @ np.einsum("ilk,l->ik", m, c)

        return self._over((len(keep), self.shape[1]), add)

    def release(self) -> None:
        self.cache.unpersist()


def collect_moments(frame: PanelFrame, lay: Layout, difference_weight: bool) -> Moments:
    """The one pass over the data."""
    width, k, stacked, periods, cells = lay.width, len(frame.coef_names), frame.stacked, len(frame.valid_times), by_period(lay)
    most = max(1, CELLS // max(1, width + k))

    def run(batches):
        sums = {"m": np.zeros((width, k)), "y": np.zeros(width), "s": np.zeros((width, width)), "n": np.zeros(1)}
        r_x, r_z = np.empty((0, k)), np.empty((0, width))
        slot = TaskContext.get().partitionId()
        for table in whole_individuals(batches, most):
            e = of_table(lay, cells, periods, stacked, k, table)
            if not len(e.row):
                continue
            m, g = by_cluster(e)
            yield _rows([(slot, "i", m.tobytes(), g.tobytes())])
            sums["m"] += m.sum(axis=0)
            sums["y"] += g.sum(axis=0)
            sums["n"] += len(e.row)
            sums["s"] += weighted_sum(e) if difference_weight else e.z.T @ e.z
            r_x, r_z = triangle(np.concatenate([r_x, e.x])), triangle(np.concatenate([r_z, e.z]))
        if sums["n"][0]:
            yield _rows([(slot, kind, v.tobytes(), b"") for kind, v in sums.items()] + [(slot, "rx", r_x.tobytes(), b""), (slot, "rz", r_z.tobytes(), b"")])

    out = kernel_rows(frame).mapInArrow(run, _SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the windows' exchange has as many, or fewer
    total = fold(out.filter("kind != 'i'"), {"m": (width, k), "y": (width,), "s": (width, width), "n": (1,), "rx": (0, k), "rz": (0, width)}, parts)
    return Moments(total["m"], total["y"], total["s"], total["rx"], total["rz"], int(total["n"][0]), out.filter("kind = 'i'"), (width, k), parts, out)
