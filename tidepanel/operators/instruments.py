"""Instrument layouts, the dense block of one individual, and instruments as rows.

A layout is a list of columns decided on the driver from the number of periods
and the options.  Executors fill it for many individuals at a time, from the
panel's rows as they lie: by id and time.  The same columns are also available
as (id, t, is_level, row_seq, col, val) rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..specs import AndersonHsiao, DifferenceGMM, PanelError, Spec, SystemGMM
from .prepare import PanelFrame


@dataclass(frozen=True)
class LagBlock:
    """Levels of y, ``order`` periods back, in transformed rows; column of each (period, order)."""

    columns: dict  # (tidx, order) -> column
    width: int


@dataclass(frozen=True)
class Layout:
    """Columns: lagged levels, exogenous (transformed), lagged differences, exogenous (levels)."""

    lags: LagBlock
    exog: tuple
    level_columns: dict | None  # tidx -> column, counted from 0 after the first two blocks
    level_width: int
    level_exog: bool

    @property
    def width(self) -> int:
        return self.lags.width + len(self.exog) + self.level_width + (len(self.exog) if self.level_exog else 0)

    @property
    def level_start(self) -> int:
        return self.lags.width + len(self.exog)


def lag_block(periods: int, transform: str, collapse: bool = False, max_lags: int = 999, min_lag: int = 1, max_lag: int | None = None) -> LagBlock:
    """Arellano-Bond columns.

    First differences may use y two periods back and further, orthogonal
    deviations one back; min_lag and max_lag bound the order, max_lags how many
    a period has, shallowest first.  Collapsed, an order is one column.
    """
    if max_lag is not None and min_lag > max_lag:
        raise PanelError(f"min_lag {min_lag} is above max_lag {max_lag}")
    if max_lags < 1:
        raise PanelError(f"max_lags must be at least 1, not {max_lags}")
    nearest = 2 if transform == "fd" else 1
    shallow = max(nearest, min_lag)
    deepest = min(periods - 1, max_lag if max_lag is not None else periods)
    columns, width = {}, 0
    for t in range(nearest + 1, periods + 1):
        for order in range(shallow, min(t - 1, deepest, shallow + max_lags - 1) + 1):
            if collapse:
                columns[t, order] = order - shallow
            else:
                columns[t, order] = width
                width += 1
    if collapse:
        width = min(max_lags, max(0, deepest - shallow + 1)) if periods > nearest else 0
    return LagBlock(columns, width)


def layout(spec: Spec, frame: PanelFrame, *, collapse: bool = False, max_lags: int = 999, min_lag: int = 1, max_lag: int | None = None) -> Layout:
    """The instrument columns of a specification."""
    periods, exog = len(frame.valid_times), tuple(frame.exog_idx)
    if isinstance(spec, AndersonHsiao):
        return Layout(LagBlock({(t, 2): 0 for t in range(3, periods + 1)}, 1), exog, None, 0, False)
    if isinstance(spec, (DifferenceGMM, SystemGMM)):
        lags = lag_block(periods, frame.transform, collapse, max_lags, min_lag, max_lag)
        if isinstance(spec, DifferenceGMM) or periods < 3:
            return Layout(lags, exog, None, 0, False)
        return Layout(lags, exog, {t: 0 if collapse else t - 3 for t in range(3, periods + 1)}, 1 if collapse else periods - 2, True)
    raise NotImplementedError(f"instruments are not implemented for {type(spec).__name__}")


#: numbers of instruments that a task lays out at a time
CELLS = 1 << 21


def usable(v: np.ndarray) -> np.ndarray:
    """Entries that are absent, NaN or zero are structural zeros."""
    return np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf)


@dataclass
class Equations:
    """Equation rows of whole individuals, transformed ones first, level rows last; row: place in the panel's rows."""

    row: np.ndarray
    cluster: np.ndarray
    tidx: np.ndarray
    t: np.ndarray
    is_level: np.ndarray
    y: np.ndarray
    x: np.ndarray
    z: np.ndarray
    clusters: int


def by_period(lay: Layout) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each period index the orders of its lags and their columns."""
    out: dict[int, tuple[list, list]] = {}
    for (t, order), c in lay.lags.columns.items():
        orders, columns = out.setdefault(t, ([], []))
        orders.append(order)
        columns.append(c)
    return {t: (np.array(o), np.array(c)) for t, (o, c) in out.items()}


def equations(lay: Layout, cells: dict, periods: int, stacked: bool, cluster, tidx, t, y, x, dy, dx, ok_diff, ok_level) -> Equations:
    """Equation rows and their instruments from the rows of whole individuals."""
    n = int(cluster[-1]) + 1 if len(cluster) else 0
    diff, lev = np.flatnonzero(ok_diff), np.flatnonzero(ok_level) if stacked else np.empty(0, np.int64)
    row = np.concatenate([diff, lev])
    level = np.concatenate([np.zeros(len(diff), bool), np.ones(len(lev), bool)])
    own_x = np.concatenate([dx[diff], x[lev]])
    z = np.zeros((len(row), lay.width))
    if lay.lags.columns:
        levels = np.full((n, periods + 1), np.nan)
        levels[cluster, tidx] = y
        for p in np.unique(tidx[diff]).tolist():
            if p in cells:
                at = np.flatnonzero(tidx[diff] == p)
                orders, columns = cells[p]
                z[at[:, None], columns[None, :]] = usable(levels[cluster[diff[at]][:, None], p - orders[None, :]])
    if lay.level_columns and len(lev):
        moves = np.full((n, periods + 1), np.nan)
        moves[cluster[diff], tidx[diff]] = dy[diff]
        column = np.full(periods + 1, -1)
        for p, c in lay.level_columns.items():
            column[p] = lay.level_start + c
        at = np.flatnonzero(column[tidx[lev]] >= 0)
        z[len(diff) + at, column[tidx[lev[at]]]] = usable(moves[cluster[lev[at]], tidx[lev[at]] - 1])
    if lay.exog:
        own = usable(own_x[:, list(lay.exog)])
        z[: len(diff), lay.lags.width : lay.level_start] = own[: len(diff)]
        if lay.level_exog:
            z[len(diff) :, lay.level_start + lay.level_width :] = own[len(diff) :]
    return Equations(row, cluster[row], tidx[row], t[row], level, np.concatenate([dy[diff], y[lev]]), own_x, z, n)


def kernel_rows(frame: PanelFrame, *kept: str) -> DataFrame:
    """The panel's rows as tasks read them, by id and time (which the windows have left them in)."""
    return frame.panel.sortWithinPartitions("id", "t").select(*kept, "rn", "tidx", F.expr("try_cast(t AS double)").alias("at"), "y", "x", "dy", "dx", "ok_diff", "ok_level")


def whole_individuals(batches, most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows that start where an individual starts."""
    held: list[pa.RecordBatch] = []
    size, enough = 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(table.column("rn").to_numpy() == 1)
        i = 0
        while len(starts) and i < starts[-1]:
            # the last start within reach, or the next one where an individual is longer
            j = int(starts[max(np.searchsorted(starts, i + most, side="right") - 1, np.searchsorted(starts, i, side="right"))])
            yield table.slice(i, j - i)
            i = j
        held = table.slice(i).to_batches()
        size = table.num_rows - i
        enough = max(most, 2 * size)  # a long individual is not put together again with every batch
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def of_table(lay: Layout, cells: dict, periods: int, stacked: bool, k: int, table: pa.Table) -> Equations:
    column = lambda c: table.column(c).to_numpy()
    wide = lambda c: np.concatenate([x.flatten().to_numpy() for x in table.column(c).chunks]).reshape(table.num_rows, k)
    cluster = np.cumsum(column("rn") == 1) - 1
    return equations(lay, cells, periods, stacked, cluster, column("tidx"), column("at"), column("y"), wide("x"), column("dy"), wide("dx"), column("ok_diff").astype(bool), column("ok_level").astype(bool))


def instrument_rows(frame: PanelFrame, lay: Layout) -> DataFrame:
    """Non-zero instruments as (id, t, is_level, row_seq, col, val), from the pass that estimation makes."""
    k, stacked, periods, cells = len(frame.coef_names), frame.stacked, len(frame.valid_times), by_period(lay)
    most = max(1, CELLS // max(1, lay.width))

    def run(batches):
        for table in whole_individuals(batches, most):
            e = of_table(lay, cells, periods, stacked, k, table)
            r, c = np.nonzero(e.z)
            own = pa.array(e.row[r])
            take = lambda name: table.column(name).take(own).combine_chunks()
            seq = take("rn").to_numpy() + np.where(e.is_level[r], take("n_t").to_numpy(), 0)
            cols = [take("id"), take("t"), pa.array(e.is_level[r]), pa.array(seq.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(e.z[r, c])]
            yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else pa.array([], x.type) if isinstance(x, pa.ChunkedArray) else x for x in cols], names=["id", "t", "is_level", "row_seq", "col", "val"])

    kinds = frame.panel.schema
    out = T.StructType([T.StructField("id", kinds["id"].dataType), T.StructField("t", kinds["t"].dataType), T.StructField("is_level", T.BooleanType()), T.StructField("row_seq", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("val", T.DoubleType())])
    return kernel_rows(frame, "id", "t", "n_t").mapInArrow(run, out)


def build_instruments(spec: Spec, frame: PanelFrame, **options) -> tuple[DataFrame, Layout]:
    """(instrument rows, layout) of a specification."""
    lay = layout(spec, frame, **options)
    return instrument_rows(frame, lay), lay
