"""Panel preparation: validation, lagged regressors, transformed and level rows.

The source is read once: its columns go by id and time, in one exchange and one
sort, into a persisted base that everything later starts from.  All windows share
that partitioning and order.  One aggregation of the base by period gives the
periods, the counts and the checks.  Missing values are NaN, never NULL, from the
first projection on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import FormulaError, TermSpec, parse_formula, parse_term
from ..sources.tables import as_dataframe
from ..specs import PanelError, Spec, SystemGMM

_NAN = float("nan")


@dataclass
class PanelFrame:
    """Prepared data.

    panel: one row an input row of ids that are long enough (id, t, tidx, rn,
    n_t, y, x, dy, dx, ok_diff, ok_level); rows(): equation rows.
    """

    panel: DataFrame
    coef_names: list[str]
    exog_idx: list[int]
    valid_times: list
    n_groups: int
    transform: str
    stacked: bool
    formula: str
    n_obs: int = 0
    base: DataFrame | None = None

    def release(self) -> None:
        """Drop the persisted base; what still needs it is computed from the source again."""
        if self.base is not None:
            self.base.unpersist()

    def rows(self) -> DataFrame:
        """(id, t, tidx, is_level, row_seq, y, x): transformed rows, then level rows of each id."""
        diff = F.struct(F.lit(False).alias("is_level"), F.col("dy").alias("y"), F.col("dx").alias("x"), F.col("ok_diff").alias("ok"))
        level = F.struct(F.lit(True).alias("is_level"), F.col("y"), F.col("x"), F.col("ok_level").alias("ok"))
        both = F.array(diff, level) if self.stacked else F.array(diff)
        r = self.panel.select("id", "t", "tidx", "rn", "n_t", F.explode(both).alias("r")).filter("r.ok")
        seq = F.col("rn") + F.when(F.col("r.is_level"), F.col("n_t")).otherwise(0)
        return r.select("id", "t", "tidx", F.col("r.is_level").alias("is_level"), seq.alias("row_seq"), F.col("r.y").alias("y"), F.col("r.x").alias("x"))


def transformed(spec: TermSpec) -> Column:
    """The term's function of its variable, as a double; log of 0 is -inf."""
    v = F.col(spec.var).cast("double")
    if spec.fn is None:
        return v
    if spec.fn in ("log", "log10", "log2"):
        f = {"log": F.log, "log10": F.log10, "log2": F.log2}[spec.fn]
        return F.when(v == 0, F.lit(float("-inf"))).otherwise(f(v))
    return {"exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}[spec.fn](v)


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(_NAN))


def resolve(df: DataFrame, id_col: str, time_col: str, formula, spec: Spec, exog=(), transform: str = "fd"):
    """Checks that need no data: (y, regressors, exogenous positions)."""
    if transform not in ("fd", "fod"):
        raise PanelError("transform is 'fd' (first differences) or 'fod' (forward orthogonal deviations)")
    if transform == "fod" and isinstance(spec, SystemGMM):
        raise PanelError("forward orthogonal deviations do not go with System GMM")
    for what, name in (("id", id_col), ("time", time_col)):
        if name not in df.columns:
            raise PanelError(f"{what} column '{name}' does not exist")
    if not isinstance(df.schema[time_col].dataType, (T.NumericType, T.DateType, T.TimestampType, T.StringType)):
        raise PanelError(f"time column '{time_col}' cannot be ordered")
    left, right = parse_formula(formula)
    y = parse_term(left)
    if len(y) != 1 or y[0].lag:
        raise FormulaError("the dependent variable cannot be lagged")
    y = y[0]
    xs = [s for t in right for s in parse_term(t)]
    for name in dict.fromkeys([y.var, *(s.var for s in xs)]):
        if name not in df.columns:
            raise PanelError(f"variable '{name}' does not exist")
        if not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType)):
            raise PanelError(f"variable '{name}' is not numeric")
    names = [s.name for s in xs]
    positions = []
    for e in exog:
        if e not in names:
            raise PanelError(f"exogenous regressor '{e}' is no term of the right-hand side")
        i = names.index(e)
        if xs[i].var == y.var:
            raise PanelError(f"'{e}' comes from the dependent variable and cannot be exogenous")
        positions.append(i)
    return y, xs, positions


def based(df: DataFrame, id_col: str, time_col: str, specs: list[TermSpec]) -> DataFrame:
    """(id, t, v_…, rn, n_t, again): the columns in use by id and time, persisted; again: the period is the row before's."""
    w = Window.partitionBy("id").orderBy("t")
    # variables under private names: ids and times may be variables too
    held = df.select(F.col(id_col).alias("id"), F.col(time_col).alias("t"), *(F.col(v).alias(f"v_{v}") for v in dict.fromkeys(s.var for s in specs)))
    counted = held.select("*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(Window.partitionBy("id")).cast("int").alias("n_t"), ((F.row_number().over(w) > 1) & F.col("t").eqNullSafe(F.lag("t").over(w))).alias("again"))
    return counted.persist(StorageLevel.MEMORY_AND_DISK)


def validate(base: DataFrame, specs: list[TermSpec]) -> tuple[int, list]:
    """(number of ids, ordered periods) from one aggregation by period."""
    defects = _defects(specs)
    bad = [F.sum(F.when(c, 1).otherwise(0)).alias(f"bad{i}") for i, (c, _) in enumerate(defects)]
    found = base.groupBy("t").agg(F.sum((F.col("rn") == 1).cast("long")).alias("ids"), F.sum(F.col("again").cast("long")).alias("again"), *bad).collect()  # a row a period: few by nature
    if not found:
        raise PanelError("the table is empty")
    if sum(r["again"] for r in found):
        raise PanelError("some id has a period twice; id and time must identify a row")
    for i, (_, message) in enumerate(defects):
        if sum(r[f"bad{i}"] for r in found):
            raise PanelError(message)
    return sum(r["ids"] for r in found), sorted((r["t"] for r in found if r["t"] is not None))


def _defects(specs: list[TermSpec]) -> list[tuple[Column, str]]:
    out = []
    for name in dict.fromkeys(s.var for s in specs):
        out.append((F.col(f"v_{name}").isNull(), f"variable '{name}' has missing values"))
    for s in dict.fromkeys((s.var, s.fn) for s in specs if s.fn in ("log", "log10", "log2", "sqrt")):
        out.append((F.col(f"v_{s[0]}").cast("double") < 0, f"{s[1]}({s[0]}) of a negative number"))
    return out


def prepare(data, id_col: str, time_col: str, formula, spec: Spec, *, exog=(), time_effects: bool = False, transform: str = "fd", count: bool = True) -> PanelFrame:
    """Validate and lay out the equations of a formula; nothing but checks and counts is computed here."""
    df = as_dataframe(data)
    y, xs, positions = resolve(df, id_col, time_col, formula, spec, exog, transform)
    base = based(df, id_col, time_col, [y, *xs])
    try:
        n_groups, times = validate(base, [y, *xs])
        periods = times[2:] if time_effects else []
        names = [s.name for s in xs] + [f"t={p}" for p in periods]
        positions = positions + list(range(len(xs), len(names)))
        panel = panel_rows(base, y, xs, times, periods, transform)
        frame = PanelFrame(panel, names, positions, times, n_groups, transform, isinstance(spec, SystemGMM), str(formula), base=base)
        if count:
            frame.n_obs = frame.rows().count()
            require_rows(frame.n_obs)
    except PanelError:
        base.unpersist()
        raise
    return frame


def require_rows(n_obs: int) -> None:
    if not n_obs:
        raise PanelError("no valid observations are left: too few periods or too many missing values")


def time_index(rows: DataFrame, times: list) -> DataFrame:
    """rows with tidx, the 1-based rank of their period t among all periods, by a broadcast of the periods."""
    kind = T.StructType([T.StructField("t", rows.schema["t"].dataType), T.StructField("tidx", T.IntegerType())])
    ranks = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(times, 1)], kind)
    return rows.join(F.broadcast(ranks), "t", "left")


def panel_rows(base: DataFrame, y: TermSpec, xs: list[TermSpec], times: list, periods: list, transform: str) -> DataFrame:
    w = Window.partitionBy("id").orderBy("t")
    value = {s: transformed(TermSpec(f"v_{s.var}", s.fn)) for s in [y, *xs]}
    base = time_index(base.filter("n_t >= 3"), times).select(
        "id", "t", "tidx", "rn", "n_t",
        _or_nan(value[y]).alias("y"),
        *(_or_nan(F.lag(value[s], s.lag).over(w) if s.lag else value[s]).alias(f"x{i}") for i, s in enumerate(xs)),
        *((F.col("t") == F.lit(p)).cast("double").alias(f"x{len(xs) + i}") for i, p in enumerate(periods)),
    )
    columns = ["y", *(f"x{i}" for i in range(len(xs) + len(periods)))]
    if transform == "fd":
        moved = {c: _or_nan(F.col(c) - F.lag(c).over(w)) for c in columns}
        first = F.col("rn") >= 2
    else:
        ahead = w.rowsBetween(1, Window.unboundedFollowing)
        left = (F.col("n_t") - F.col("rn")).cast("double")
        scale = F.sqrt(left / (left + 1))
        moved = {c: _or_nan(scale * (F.col(c) - F.sum(c).over(ahead) / F.when(left > 0, left))) for c in columns}
        first = F.col("rn") < F.col("n_t")
    out = base.select("*", *(v.alias(f"d{c}") for c, v in moved.items()))
    any_nan = lambda cols: F.exists(F.array(*cols), lambda v: F.isnan(v))
    return out.select(
        "id", "t", "tidx", "rn", "n_t", "y", F.array(*columns[1:]).alias("x"), "dy", F.array(*(f"d{c}" for c in columns[1:])).alias("dx"),
        (first & ~any_nan([f"d{c}" for c in columns])).alias("ok_diff"),
        ((F.col("rn") >= 3) & ~any_nan(columns)).alias("ok_level"),
    )


def balance(df: DataFrame, id_col: str, *periods: str) -> DataFrame:
    """Ids, and least, most and mean periods an id."""
    n = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("n_ids"), F.min("n").alias("min_periods"), F.max("n").alias("max_periods"), F.avg("n").alias("mean_periods"))


def duplicates(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """(id, time, n) of pairs that are there more than once."""
    return df.groupBy(id_col, time_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
