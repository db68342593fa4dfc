"""Specification tests of an estimated panel."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, normal_two_sided
from ..specs import PanelError, PanelResult, TestResult
from .gmm import fitted_value


def fitted_rows(m: PanelResult) -> DataFrame:
    """(id, t, is_level, row_seq, y, fitted, residual, x), lazily; id and t where the rows have them."""
    f = fitted_value(m.coef)
    return m.rows.select(*(c for c in ("id", "t") if c in m.rows.columns), "is_level", "row_seq", "y", f.alias("fitted"), (F.col("y") - f).alias("residual"), "x")


def sargan_test(m: PanelResult) -> TestResult:
    """Test of the overidentifying restrictions; (0, 0, 1) where there are none."""
    dof = m.n_instruments - len(m.coef)
    return TestResult("Sargan J-Test", m.j_stat, dof, m.j_pval) if dof > 0 else TestResult("Sargan J-Test", 0.0, 0, 1.0)


def diff_hansen_test(restricted: PanelResult, unrestricted: PanelResult) -> TestResult:
    """C-test of the instruments that the restricted model leaves out."""
    if restricted.n_obs != unrestricted.n_obs:
        raise PanelError("both models must have the same observations")
    if unrestricted.n_instruments <= restricted.n_instruments:
        raise PanelError("the unrestricted model must have more instruments")
    name = "Difference-in-Hansen C-Test"
    dof = (unrestricted.n_instruments - len(unrestricted.coef)) - (restricted.n_instruments - len(restricted.coef))
    if dof <= 0:
        return TestResult(name, 0.0, 0, 1.0)
    c = max(restricted.j_stat - unrestricted.j_stat, 0.0)
    return TestResult(name, c, dof, chi2_sf(c, dof))


def with_lagged(rows: DataFrame, order: int, columns: list[str]) -> DataFrame:
    """rows and, as l_<name>, each column ``order`` periods earlier by the calendar, 0 where that period is absent.

    Where an id has a period twice (a transformed and a level row) the later row counts.
    """
    w = Window.partitionBy("id").orderBy("t").rangeBetween(-order, -order)
    before = F.max_by(F.struct(*columns), "row_seq").over(w)
    held = rows.withColumn("_before", before)
    zero = lambda c: F.transform(F.col(c), lambda v: v * 0) if dict(rows.dtypes)[c].startswith("array") else F.lit(0.0)
    return held.select("*", *(F.coalesce(F.col(f"_before.{c}"), zero(c)).alias(f"l_{c}") for c in columns)).drop("_before")


def ar_components(m: PanelResult, order: int) -> dict:
    """Sums of a residual autocorrelation test, in one aggregation."""
    k = len(m.coef)
    rows = with_lagged(fitted_rows(m), order, ["residual", "x"])
    e, l = F.col("residual"), F.col("l_residual")
    cross = [F.sum(F.col("x")[i] * l + F.col("l_x")[i] * e).alias(f"d{i}") for i in range(k)]
    return rows.agg(F.sum(e * l).alias("num"), F.sum(e * l * e * l).alias("square"), *cross).collect()[0].asDict()


def ar_test(m: PanelResult, order: int, *, cached: bool = False) -> TestResult:
    """Test of autocorrelation of that order in the transformed residuals."""
    if cached:
        if order not in m.metadata.get("ar", {}):
            raise PanelError(f"AR({order}) has not been computed yet")
        return m.metadata["ar"][order]
    if order < 1:
        raise PanelError("the order must be at least 1")
    if m.rows is None:
        raise PanelError("the result holds no rows to test")
    s = ar_components(m, order)
    d = -np.array([s[f"d{i}"] for i in range(len(m.coef))])
    variance = s["square"] + d @ m.vcov @ d
    if not variance > 0:
        return TestResult(f"AR({order}) Test", math.nan, 0, math.nan)
    z = s["num"] / math.sqrt(variance)
    out = TestResult(f"AR({order}) Test", z, 0, normal_two_sided(z))
    m.metadata.setdefault("ar", {})[order] = out
    return out


def wald_test(m: PanelResult, restrictions, values) -> TestResult:
    """R b = r, with a small ridge where the restrictions repeat each other."""
    r = np.atleast_2d(np.asarray(restrictions, float))
    if r.shape[1] != len(m.coef):
        raise PanelError(f"restrictions have {r.shape[1]} columns for {len(m.coef)} coefficients")
    gap = r @ m.coef - np.atleast_1d(np.asarray(values, float))
    middle = r @ m.vcov @ r.T
    if np.linalg.cond(middle) > 1e12:
        middle = middle + 1e-9 * np.eye(len(r))
    stat = float(gap @ np.linalg.inv(middle) @ gap)
    return TestResult("Wald Test", stat, len(r), chi2_sf(stat, len(r)))


def r2(m: PanelResult) -> float:
    """Squared correlation of response and fitted values."""
    c = fitted_rows(m).agg(F.corr("y", "fitted").alias("c")).collect()[0]["c"]
    return math.nan if c is None else c * c


goodness_of_fit = r2


def check_proliferation(m: PanelResult) -> str:
    ratio = round(m.n_instruments / m.n_groups, 2)
    if m.n_instruments > m.n_groups:
        return f"WARNING: instrument count ({m.n_instruments}) exceeds groups ({m.n_groups}); ratio {ratio}"
    return f"OK: {m.n_instruments} instruments for {m.n_groups} groups; ratio {ratio}"


def jarque_bera_from(n: int, m2: float, m3: float, m4: float) -> TestResult:
    stat = n / 6 * ((m3 / m2**1.5) ** 2 + (m4 / m2**2 - 3) ** 2 / 4) if n and m2 else math.nan
    return TestResult("Jarque-Bera Test", stat, 2, math.nan if math.isnan(stat) else math.exp(-stat / 2))


def jarque_bera_test(m: PanelResult) -> TestResult:
    """Normality of the residuals, from their central moments."""
    rows = fitted_rows(m)
    mean = rows.agg(F.avg("residual").alias("m"), F.count(F.lit(1)).alias("n")).collect()[0]
    c = F.col("residual") - F.lit(mean["m"])
    s = rows.agg(*(F.avg(F.pow(c, F.lit(p))).alias(f"m{p}") for p in (2, 3, 4))).collect()[0]
    return jarque_bera_from(mean["n"], s["m2"], s["m3"], s["m4"])


def diagnose(m: PanelResult, out=print, *, id_col: str = "id", time_col: str = "t") -> dict:
    """Print a report and return its tests; id_col and time_col name those columns of m.rows where they are others."""
    found: dict = {"sargan": sargan_test(m)}
    out("Diagnostics")
    s = found["sargan"]
    out(f"  {s.name}: chi2({s.dof}) = {s.stat:.4f}, p = {s.pvalue:.4f}")
    if m.rows is not None and {id_col, time_col} <= set(m.rows.columns):
        named = m if (id_col, time_col) == ("id", "t") else replace(m, rows=m.rows.withColumnsRenamed({id_col: "id", time_col: "t"}))
        for order in (1, 2):
            a = found[f"ar{order}"] = ar_test(named, order)
            out(f"  {a.name}: z = {a.stat:.4f}, p = {a.pvalue:.4f}")
    else:
        out("  autocorrelation tests skipped: no id and time at hand")
    if m.rows is not None:
        j = found["jarque_bera"] = jarque_bera_test(m)
        out(f"  {j.name}: {j.stat:.4f}, p = {j.pvalue:.4f}")
        found["pseudo_r2"] = r2(m)
    out(f"  Instruments: {check_proliferation(m)}")
    return found
