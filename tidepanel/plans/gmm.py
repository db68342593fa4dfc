"""One- and two-step estimation from collected moments."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.linalg import inverse, rank_and_columns
from ..functions.stats import chi2_sf
from ..operators.instruments import layout
from ..operators.moments import collect_moments
from ..operators.prepare import PanelFrame, prepare, require_rows
from ..specs import DifferenceGMM, PanelError, PanelResult, Spec, option

#: instruments beyond which the dense weight is large enough to warn
MANY_INSTRUMENTS = 2000


def fitted_value(coef: np.ndarray) -> Column:
    """x'b as a Catalyst expression over the array column x."""
    terms = [F.col("x")[i] * F.lit(float(b)) for i, b in enumerate(coef)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def estimate(spec: Spec, frame: PanelFrame, *, steps: int | None = None, robust: bool | None = None, windmeijer: bool | None = None, collapse: bool = False, max_lags: int = 999, min_lag: int = 1, max_lag: int | None = None, drop_collinear: bool = True) -> PanelResult:
    """GMM estimates of a prepared panel; keywords go before the specification's own settings."""
    steps = option(spec, "steps") if steps is None else steps
    robust = option(spec, "robust") if robust is None else robust
    windmeijer = option(spec, "windmeijer") if windmeijer is None else windmeijer
    k = len(frame.coef_names)
    lay = layout(spec, frame, collapse=collapse, max_lags=max_lags, min_lag=min_lag, max_lag=max_lag)
    if lay.width > MANY_INSTRUMENTS:
        warnings.warn(f"{lay.width} instruments make a dense weight of {lay.width ** 2 * 8 >> 20} MB; consider collapse=True", stacklevel=2)
    difference = isinstance(spec, DifferenceGMM)
    m = collect_moments(frame, lay, difference)
    require_rows(m.n_obs)
    if m.n_obs < k:
        raise PanelError(f"{m.n_obs} observations are insufficient for {k} regressors")
    rank, _ = rank_and_columns(m.r_x)
    if rank < k:
        raise PanelError(f"regressors are collinear (rank {rank} of {k})")
    keep = list(range(lay.width))
    if drop_collinear and lay.width > 1:
        r, columns = rank_and_columns(m.r_z)
        keep = columns if 0 < r < lay.width else keep
    if len(keep) < k:
        raise PanelError(f"the model is under-identified: {len(keep)} instruments for {k} regressors")
    zx, zy = m.zx[keep], m.zy[keep]
    first = m.first[np.ix_(keep, keep)]

    # first step
    w = inverse(first / frame.n_groups if difference else first)
    gain = zx.T @ w
    bread = inverse(gain @ zx)
    beta = bread @ gain @ zy
    omega = m.weighed(beta, keep) if robust or steps == 2 else None
    sandwich = bread @ gain @ omega @ gain.T @ bread if omega is not None else None
    corrected = False
    rows = frame.rows()
    if steps == 2:
        beta1 = beta
        w = inverse(omega)
        bread = inverse(zx.T @ w @ zx)
        beta = bread @ zx.T @ w @ zy
        vcov = bread
        if robust and windmeijer:
            c = w @ (zy - zx @ beta)
            d = -bread @ zx.T @ w @ m.correction(beta1, c, keep)
            vcov = bread + d @ bread + bread @ d.T + d @ sandwich @ d.T
            vcov = (vcov + vcov.T) / 2
            corrected = True
    elif robust:
        vcov = sandwich
    else:
        u = F.col("y") - fitted_value(beta)
        squares = rows.agg(F.sum(u * u).alias("s")).collect()[0]["s"]
        left = m.n_obs - k
        vcov = (squares / left if left else math.nan) * bread
    m.release()
    e = zy - zx @ beta
    j = float(e @ w @ e)
    dof = len(keep) - k
    return PanelResult(
        spec=spec, coef=beta, vcov=vcov, coef_names=list(frame.coef_names), n_obs=m.n_obs, n_groups=frame.n_groups, n_instruments=len(keep),
        j_stat=j, j_pval=chi2_sf(j, dof) if dof > 0 else math.nan, weight=w, rows=rows, robust=robust, windmeijer=corrected, moments=(zx, zy),
        metadata={"method": f"{steps}-step {type(spec).__name__}", "formula": frame.formula, "kept": keep, "ar": {}, "frame": frame},
    )


def fit(spec: Spec, data, *, formula, id_col: str, time_col: str, exog=(), time_effects: bool = False, transform: str = "fd", **options) -> PanelResult:
    """Prepare and estimate: the source is read once, rows are counted with the moments."""
    frame = prepare(data, id_col, time_col, formula, spec, exog=exog, time_effects=time_effects, transform=transform, count=False)
    try:
        return estimate(spec, frame, **options)
    except Exception:
        frame.release()
        raise
