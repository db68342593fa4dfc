"""Estimator specifications, results and test results."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import numpy as np


class PanelError(ValueError):
    """Data, options or dimensions that an estimation cannot go on with."""


@dataclass(frozen=True)
class Spec:
    """Base of all estimator specifications; subclass it for a new one."""


@dataclass(frozen=True)
class GMMSpec(Spec):
    robust: bool = False
    steps: int = 1
    windmeijer: bool = True

    def __post_init__(self):
        if self.steps < 1:
            raise PanelError("steps must be at least 1")


@dataclass(frozen=True)
class DifferenceGMM(GMMSpec):
    """Transformed equation, instrumented by lagged levels."""


@dataclass(frozen=True)
class SystemGMM(GMMSpec):
    """Transformed and level equations together."""


@dataclass(frozen=True)
class AndersonHsiao(Spec):
    """Differenced equation, instrumented by the second lag in levels."""


def option(spec: Spec, name: str):
    """A specification's own setting; one step and robust where it has none."""
    return getattr(spec, name, {"steps": 1, "robust": True, "windmeijer": True}[name])


@dataclass(frozen=True)
class TestResult:
    """Name, statistic, degrees of freedom and p-value of a test."""

    __test__ = False
    name: str
    stat: float
    dof: int
    pvalue: float


@dataclass
class PanelResult:
    """Estimates on the driver; rows stay a lazy DataFrame (id, t, is_level, row_seq, y, x)."""

    spec: Spec
    coef: np.ndarray
    vcov: np.ndarray
    coef_names: list[str]
    n_obs: int
    n_groups: int
    n_instruments: int
    j_stat: float
    j_pval: float
    weight: np.ndarray
    rows: Any = None
    robust: bool | None = None
    windmeijer: bool = False
    moments: tuple | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.robust is None:
            self.robust = self.windmeijer
        if len(self.coef) != len(self.coef_names):
            raise PanelError(f"{len(self.coef)} coefficients for {len(self.coef_names)} columns")

    def release(self) -> None:
        """Drop the persisted rows that residuals and tests start from; they are computed again where needed."""
        frame = self.metadata.get("frame")
        if frame is not None:
            frame.release()

    def __str__(self) -> str:
        from .plans.report import summary

        return summary(self)
