"""Spark-native linear dynamic panel analysis."""

from .functions.formula import Formula, FormulaError, lag, parse_formula
from .operators.instruments import build_instruments
from .operators.prepare import PanelFrame, prepare
from .plans.diagnostics import ar_test, check_proliferation, diagnose, diff_hansen_test, goodness_of_fit, jarque_bera_test, r2, sargan_test, wald_test
from .plans.gmm import estimate, fit
from .plans.report import coef, coefficients, coefnames, coeftable, confint, dof, dof_residual, fitted, formula, is_robust, is_windmeijer, ngroups, ninstruments, nobs, plot_data, predict, residuals, stderror, summary, vcov
from .specs import AndersonHsiao, DifferenceGMM, PanelError, PanelResult, Spec, SystemGMM, TestResult

__all__ = [
    "AndersonHsiao", "DifferenceGMM", "Formula", "FormulaError", "PanelError", "PanelFrame", "PanelResult", "Spec", "SystemGMM", "TestResult",
    "ar_test", "build_instruments", "check_proliferation", "coef", "coefficients", "coefnames", "coeftable", "confint", "diagnose", "diff_hansen_test", "dof", "dof_residual",
    "estimate", "fit", "fitted", "formula", "goodness_of_fit", "is_robust", "is_windmeijer", "jarque_bera_test", "lag", "ngroups", "ninstruments", "nobs", "parse_formula", "plot_data", "predict", "prepare",
    "r2", "residuals", "sargan_test", "stderror", "summary", "vcov", "wald_test",
]
