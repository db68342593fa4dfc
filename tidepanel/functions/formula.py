"""The regression formula language: text or term objects to column specifications."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: unary functions that a formula may apply to a variable
TRANSFORMS = ("abs", "exp", "log", "log10", "log2", "sqrt")
_NAME = r"[A-Za-z_][A-Za-z0-9_]*"


class FormulaError(ValueError):
    """A formula that cannot be read or used."""


@dataclass(frozen=True)
class TermSpec:
    """One column: a variable, an optional function of it, and a lag order."""

    var: str
    fn: str | None = None
    lag: int = 0

    @property
    def label(self) -> str:
        return f"{self.fn}({self.var})" if self.fn else self.var

    @property
    def name(self) -> str:
        """Coefficient name: x, L.x, L2.x, ..."""
        return self.label if not self.lag else f"L{self.lag if self.lag > 1 else ''}.{self.label}"


@dataclass(frozen=True)
class Lag:
    """Symbolic lag of a term; it has no value outside a formula."""

    term: str
    orders: str = "1"

    def __str__(self) -> str:
        return f"lag({self.term})" if self.orders == "1" else f"lag({self.term}, {self.orders})"

    def __call__(self, *_):
        raise TypeError("lag() only has a meaning inside a formula")


def lag(term: str, orders: int | str | range = 1) -> Lag:
    """A lagged regressor for Formula(...): an order, 'a:b', or a range."""
    if not isinstance(term, str):
        raise TypeError("lag() is a formula marker and takes the name of a term, not data")
    if isinstance(orders, range):
        orders = f"{orders.start}:{orders.stop - 1}"
    return Lag(term, str(orders))


@dataclass(frozen=True)
class Formula:
    """lhs ~ terms; numbers among the terms (intercepts) are dropped."""

    lhs: str
    terms: tuple

    def __init__(self, lhs, terms):
        object.__setattr__(self, "lhs", str(lhs))
        object.__setattr__(self, "terms", tuple(terms) if isinstance(terms, (list, tuple)) else (terms,))

    def __str__(self) -> str:
        kept = [str(t) for t in self.terms if not isinstance(t, (int, float))]
        if not kept:
            raise FormulaError("the right-hand side has no regressors")
        return f"{self.lhs} ~ {' + '.join(kept)}"


def parse_formula(formula: str | Formula) -> tuple[str, list[str]]:
    """(dependent term, regressor terms) as text."""
    sides = [s.strip() for s in str(formula).split("~")]
    if sides == [""]:
        raise FormulaError("the formula is empty; write one such as 'y ~ x1 + x2'")
    if len(sides) != 2:
        raise FormulaError("a formula has exactly one '~'")
    y, right = sides
    if not y:
        raise FormulaError("nothing stands left of '~'")
    terms = [t for t in (t.strip() for t in right.split("+")) if t]
    if not terms:
        raise FormulaError("nothing usable stands right of '~'")
    for i, t in enumerate(terms):
        if t in terms[:i]:
            raise FormulaError(f"term '{t}' is given twice")
    if y in terms:
        raise FormulaError(f"'{y}' stands on both sides")
    return y, terms


def _base(text: str) -> tuple[str, str | None]:
    text = text.strip()
    if re.fullmatch(_NAME, text, re.ASCII):
        return text, None
    call = re.fullmatch(rf"({_NAME})\(({_NAME})\)", text, re.ASCII)
    if not call:
        raise FormulaError(f"cannot read the term '{text}'")
    if call[1] not in TRANSFORMS:
        raise FormulaError(f"unknown function '{call[1]}'; known: {', '.join(TRANSFORMS)}")
    return call[2], call[1]


def lag_orders(text: str) -> list[int]:
    """'2' or '0:3' to orders."""
    ends = [p.strip() for p in text.strip().split(":")]
    if len(ends) > 2 or not all(re.fullmatch(r"[+-]?\d+", p) for p in ends):
        raise FormulaError(f"cannot read the lags '{text.strip()}'")
    numbers = [int(p) for p in ends]
    orders = list(range(numbers[0], numbers[-1] + 1))
    if not orders:
        raise FormulaError(f"the lag range '{text.strip()}' is empty")
    if min(orders) < 0:
        raise FormulaError(f"lags cannot be negative: '{text.strip()}'")
    return orders


def parse_term(term: str) -> list[TermSpec]:
    """Columns of one term; a lag range gives several."""
    term = term.strip()
    if term.startswith("lag(") and term.endswith(")"):
        inside, comma, orders = term[4:-1].partition(",")
        var, fn = _base(inside)
        return [TermSpec(var, fn, k) for k in (lag_orders(orders) if comma else [1])]
    return [TermSpec(*_base(term))]
