import pytest

from tidepanel.functions.formula import Formula, FormulaError, lag, lag_orders, parse_formula, parse_term


def test_bad_formulas():
    left, right = "wage", "hours + lag(wage)"
    sides = {"two marks": f"{left} ~ {right} ~ age", "no mark": f"{left} + {right}", "nothing on the left": f"~ {right}", "nothing on the right": f"{left} ~\t", "only signs on the right": f"{left} ~ + + +", "no text": " \n"}
    terms = {"a term twice": [*right.split(" + "), "hours"], "the response on the right": [left, "hours"]}
    for text in [*sides.values(), *(f"{left} ~ {' + '.join(t)}" for t in terms.values())]:
        with pytest.raises(FormulaError):
            parse_formula(text)


def test_good_formulas():
    terms = ["lag(wage, 1:2)", "hours", "log(age)"]
    assert parse_formula("wage~" + "+".join(terms)) == ("wage", terms) == parse_formula("  wage ~ +" + " +  + ".join(terms) + "+")
    assert parse_formula(Formula("y", [1, lag("y"), lag("x", "0:1")])) == ("y", ["lag(y)", "lag(x, 0:1)"])


def test_terms():
    assert [s.name for s in parse_term("lag(log(y), 0:2)")] == ["log(y)", "L.log(y)", "L2.log(y)"]
    assert [s.name for s in parse_term("lag(y)")] == ["L.y"]
    assert lag_orders(" 2 ") == [2]


@pytest.mark.parametrize("term", ["sin(x)", "lag(log(sqrt(x)))", "größe", "1", "lag(x, -1)", "lag(x, 2:1)", "lag(x, a)", "x*z"])
def test_bad_terms(term):
    with pytest.raises(FormulaError):
        parse_term(term)


def test_lag_has_no_value():
    with pytest.raises(TypeError):
        lag([1, 2, 3])
    with pytest.raises(TypeError):
        lag("x")([1])
