import math

import numpy as np
import pytest

from tidepanel.functions.linalg import inverse, pivoted_qr, rank_and_columns, ridge_if_singular, triangle
from tidepanel.functions.stats import chi2_sf, normal_two_sided


def test_chi2():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(5.0, 2) == pytest.approx(math.exp(-2.5), rel=1e-13)
    assert chi2_sf(200.0, 4) == pytest.approx(math.exp(-100) * 101, rel=1e-10)
    assert chi2_sf(0, 3) == 1 and math.isnan(chi2_sf(1, 0))


def test_normal():
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-14)
    assert math.isnan(normal_two_sided(math.nan))


def test_ridge():
    assert (ridge_if_singular(np.diag([2.0, 2.0])) == np.diag([2.0, 2.0])).all()
    for d in ([1e-13, 1.0], [-1.0, 1.0]):
        assert np.linalg.eigvalsh(ridge_if_singular(np.diag(d)))[0] > 0
    assert np.allclose(inverse(np.diag([2.0, 4.0])), np.diag([0.5, 0.25]))


def test_rank_does_not_depend_on_the_split():
    r = np.random.default_rng(0)
    for seed in range(20):
        a = np.random.default_rng(seed).normal(size=(200, 8))
        a[:, 5] = a[:, 1] + a[:, 2]
        a[:, 7] = 0
        cut = r.integers(10, 190)
        pieces = triangle(np.vstack([triangle(a[:cut]), triangle(a[cut:])]))
        whole, split = rank_and_columns(a), rank_and_columns(pieces)
        assert whole[0] == split[0] == 6 and whole[1] == split[1]
    assert pivoted_qr(np.zeros((3, 2)))[0].tolist() == [0, 0]
    assert rank_and_columns(np.zeros((3, 2))) == (0, [])
