import math

import numpy as np
import pytest

from epigrain.functions.special import beta_cdf, beta_quantile_array, f_upper_tail_array


def test_beta_closed_forms():
    x = np.linspace(0, 1, 11)
    assert beta_cdf(x, 1, 1) == pytest.approx(x)
    assert beta_cdf(x, 2, 1) == pytest.approx(x**2)
    assert beta_cdf(x, 0.5, 0.5) == pytest.approx(2 / math.pi * np.arcsin(np.sqrt(x)))


def test_beta_against_integration():
    a, b, x = 3.5, 97.5, 0.05
    grid = np.linspace(0, x, 200_001)
    density = grid ** (a - 1) * (1 - grid) ** (b - 1)
    area = np.trapezoid(density, grid) / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    assert beta_cdf(x, a, b) == pytest.approx(area, rel=1e-6)


def test_beta_quantile_inverts():
    p = np.array([0.025, 0.25, 0.5, 0.75, 0.965])
    q = beta_quantile_array(p, 5.5, 2000.5)
    assert beta_cdf(q, 5.5, 2000.5) == pytest.approx(p)


def test_f_tail():
    # With (1, 1) degrees of freedom the F tail is that of a squared Cauchy variable.
    f = np.array([0.5, 1.0, 4.0])
    assert f_upper_tail_array(f, 1, 1) == pytest.approx(1 - 2 / math.pi * np.arctan(np.sqrt(f)))
    assert f_upper_tail_array(np.inf, 1, 5) == 0.0
