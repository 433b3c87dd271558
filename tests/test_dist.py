"""Tail probabilities against tabulated values (no scipy available)."""

import math

import numpy as np

from glossa.functions.dist import betainc, f_sf, norm_sf2, t_sf2


def test_t_two_tailed_critical_values():
    # two-tailed 5 % and 1 % critical values of Student t
    for df, t05, t01 in [(1, 12.706, 63.657), (5, 2.571, 4.032), (10, 2.228, 3.169), (30, 2.042, 2.750),
                         (120, 1.980, 2.617)]:
        assert abs(t_sf2(t05, df) - 0.05) < 2e-4
        assert abs(t_sf2(t01, df) - 0.01) < 1e-4


def test_normal_and_f():
    assert abs(norm_sf2(1.959964) - 0.05) < 1e-6
    # F(1, d) upper tail equals the two-tailed t tail of sqrt(F)
    for d in (3, 17, 250):
        assert abs(f_sf(4.0, 1, d) - t_sf2(2.0, d)) < 1e-10


def test_betainc_identities():
    assert abs(betainc(1, 1, 0.3) - 0.3) < 1e-12
    assert abs(betainc(2, 3, 0.5) - 0.6875) < 1e-12
    x = np.linspace(0.05, 0.95, 7)
    assert np.allclose(betainc(2.5, 4.0, x) + betainc(4.0, 2.5, 1 - x), 1.0)
    assert math.isnan(betainc(1, 1, float("nan")))
