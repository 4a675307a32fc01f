import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.functions import laws, linalg, scalars


def test_numbers(spark):
    cases = {"12.5": 12.5, "1 234,50": 1234.5, "€ 12": 12.0, "4,5 %": 4.5, "-3,25e1": -32.5, "1f": None, "12d": None, "Infinity": None, "0x1": None, "": None, ".5": 0.5, "5.": 5.0, "a1": None, "1,2,3": None}
    df = spark.createDataFrame(list(cases.items()), "s string, want double").withColumn("x", scalars.parse_num(F.col("s")))
    assert {r["s"]: r["x"] for r in df.collect()} == cases


def test_dates(spark):
    cases = ["2024-03-15", "15/03/2024", "2024/03/15", "2024-03", "2024-03-15T10:30", "31/02/2024", "bonjour"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "s string").select(scalars.parse_date(F.col("s")).cast("string")).collect()]
    assert got == ["2024-03-15 00:00:00"] * 3 + ["2024-03-01 00:00:00", "2024-03-15 10:30:00", None, None]


def test_missing(spark):
    df = spark.createDataFrame([("NA",), (" n/a ",), ("",), (None,), ("zero",), ("#DIV/0!",)], "s string")
    assert [r[0] for r in df.select(scalars.is_missing(F.col("s"))).collect()] == [True, True, True, True, False, True]


@pytest.mark.parametrize("p,a,b,want", [(0.95, 1.5, 23, 0.157942), (0.95, 3, 45.5, 0.126069), (0.99, 2, 10, 0.4698)])
def test_beta(p, a, b, want):
    x = laws.beta_inv(p, a, b)
    assert abs(laws.beta_cdf(a, b, x) - p) < 1e-12 and 0 < x < 1


def test_laws():
    assert abs(laws.chi2_inv(0.95, 1) - 3.841458820694124) < 1e-9
    assert abs(laws.norm_inv(0.975) - 1.959963984540054) < 1e-12
    assert abs(laws.chi2_sf(20, 12) - 0.06708596) < 1e-7
    assert abs(laws.hyper_tail(2, 50, 12, 20, False) + laws.hyper_tail(3, 50, 12, 20, True) - 1) < 1e-12
    assert abs(laws.hyper_tail(6, 50, 6, 6, True) - 1 / math.comb(50, 6)) < 1e-15
    assert abs(laws.t_sf2(2.0, 10) - 0.07338803) < 1e-7
    assert laws.norm_inv(1e-300) < -37


@given(st.floats(-7, 7))
def test_normal_inverse(z):
    assert abs(laws.norm_inv(laws.norm_cdf(z)) - z) < 1e-6 * max(1, abs(z))


@given(st.integers(2, 8), st.integers(0, 10**6))
def test_eigen(p, seed):
    x = np.random.default_rng(seed).normal(size=(p + 5, p))
    values, v = linalg.eigen(np.cov(x, rowvar=False))
    assert linalg.ortho_error(v) < 1e-10 and (np.diff(values) <= 1e-12).all()
    linalg.orient(v)
    assert (v[np.abs(v).argmax(0), range(p)] > 0).all()


def test_frames():
    a, b = linalg.random_frame(6, 3, 1), linalg.random_frame(6, 3, 2)
    half = linalg.frame_path(a, b, 0.5)
    assert linalg.ortho_error(half) < 1e-9
    assert linalg.elbow([5, 3, 1, 0.9]) == 2 and linalg.axes_kept(1, 5) == 2 and scalars.nice_step(3.2) == 5
