"""Radix selection against numpy."""

import math
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatlens.operators import selection as S


@settings(max_examples=300, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=20))
def test_double_keys_keep_the_order(xs):
    keys = S.double_key.func(pd.Series(xs, dtype="float64")).tolist()
    for a, ka in zip(xs, keys):
        assert S.key_double(ka) == a
        assert -2**63 <= ka < 2**63
        for b, kb in zip(xs, keys):
            assert (a < b) == (ka < kb)


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        rows.append((i, rng.choice([None, -0.0, 0.0, 1.5, -1e300, 5e-324, rng.gauss(0, 1e6)]),
                     rng.randrange(-3, 4), Decimal(rng.randrange(-10**6, 10**9)) / 100,
                     rng.choice(["", "a", "ab", "abc", "b", "b\x00", "é", "zz" * rng.randrange(1, 9)]),
                     None))
    return spark.createDataFrame(rows, "id long, x double, day int, money decimal(12,2), name string, "
                                 "none double").repartition(7)


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles_are_numpys(frame):
    pdf = frame.toPandas()
    got = S.order_statistics(frame, {"x": PROBS, "day": PROBS, "money": PROBS, "none": [0.5]})
    for c in ("x", "day", "money"):
        v = np.sort(pdf[c].dropna().astype(float).to_numpy())
        assert got[c]["n"] == len(v)
        for p in PROBS:
            h = p * (len(v) - 1)
            lo, hi = v[math.floor(h)], v[math.ceil(h)]
            assert got[c][p] == lo + (hi - lo) * (h - math.floor(h))
    assert got["none"] == {"n": 0, 0.5: None}


def test_ranks_with_ties_are_the_total_order(frame):
    pdf = frame.select("id", "day", "name").toPandas()
    by_id = sorted(zip(pdf.day, pdf.id))
    ranks = [1, 2, 999, 1500, 2999, 3000, 3001]
    got = S.order_statistics(frame, {"day": ranks}, {"day": "id"})["day"]
    assert [got[r] for r in ranks[:-1]] == [by_id[r - 1] for r in ranks[:-1]] and got[3001] is None
    by_name = sorted((d, n.encode()) for d, n in zip(pdf.day, pdf.name))
    got = S.order_statistics(frame, {"day": ranks}, {"day": "name"})["day"]
    assert [(d, n.encode()) for d, n in (got[r] for r in ranks[:-1])] == [by_name[r - 1] for r in ranks[:-1]]


def test_empty_and_one_value(spark):
    none = spark.createDataFrame([], "x double")
    assert S.order_statistics(none, {"x": [0.5, 1]})["x"] == {"n": 0, 0.5: None, 1: None}
    same = spark.range(1000).select(F.lit(7.25).alias("x"))
    assert S.order_statistics(same, {"x": [0.0, 0.5]})["x"] == {"n": 1000, 0.0: 7.25, 0.5: 7.25}


def test_no_range_exchange_and_few_passes(spark, frame, monkeypatch):
    plans = []
    real = S.write_shared
    monkeypatch.setattr(S, "write_shared", lambda df, name: plans.append(df) or real(df, name))
    cents = spark.range(200_000).select((F.pmod(F.col("id") * 7919, F.lit(9_999_991)) / 100).alias("x"))
    got = S.order_statistics(cents, {"x": [0.25, 0.5, 0.9]})["x"]
    v = np.sort(np.array([i * 7919 % 9_999_991 / 100 for i in range(200_000)]))
    assert got[0.5] == (v[99_999] + v[100_000]) / 2 and len(plans) == 1
