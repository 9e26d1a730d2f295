"""Property tests: distributed operators == single-machine definitions."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repeatlens.operators import evaluation as ev
from repeatlens.operators.ranking import bounded_quantiles, global_row_number, qcut_ranks

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=6))
def test_row_number_is_sorted_position(spark, values, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v long")
    got = dict(global_row_number(df, ["v", "k"], num_partitions=parts).select("k", "row_number").collect())
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert got == {k: pos + 1 for pos, k in enumerate(order)}


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=80),
       st.lists(st.sampled_from([0.0, 0.1, 0.2, 0.25, 0.5, 0.75, 0.8, 0.9, 1.0]), min_size=1, max_size=4,
                unique=True))
def test_bounded_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = {r.p: r.quantile for r in bounded_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


@SETTINGS
@given(st.integers(min_value=2, max_value=500))
def test_qcut_ranks_equal_pandas(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).alias("n"))
    got = [r.b for r in df.select("r", qcut_ranks("r", "n", 5).alias("b")).orderBy("r").collect()]
    assert got == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=60))
def test_auc_equals_pairwise(spark, rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    df = spark.createDataFrame(rows, "y int, s long")
    got = ev.roc_auc(df, "y", "s").collect()[0].auc
    if not pos or not neg:
        assert got is None
        return
    exp = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(exp, abs=1e-12)
