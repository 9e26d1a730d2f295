"""Distributed operators against brute force / pandas on small inputs."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from repeatlens.operators import evaluation as ev
from repeatlens.operators.ranking import (exact_quantiles, global_row_number, qcut_ranks,
                                          qcut_values, quantile_edges, ranked_scan)


def test_global_row_number_matches_sort(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 20) / 4.0) for i in range(500)]  # many ties on value
    df = spark.createDataFrame(rows, "k long, v double")
    got = global_row_number(df, ["v", "k"], num_partitions=7).toPandas()
    exp = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {k: i + 1 for i, (k, _) in enumerate(exp)}
    assert len(got) == 500
    assert all(want[k] == rn for k, rn in zip(got["k"], got["row_number"]))


def test_weighted_ranked_scan_running_total(spark):
    rows = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, w long")
    got = ranked_scan(df, ["k"], out="cum", weight="w", num_partitions=5).toPandas().sort_values("k")
    assert list(got["cum"]) == list(np.cumsum([w for _, w in rows]))


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 11, 23, 100, 399])
def test_qcut_ranks_equals_pandas(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).alias("n"))
    got = df.select("r", qcut_ranks("r", "n", 5).alias("b")).orderBy("r").toPandas()["b"].tolist()
    exp = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert got == exp


def test_qcut_ranks_single_value_raises(spark):
    df = spark.range(1, 2).select(F.col("id").alias("r"), F.lit(1).alias("n"))
    with pytest.raises(Exception):
        df.select(qcut_ranks("r", "n", 5)).collect()


@pytest.mark.parametrize("values", [
    list(range(7)),                              # qcut_small
    [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144],
    [3, 3, 4, 10, 10, 10, 12, 15, 40, 41, 42],   # ties
])
def test_qcut_values_equals_pandas(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x long")
    edges = quantile_edges(df, "x", 5)
    j = df.withColumn("_k", F.lit(1)).join(edges.withColumn("_k", F.lit(1)), "_k")
    e = [F.col(f"e{k}") for k in range(6)]
    got = j.select("i", qcut_values("x", e, [5, 4, 3, 2, 1]).alias("s")).orderBy("i").toPandas()["s"].tolist()
    exp = pd.qcut(pd.Series(values), 5, labels=[5, 4, 3, 2, 1]).astype(int).tolist()
    assert got == exp


def test_qcut_values_duplicate_edges_raise(spark):
    values = [4, 4, 4, 4, 9]  # qcut_duplicate_edges: four equal values of five
    with pytest.raises(ValueError):
        pd.qcut(pd.Series(values), 5, labels=[5, 4, 3, 2, 1])
    df = spark.createDataFrame([(v,) for v in values], "x long")
    edges = quantile_edges(df, "x", 5)
    j = df.withColumn("_k", F.lit(1)).join(edges.withColumn("_k", F.lit(1)), "_k")
    e = [F.col(f"e{k}") for k in range(6)]
    with pytest.raises(Exception, match="unique"):
        j.select(qcut_values("x", e, [5, 4, 3, 2, 1])).collect()


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [round(rnd.uniform(0, 1000), 2) for _ in range(301)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "v", probs, tie=["k"], num_partitions=4).toPandas()
    got = dict(zip(got["p"], got["quantile"]))
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def _brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_roc_auc_matches_pairwise_brute_force(spark):
    rnd = random.Random(11)
    rows = [(i, int(rnd.random() < 0.3), float(rnd.randint(0, 15))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, y int, s double")
    got = ev.roc_auc(df, "y", "s").collect()[0]["auc"]
    assert got == pytest.approx(_brute_auc([r[1] for r in rows], [r[2] for r in rows]), abs=1e-12)


def test_roc_auc_per_group(spark):
    rows = [(g, i, int(i % 3 == 0), float((i * 7) % 10)) for g in (0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, k long, y int, s double")
    got = {r["g"]: r["auc"] for r in ev.roc_auc(df, "y", "s", group="g").collect()}
    for g in (0, 1):
        sub = [r for r in rows if r[0] == g]
        assert got[g] == pytest.approx(_brute_auc([r[2] for r in sub], [r[3] for r in sub]))


def test_stratified_folds_imbalanced(spark):
    # imbalanced_target: 44 of 1,000 positive -> each fold holds 8 or 9
    rows = [(i, int(i % 1000 < 44)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y int")
    f = ev.stratified_folds(df, "y", "k", k=5, seed=42).toPandas()
    pos = f[f.y == 1].groupby("fold").size()
    neg = f[f.y == 0].groupby("fold").size()
    assert sorted(pos.tolist()) == [8, 9, 9, 9, 9]
    assert set(neg.tolist()) <= {191, 192}
    # deterministic
    f2 = ev.stratified_folds(df, "y", "k", k=5, seed=42).toPandas()
    assert f.sort_values("k")["fold"].tolist() == f2.sort_values("k")["fold"].tolist()


def test_class_weights_balanced(spark):
    rows = [(i, int(i < 44)) for i in range(1000)]
    w = {r["y"]: r["weight"] for r in ev.class_weights(spark.createDataFrame(rows, "k long, y int"), "y").collect()}
    assert w[1] == pytest.approx(1000 / (2 * 44))
    assert w[0] == pytest.approx(1000 / (2 * 956))


def test_lift_known_scores(spark):
    # lift_known: deterministic scores, cutoff = interpolated 0.9 quantile, >=
    rows = [(i, float(i), int(i >= 95 or i % 10 == 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, s double, y int")
    r = ev.top_fraction_lift(df, "y", "s", 0.9, tie="k").collect()[0]
    cutoff = float(np.quantile([x[1] for x in rows], 0.9))
    flagged = [x for x in rows if x[1] >= cutoff]
    assert r["cutoff"] == pytest.approx(cutoff)
    assert r["flagged"] == len(flagged)
    assert r["hits"] == sum(x[2] for x in flagged)
    base = sum(x[2] for x in rows) / 100
    assert r["lift"] == pytest.approx((r["hits"] / r["flagged"]) / base)


def test_confusion_and_report(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)]
    df = spark.createDataFrame(rows, "y int, p int")
    cm = {(r["label"], r["prediction"]): r["n"] for r in ev.confusion_matrix(df, "y", "p").collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 2}
    rep = {r["class"]: r for r in ev.classification_report(df, "y", "p").collect()}
    assert rep[1]["precision"] == pytest.approx(2 / 3)
    assert rep[1]["recall"] == pytest.approx(2 / 3)
    assert rep[0]["support"] == 3


def test_bounded_quantiles_match_numpy(spark):
    from repeatlens.operators.ranking import bounded_quantiles

    rnd = random.Random(5)
    vals = [rnd.randint(0, 30) / 2.0 for _ in range(257)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    probs = [0.0, 0.2, 0.25, 0.5, 0.8, 1.0]
    got = {r["p"]: r["quantile"] for r in bounded_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_stratified_folds_string_keys(spark):
    rows = [(f"person-{i:04d}", int(i % 10 == 0)) for i in range(200)]
    f = ev.stratified_folds(spark.createDataFrame(rows, "k string, y int"), "y", "k").toPandas()
    assert sorted(f[f.y == 1].groupby("fold").size().tolist()) == [4, 4, 4, 4, 4]
    assert sorted(f[f.y == 0].groupby("fold").size().tolist()) == [36, 36, 36, 36, 36]
