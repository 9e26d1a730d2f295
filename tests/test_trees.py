"""The trees over binned columns are the library's, on rows built here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatlens.operators import trees
from repeatlens.plans import modeling
from repeatlens.session import write_shared

P = modeling.ModelParams(folds=3, rf_trees=12, rf_min_leaf=5, gbt_iter=8, lr_max_iter=20, parallelism=4)


def model_rows(spark, n, seed=3, copies=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(size=3)
        cat = ["zeta", "alpha", "b c", "Alpha"][rng.integers(0, 4)]
        y = int(rng.random() < 1 / (1 + np.exp(1 - x[0] - 2 * (cat == "zeta"))))
        rows += [(i * copies + c, float(y), i % 3, float(rng.integers(0, 3)), round(float(x[0]), 2), float(x[1]), 7.0,
                  round(float(x[2]), 1), int(rng.integers(0, 7)), 0, int(rng.random() < 0.1), cat,
                  ["SP", "RJ", "MG"][rng.integers(0, 3)], "card") for c in range(copies)]
    return spark.createDataFrame(rows, "customer_unique_id long, label double, fold int, "
                                 "payment_installments double, payment_value double, review_score double, "
                                 "delivery_days double, days_early_or_late double, purchase_weekday int, "
                                 "no_review int, no_payment int, category string, customer_state string, "
                                 "payment_type string")


def assembled(df, tasks):
    feats, _ = modeling.feature_stages(df)
    data = write_shared(feats.transform(df).select("label", "fold", "features").repartition(tasks), "trees")
    return feats, data.coalesce(tasks)


SLOTS = trees.Slots(8, (3, 2))  # one payment type has no dummy


def both(data, p=P, **settings):
    ests = modeling._estimators(1, p)
    rf, gbt = ests["Random Forest"], ests["Gradient Boosting"]
    rf = rf.copy({rf.getParam(k): v for k, v in settings.items()})
    got = trees.cross_validate_trees(rf, gbt, data, SLOTS, p.folds, modeling._evaluator(p), p.parallelism)
    want = modeling.cross_validate({"rf": rf, "gbt": gbt}, data, p)
    return got, (want["rf"], want["gbt"])


@pytest.mark.parametrize("tasks", [1, 3])
def test_scores_are_the_librarys(spark, tasks):
    _, data = assembled(model_rows(spark, 900), tasks)
    got, want = both(data)
    assert got[0] == pytest.approx(want[0], abs=1e-9)
    assert got[1] == pytest.approx(want[1], abs=1e-9)


def test_nodes_that_do_not_fit_one_pass(spark):
    _, data = assembled(model_rows(spark, 900), 1)
    p = modeling.ModelParams(folds=3, rf_trees=100, rf_min_leaf=1, rf_depth=8, gbt_iter=1)
    got, want = both(data, p, maxMemoryInMB=1)
    assert got[0] == pytest.approx(want[0], abs=1e-9)


def test_candidate_splits_from_a_sample(spark):
    """Above 10,000 training rows splits come from the library's sample."""
    _, data = assembled(model_rows(spark, 9000, copies=2), 2)
    got, want = both(data, modeling.ModelParams(folds=3, rf_trees=3, rf_depth=4, gbt_iter=3))
    assert got[0] == pytest.approx(want[0], abs=1e-9)
    assert got[1] == pytest.approx(want[1], abs=1e-9)


def test_columns_that_share_their_sums(spark, monkeypatch):
    """Sums of many rows are made otherwise, by groups and in blocks."""
    from repeatlens.operators.trees import Columns, Forest, _bins, _class_sums, _fold_sums

    rng = np.random.default_rng(1)
    n, thr = 5000, [np.arange(k, dtype=float) for k in (2, 3, 30, 0, 9, 6, 1, 1)]
    bins = np.array([rng.integers(0, len(t) + 1, n) for t in thr], np.uint8)
    base = np.array([rng.integers(0, 4, n), rng.integers(0, 3, n), rng.integers(0, 2, n), np.zeros(n)], np.uint16)
    cols, g, tree = Columns(SLOTS, base, bins), rng.normal(size=n), Forest(1, 3)
    tree.slot[0, 1], tree.cut[0, 1] = 2, 9
    nbins = _bins(SLOTS, thr)
    wide = _fold_sums(cols, nbins, tree, 0, [2, 3], g)
    assert wide[0, :3, 0].sum() == (bins[2] <= 9).sum()
    y, w, idx = base[2], rng.random(n), np.arange(n)
    want = [np.zeros(2 * b) for b in nbins]
    got = [np.zeros(2 * b) for b in nbins]
    num2, code2 = bins * 2 + y, base * 2 + y
    _class_sums(cols, range(SLOTS.size), want, idx, w, y, num2, code2, True)
    _class_sums(cols, range(SLOTS.size), got, idx, w, y, num2, code2, False)
    assert all(np.allclose(a, b) for a, b in zip(want, got, strict=True))
    monkeypatch.setattr(trees, "WIDE_ROWS", 10)
    monkeypatch.setattr(trees, "CACHED", 700)
    assert np.allclose(wide, _fold_sums(cols, nbins, tree, 0, [2, 3], g))


def test_random_numbers_are_the_librarys(spark):
    jvm = spark.sparkContext._jvm
    theirs, ours = jvm.java.util.Random(42), trees.JavaRandom(42)
    for _ in range(5):
        seed = theirs.nextLong()
        mine = ours.next_long()
        assert mine == seed % (1 << 64)
        xor = jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        rand = trees.XorShift([mine])
        assert [xor.nextDouble() for _ in range(3)] == [float(rand.next_double()[0]) for _ in range(3)]
    poisson = jvm.org.apache.commons.math3.distribution.PoissonDistribution(1.0)
    drawn = {r.part: np.frombuffer(bytes(r.cells), np.uint8) for r in
             trees.bootstrap_counts(spark, [4, 6], 3, 42).collect()}
    for part, n in ((0, 4), (1, 6)):
        poisson.reseedRandomGenerator(43 + part)
        assert drawn[part].reshape(3, n).T.ravel().tolist() == [poisson.sample() for _ in range(3 * n)]


def test_exponential_is_the_librarys(spark):
    x = np.concatenate([np.random.default_rng(0).uniform(-6, 6, 300), [0.0, -0.3, 0.4, 1.0, -1.0]])
    strict = spark.sparkContext._jvm.java.lang.StrictMath
    assert trees.library_exp(x).tolist() == [strict.exp(float(v)) for v in x]


def test_lost_margins_are_made_anew(spark, monkeypatch):
    """No file of margins is found (a task on another executor): same scores."""
    _, data = assembled(model_rows(spark, 300), 2)
    thr = [trees.thresholds(np.arange(9.0) - 4, np.ones(9), 9.0, 32)] * 8
    gbt = modeling._estimators(1, P)["Gradient Boosting"]
    scores = []
    for lost in (False, True):
        base = trees.binned(data, SLOTS, [thr] * 3)
        boost = trees.Boosting(base, SLOTS, [thr] * 3, [0, 1, 2], gbt)
        boost.grow(4)
        if lost:
            boost.run = "elsewhere"
        scores.append([sorted(map(tuple, s.collect())) for s in boost.scores()])
    assert scores[0] == scores[1]


def test_comparison_does_not_fit_the_librarys_trees(spark, monkeypatch):
    """The library's forest sends each row through all trees at once; the
    comparison's passes are those of ``operators.trees``."""
    def refuse(*a, **k):
        raise AssertionError("the library's trees")

    monkeypatch.setattr(modeling.RandomForestClassifier, "fit", refuse)
    monkeypatch.setattr(modeling.GBTClassifier, "fit", refuse)

    class Mp:
        orders = spark.range(1)

    frame = model_rows(spark, 300)
    rows = {r.model: r.mean_roc_auc for r in modeling.cv_model_comparison(Mp, None, P, frame).collect()}
    assert len(rows) == 4 and rows["Gradient Boosting"] > 0.6 and rows["Random Forest"] > 0.6


def test_one_class_in_a_training_fold_is_left_to_the_library(spark):
    frame = model_rows(spark, 90).withColumn("label", F.when(F.col("fold") == 0, F.col("label")).otherwise(0.0))
    feats, data = assembled(frame, 1)
    seen = []
    real = modeling.cross_validate
    try:
        modeling.cross_validate = lambda ests, *a: seen.append(sorted(ests)) or {}
        modeling.compare_models(data, feats, 60, P)
    finally:
        modeling.cross_validate = real
    assert len(seen) == 1 and len(seen[0]) == 3
