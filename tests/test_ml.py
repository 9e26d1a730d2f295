"""Model pipeline properties on small data with light hyper-parameters."""

import os

import pytest
from pyspark.sql import functions as F

from repeatlens.operators import evaluation as ev
from repeatlens.plans import features, modeling
from repeatlens.scope import driver_scope
from repeatlens.sources.driver_adapter import from_driver_tables

SF = "/root/testdata/sf0.01"
FAST = modeling.ModelParams(lr_max_iter=50, rf_trees=10, gbt_iter=10)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def mp(spark):
    return from_driver_tables(spark, SF)


def test_model_frame_folds_and_weights(mp):
    f = modeling.model_frame(mp, driver_scope(), FAST).toPandas()
    assert set(f.fold) == {0, 1, 2, 3, 4}
    pos = f[f.label == 1].groupby("fold").size()
    assert pos.max() - pos.min() <= 1          # stratified within one row
    assert "weight" not in f.columns  # belongs to the training folds, see below
    assert len(f) == features.features_imputed(mp, driver_scope()).count()


def test_weights_and_prior_come_from_the_training_folds(spark):
    rows = [(i, float(i % 3 == 0 or i % 5 == 1), i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, label double, fold int")
    train = df.filter("fold <> 1")
    got = {r.label: r.weight for r in ev.with_class_weight(train, "label").collect()}
    n, pos = train.count(), train.filter("label = 1").count()
    assert got[1.0] == pytest.approx(n / (2 * pos))
    assert got[0.0] == pytest.approx(n / (2 * (n - pos)))
    scored = modeling.dummy_scores(df, FAST)
    assert scored.count() == 60 and set(scored.columns) == {"id", "label", "fold", "score"}


def test_feature_names_drop_first_level(mp):
    frame = modeling.model_frame(mp, driver_scope(), FAST)
    model, names = modeling.feature_stages(frame)
    vec = model.transform(frame).select("features").first().features
    assert len(names) == vec.size
    cats = sorted(r[0] for r in frame.select("category").distinct().collect())
    assert f"category_{cats[0]}" not in names and f"category_{cats[1]}" in names


def test_cv_comparison_shape_and_dummy(mp):
    res = modeling.cv_model_comparison(mp, driver_scope(), FAST).toPandas()
    assert list(res.columns) == ["model", "mean_roc_auc", "std"]
    assert set(res.model) == {"Dummy (baseline)", "Logistic Regression", "Random Forest",
                              "Gradient Boosting"}
    assert res.mean_roc_auc.between(0, 1).all()
    dummy = res[res.model == "Dummy (baseline)"].mean_roc_auc.iloc[0]
    assert 0.3 < dummy < 0.7


def test_final_model_outputs(mp):
    ev_row = modeling.final_model_evaluation(mp, driver_scope(), FAST).collect()[0]
    assert 0.0 <= ev_row.auc <= 1.0
    assert ev_row.flagged >= 1 and ev_row.hits <= ev_row.flagged
    imp = modeling.feature_importances(mp, driver_scope(), FAST).toPandas()
    assert len(imp) <= 15 and imp.importance.is_monotonic_decreasing


def test_planted_signal_is_recovered(spark):
    # label depends on x: the exact AUC of x must be high, a random score ~0.5
    df = spark.range(0, 2000).select(
        F.col("id"), (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0).alias("x"))
    df = df.withColumn("y", (F.col("x") > 0.8).cast("int"))
    assert ev.roc_auc(df, "y", "x").collect()[0].auc == pytest.approx(1.0)
    rnd = df.withColumn("r", F.rand(42))
    assert 0.4 < ev.roc_auc(rnd, "y", "r").collect()[0].auc < 0.6


def test_dashboard_marts_with_models(spark, mp):
    import tempfile

    from repeatlens.plans import bi

    out = tempfile.mkdtemp(prefix="repeatlens-marts-ml-")
    paths = bi.write_dashboard_marts(mp, driver_scope(), out, include_models=True, model_params=FAST)
    assert spark.read.parquet(paths["model_comparison"]).count() == 4
    assert spark.read.parquet(paths["model_lift"]).count() == 1


def test_fixed_seed_repeats(mp):
    a = modeling.final_model_evaluation(mp, driver_scope(), FAST).collect()[0]
    b = modeling.final_model_evaluation(mp, driver_scope(), FAST).collect()[0]
    assert a == b
