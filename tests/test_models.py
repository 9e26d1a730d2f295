"""Model inputs, the Newton fit, the store and the staged grid on small data."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from repeatlens.operators import encoding, logistic
from repeatlens.plans import modeling, model_store
from repeatlens.session import write_shared

NUM = modeling.MODEL_NUMERIC
FAST = modeling.ModelParams(folds=3, gbt_iter=6, grid_depths=(2, 3), grid_steps=(0.1, 0.3),
                            grid_rungs=(2, 4, 6), parallelism=4)


@pytest.fixture(scope="module")
def frame(spark):
    """A model frame with levels of odd names, a constant feature and zeros."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        x = rng.normal(size=3)
        cat = ["zeta", "alpha", "b c", "Alpha"][rng.integers(0, 4)]
        y = float(rng.random() < 1 / (1 + np.exp(2 - x[0] - (cat == "zeta"))))
        rows.append((i, int(y), y, i % 3, float(rng.integers(0, 3)), float(x[0]), float(x[1]), 7.0,
                     float(x[2]), int(rng.integers(0, 7)), 0, int(rng.random() < 0.1), cat,
                     ["SP", "RJ"][rng.integers(0, 2)], "card"))
    df = spark.createDataFrame(rows, "customer_unique_id long, repeat_customer int, label double, fold int, "
                               "payment_installments double, payment_value double, review_score double, "
                               "delivery_days double, days_early_or_late double, purchase_weekday int, "
                               "no_review int, no_payment int, category string, customer_state string, "
                               "payment_type string")
    return write_shared(df, "model-test")


def test_sparse_cells_are_the_assembled_vector(spark, frame):
    feats, names = modeling.feature_stages(frame)
    want = {r.customer_unique_id: np.array(r.x) for r in feats.transform(frame).select(
        "customer_unique_id", vector_to_array("features").alias("x")).collect()}
    cells = encoding.sparse_matrix(frame, "customer_unique_id", NUM, modeling.CATEGORICAL)
    got = {k: np.zeros(len(names)) for k in want}
    for r in cells.repartition(5).collect():
        assert names[r.slot] == r.feature and r.value != 0
        got[r.customer_unique_id][r.slot] = r.value
    assert all((got[k] == want[k]).all() for k in want)


def test_moments_are_the_scalers(spark, frame):
    feats, names = modeling.feature_stages(frame)
    scaler = StandardScaler(inputCol="features", withMean=True).fit(feats.transform(frame))
    table = modeling.feature_slots(frame)
    m = encoding.moments(encoding.sparse_matrix(
        frame, "customer_unique_id", NUM, modeling.CATEGORICAL, table), table, frame.count())
    rows = sorted(m.collect())
    assert [r.feature for r in rows] == names
    assert np.allclose([r["mean"] for r in rows], scaler.mean.toArray())
    assert np.allclose([r["std"] for r in rows], scaler.std.toArray())


def test_dictionary_of_nothing(spark, frame):
    none = frame.limit(0)
    assert encoding.level_dictionary(none, modeling.CATEGORICAL).count() == 0
    assert encoding.sparse_matrix(none, "customer_unique_id", NUM, modeling.CATEGORICAL).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (2, 3.0, None)], "k long, n double, c string")
    got = encoding.sparse_matrix(odd, "k", ["n"], ["c"]).collect()
    assert [tuple(r) for r in got] == [(2, 0, "n", 3.0)]  # one level is the baseline


def test_newton_reaches_the_optimum(spark, frame):
    feats, _ = modeling.feature_stages(frame)
    rows = write_shared(modeling.with_class_weight(
        feats.transform(frame).select("label", "features"), "label"), "newton")
    fit = logistic.fit_logistic(rows, "features", "label", "weight", reg=1 / 600)
    assert np.abs(fit.gradient).max() < 1e-10 and fit.iterations < 12
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    ml = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=1000,
                            tol=1e-12, regParam=1 / 600, elasticNetParam=0.0, standardization=False).fit(scaled)
    assert np.allclose(fit.coefficients, ml.coefficients.toArray(), atol=1e-5)
    assert fit.intercept == pytest.approx(ml.intercept, abs=1e-5)
    # the gradient by hand, from the rows
    data = rows.select(vector_to_array("features").alias("x"), "label", "weight").collect()
    x = logistic.scaled(np.array([r.x for r in data]), fit.mean, fit.std)
    y, w = np.array([r.label for r in data]), np.array([r.weight for r in data])
    p = 1 / (1 + np.exp(-(x @ fit.coefficients + fit.intercept)))
    assert np.abs(x.T @ (w * (p - y)) / w.sum() + fit.coefficients / 600).max() < 1e-9
    scores = [r.score for r in logistic.score_logistic(rows, fit, "features").collect()]
    assert np.allclose(sorted(scores), sorted(p))


def test_newton_refuses_what_has_no_optimum(spark):
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, 1.0)], "x double, label double, weight double"))
    with pytest.raises(ValueError, match="both classes"):
        logistic.fit_logistic(df, "features", "label", "weight", 0.1)
    with pytest.raises(ValueError, match="no rows"):
        logistic.fit_logistic(df.limit(0), "features", "label", "weight", 0.1)
    with pytest.raises(ValueError, match="Gram"):
        logistic.fit_logistic(df, "features", "label", "weight", 0.1, max_features=0)


def test_logistic_query_rows(spark, frame):
    rows = modeling.logistic_regression(_Mp(spark), None, FAST, frame).collect()
    assert [r.slot for r in rows] == list(range(-1, len(rows) - 1))
    assert max(abs(r.gradient) for r in rows) < 1e-9


class _Mp:
    """Stands for a marketplace where a prebuilt frame is given."""

    def __init__(self, spark):
        self.orders = spark.range(1)


def test_dummy_is_the_same_in_any_partitioning(spark, frame):
    df = frame.select("customer_unique_id", "label", "fold")
    key = lambda d: sorted((r.customer_unique_id, r.score) for r in d.collect())
    a = modeling.dummy_scores(df.repartition(1), FAST, "customer_unique_id")
    b = modeling.dummy_scores(df.repartition(7, "label"), FAST, "customer_unique_id")
    assert key(a) == key(b)
    share = np.mean([s for _, s in key(a)])
    assert abs(share - frame.agg(F.avg("label")).first()[0]) < 0.06


def test_one_fit_serves_three_jobs(spark, frame, monkeypatch, tmp_path):
    fits = []
    real = modeling._fit_final
    monkeypatch.setattr(modeling, "_fit_final", lambda *a: fits.append(1) or real(*a))
    p = modeling.ModelParams(gbt_iter=4, seed=77)
    mp = _Mp(spark)
    importances = modeling.feature_importances(mp, None, p, frame=frame).collect()
    modeling.final_model_evaluation(mp, None, p, frame.repartition(3)).collect()
    modeling.final_confusion_matrix(mp, None, p, frame).collect()
    assert len(fits) == 1
    modeling.feature_importances(mp, None, modeling.ModelParams(gbt_iter=4, seed=78), frame=frame)
    assert len(fits) == 2
    changed = frame.withColumn("payment_value", F.when(F.col("customer_unique_id") == 5, 0.0)
                               .otherwise(F.col("payment_value")))
    modeling.feature_importances(mp, None, p, frame=changed)
    assert len(fits) == 3
    # a fit that was cut short, without its marker, is made again
    calls = []
    def fit():
        calls.append(1)
        return real(frame, p)
    store = str(tmp_path / "store")
    model_store.stored_fit(frame, p, fit, store)
    name = model_store.frame_digest(frame, p)
    (tmp_path / "store" / name / "marker" / "_SUCCESS").unlink()
    model, scored = model_store.stored_fit(frame, p, fit, store)
    assert len(calls) == 2 and scored.count() == 150
    again, _ = model_store.stored_fit(frame, p, fit, store)
    assert len(calls) == 2
    assert again.stages[1].featureImportances == model.stages[1].featureImportances
    assert importances


def test_prefix_of_a_fit_is_the_shorter_fit(spark, frame):
    feats, _ = modeling.feature_stages(frame)
    data = write_shared(feats.transform(frame).select("label", "fold", "features"), "prefix")
    gbt = modeling._estimators(1, FAST)["Gradient Boosting"]
    staged = modeling.staged_scores({"m": gbt}, data, FAST, [2, 4, 6])
    for n in (2, 4, 6):
        alone = modeling.cross_validate({"m": gbt.copy({gbt.maxIter: n})}, data.withColumn(
            "weight", F.lit(1.0)).drop("weight"), FAST)
        assert staged["m", n] == pytest.approx(alone["m"], abs=1e-12)


def test_halving_keeps_the_better_half(spark, frame):
    rows = modeling.grid_search(_Mp(spark), None, FAST, frame).collect()
    by_rung = {k: [r for r in rows if r.rung == k] for k in range(3)}
    assert [len(by_rung[k]) for k in range(3)] == [4, 2, 1]
    for k in (0, 1):
        order = sorted(by_rung[k], key=lambda r: (-r.mean_roc_auc, r.max_depth, r.step_size))
        assert {(r.max_depth, r.step_size) for r in by_rung[k + 1]} == {
            (r.max_depth, r.step_size) for r in order[:len(by_rung[k + 1])]}
        assert {r.iterations for r in by_rung[k]} == {FAST.grid_rungs[k]}
    assert all(0 <= r.mean_roc_auc <= 1 for r in rows)


def test_training_rows_are_one_scan_in_few_tasks(spark, frame, monkeypatch):
    rows = frame.repartition(7).join(frame.select("customer_unique_id").distinct(), "customer_unique_id")
    few = modeling.training_rows(rows, "few")
    assert few.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, rows.collect()))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(modeling, "TASK_ROWS", (100, 200))  # 600 rows: three tasks at least
    assert 3 <= modeling.training_rows(rows, "more").rdd.getNumPartitions() <= 7
    monkeypatch.setattr(modeling, "TASK_ROWS", (400, 10**6))
    assert modeling.training_rows(rows, "two").rdd.getNumPartitions() <= 2


def test_final_fit_reads_written_rows(spark, frame, monkeypatch, tmp_path):
    """The rows of a fit come from one scan: no join or exchange is part of
    each of its stages."""
    plans = []
    fit = modeling.GBTClassifier.fit

    def spy(self, df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return fit(self, df, *args)

    monkeypatch.setattr(modeling.GBTClassifier, "fit", spy)
    modeling.final_model(None, None, FAST, frame, store=str(tmp_path))
    assert plans and not any("Join" in p or "LogicalRDD" in p for p in plans)


def test_class_weights_leave_rows_where_they_are(spark, frame):
    from repeatlens.operators.evaluation import with_class_weight

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = with_class_weight(frame, "label")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
