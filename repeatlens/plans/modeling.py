"""ML-1..18: repeat-purchase models with pyspark.ml.

Feature matrix: numeric features + dummies (alphabetically first level
dropped, NULL -> all zeros) assembled into a vector column.  Models are
compared with stratified k-fold CV on one shared fold column; the final
model is fitted on a stratified 75/25 split and reported with ROC-AUC,
confusion matrix, importances and top-decile lift.  Training runs on the
executors; only metrics and importances come back to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.functions.columns import round_half, with_scalars
from repeatlens.operators.encoding import level_dictionary, moments, slots, sparse_matrix
from repeatlens.operators.evaluation import (classification_report, confusion_matrix,
                                             prob_positive, roc_auc, stratified_folds,
                                             stratified_split, top_fraction_lift,
                                             with_class_weight)
from repeatlens.operators.logistic import fit_logistic
from repeatlens.operators.trees import Slots, cross_validate_trees
from repeatlens.plans.features import CATEGORICAL, features_imputed, label_frame
from repeatlens.plans.model_store import stored_fit
from repeatlens.scope import Scope
from repeatlens.session import ensure_checkpoint_dir, write_shared
from repeatlens.sources.tables import Marketplace

LABEL, KEY = "repeat_customer", "customer_unique_id"
MODEL_NUMERIC = ["payment_installments", "payment_value", "review_score", "delivery_days",
                 "days_early_or_late", "purchase_weekday", "no_review", "no_payment"]


@dataclass(frozen=True)
class ModelParams:
    # fixed values: the reference's model settings
    folds: int = 5
    seed: int = 42
    lr_max_iter: int = 1000
    rf_trees: int = 300
    rf_depth: int = 6
    rf_min_leaf: int = 20
    gbt_iter: int = 200
    gbt_depth: int = 3
    gbt_step: float = 0.05
    test_fraction: float = 0.25
    top_quantile: float = 0.9
    # the grid and its halving are ours: the reference gives none
    grid_depths: tuple[int, ...] = (2, 3)
    grid_steps: tuple[float, ...] = (0.05, 0.1)
    grid_rungs: tuple[int, ...] = (10, 30, 100)
    auc_bins: int = 0  # 0 = exact ROC, no down-sampling
    parallelism: int = 8  # concurrent (model, fold) fits


#: Rows of a training task, at least (where cores allow) and at most.
TASK_ROWS = (20_000, 1_000_000)


def training_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read by few tasks.

    A fit runs hundreds of short stages.  What each of their tasks reports to
    the driver grows with the plan that the rows come from, and a stage has a
    task for each partition of it; here the plan is one scan, and there are as
    many tasks as cores, fewer for few rows and more only beyond
    ``TASK_ROWS`` rows for each."""
    rows = write_shared(df, name)
    least, most = TASK_ROWS
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(1, min(cores, -(-n // least)), -(-n // most)))


def model_frame(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams()) -> DataFrame:
    """``model_rows`` with the fold id."""
    return stratified_folds(model_rows(mp, scope), LABEL, KEY, k=p.folds, seed=p.seed)


def model_rows(mp: Marketplace, scope: Scope) -> DataFrame:
    """Imputed features with label (double).

    Categorical NULLs become the column's alphabetically first level, so
    after dropping that level they encode as all zeros (as get_dummies).
    No row is dropped: customers without a payment row get value and
    instalments 0 and ``no_payment`` = 1, and scores without any review to
    take a median from become 0 (``no_review`` is 1 for all then)."""
    f = features_imputed(mp, scope)
    f = f.withColumn("no_payment", F.col("payment_value").isNull().cast("int"))
    f = f.na.fill(0.0, ["payment_value", "payment_installments", "review_score"])
    firsts = f.agg(*[F.min(c).alias(f"_first_{c}") for c in CATEGORICAL])
    f = with_scalars(f, firsts)
    for c in CATEGORICAL:
        f = f.withColumn(c, F.coalesce(F.col(c), F.col(f"_first_{c}"))).drop(f"_first_{c}")
    return f.withColumn("label", F.col(LABEL).cast("double"))


def feature_stages(df: DataFrame) -> tuple[PipelineModel, list[str]]:
    """Fitted indexer/encoder/assembler and the names of the vector slots.

    StringIndexer ``alphabetDesc`` gives the alphabetically first level the
    last index; OneHotEncoder(dropLast) then drops exactly that level.
    Levels are a vocabulary (the indexer keeps its label list on the driver);
    fitting them on the full table uses no label information."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc").fit(df)
                for c in CATEGORICAL]
    # a column with one level has its baseline only, and no dummy
    held = [c for c, m in zip(CATEGORICAL, indexers) if len(m.labels) > 1]
    indexed = PipelineModel(indexers).transform(df)
    enc = [OneHotEncoder(inputCols=[f"{c}_idx" for c in held], outputCols=[f"{c}_vec" for c in held],
                         dropLast=True).fit(indexed)] if held else []
    asm = VectorAssembler(inputCols=MODEL_NUMERIC + [f"{c}_vec" for c in held],
                          outputCol="features", handleInvalid="error")
    model = PipelineModel([*indexers, *enc, asm])
    return model, _slot_names(model)


def _slot_names(model: PipelineModel) -> list[str]:
    names = list(MODEL_NUMERIC)
    for c, im in zip(CATEGORICAL, model.stages[:len(CATEGORICAL)]):
        labels = list(im.labels)
        names += [f"{c}_{lv}" for lv in labels[:-1]]
    return names


def feature_slots(df: DataFrame) -> DataFrame:
    """(slot, feature, col, level) of the assembled vector, as a table."""
    return write_shared(slots(level_dictionary(df, CATEGORICAL), MODEL_NUMERIC, CATEGORICAL), "slots")


def feature_matrix(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams()) -> DataFrame:
    """ML-4, ML-5: the non-zero cells of the feature vectors, one row each."""
    f = write_shared(model_rows(mp, scope), "model-rows")
    return sparse_matrix(f, KEY, MODEL_NUMERIC, CATEGORICAL, feature_slots(f))


def feature_moments(mp: Marketplace, scope: Scope) -> DataFrame:
    """ML-3: mean and sample deviation of each feature, from the sparse cells."""
    f = write_shared(model_rows(mp, scope), "model-rows")
    table = feature_slots(f)
    out = moments(sparse_matrix(f, KEY, MODEL_NUMERIC, CATEGORICAL, table), table, f.count())
    return out.select("slot", "feature", round_half("mean", 6).alias("mean"), round_half("std", 6).alias("std"))


def _estimators(n_train: int, p: ModelParams) -> dict:
    lr = Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight",
                           maxIter=p.lr_max_iter, regParam=1.0 / max(n_train, 1),
                           elasticNetParam=0.0, standardization=False)])
    rf = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=p.rf_trees,
                                maxDepth=p.rf_depth, minInstancesPerNode=p.rf_min_leaf,
                                featureSubsetStrategy="sqrt", seed=p.seed)
    gbt = GBTClassifier(labelCol="label", maxIter=p.gbt_iter, maxDepth=p.gbt_depth,
                        stepSize=p.gbt_step, seed=p.seed, checkpointInterval=10)
    return {"Logistic Regression": lr, "Random Forest": rf, "Gradient Boosting": gbt}


def _evaluator(p: ModelParams) -> BinaryClassificationEvaluator:
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction",
                                         metricName="areaUnderROC", numBins=p.auc_bins)


def keyed_uniform(keys: Sequence[str], seed: int):
    """A number in [0, 1) for each key: the first 32 bits of md5("seed:key").
    It depends on the key alone, not on partitions or row order."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _with_prior(df: DataFrame) -> DataFrame:
    """``prior``: the share of positives in the other folds."""
    whole = df.agg(F.sum("label").alias("_pos"), F.count("label").alias("_n"))
    folds = df.groupBy("fold").agg(F.sum("label").alias("_fp"), F.count("label").alias("_fn"))
    return df.join(with_scalars(folds, whole).select("fold", F.try_divide(
        F.col("_pos") - F.col("_fp"), F.col("_n") - F.col("_fn")).alias("prior")), "fold")


def dummy_scores(df: DataFrame, p: ModelParams, key: str | None = None) -> DataFrame:
    """Stratified dummy: predicts 1 at random, with the share of positives in
    the other folds; the same for a key (default: all columns but label and
    fold) wherever its row stands."""
    keys = [key] if key else [c for c in df.columns if c not in ("label", "fold")]
    return _with_prior(df).withColumn(
        "score", (keyed_uniform(keys, p.seed) < F.col("prior")).cast("double")).drop("prior")


def dummy_baseline(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams()) -> DataFrame:
    """ML-6: the dummy's prior, positive guesses and exact ROC-AUC in each fold."""
    folds = stratified_folds(label_frame(mp, scope, value=False), LABEL, KEY, k=p.folds, seed=p.seed)
    rows = _with_prior(folds.withColumn("label", F.col(LABEL).cast("double")))
    data = write_shared(rows.select("fold", "label", "prior", (
        keyed_uniform([KEY], p.seed) < F.col("prior")).cast("double").alias("score")), "dummy")
    guessed = data.groupBy("fold").agg(F.first("prior").alias("prior"),
                                       F.sum("score").cast("bigint").alias("guessed"))
    auc = roc_auc(data.withColumn("label", F.col("label").cast("int")), "label", "score", group="fold")
    return guessed.join(auc.drop("unscored"), "fold")


def cross_validate(estimators: dict, data: DataFrame, p: ModelParams) -> dict[str, list[float]]:
    """Fold ROC-AUCs per model on the shared ``fold`` column.

    Every (model, fold) fit is an independent Spark job chain; they are
    submitted from a thread pool (``p.parallelism``) so the cluster runs
    them side by side -- ``CrossValidator`` runs folds one after another
    and parallelises only across a parameter grid.  Same folds, same
    evaluator, so the numbers equal a sequential run.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    evaluator = _evaluator(p)

    def fit_one(task):
        name, k = task
        train, valid = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        train = with_class_weight(train, "label")  # balanced within the training folds
        model = estimators[name].fit(train)
        return name, k, float(evaluator.evaluate(model.transform(valid)))

    tasks = [(name, k) for name in estimators for k in range(p.folds)]
    with ThreadPoolExecutor(max_workers=max(1, p.parallelism)) as pool:
        results = list(pool.map(inheritable_thread_target(data.sparkSession)(fit_one), tasks))
    out: dict[str, list[float]] = {name: [0.0] * p.folds for name in estimators}
    for name, k, auc in results:
        out[name][k] = auc
    return out


def compare_models(data: DataFrame, feats: PipelineModel, n_train: int, p: ModelParams) -> dict[str, list[float]]:
    """Fold ROC-AUCs of the three learners.  The two of trees are grown from
    binned columns (``operators.trees``) beside the library's logistic
    regression.  A training fold of one class has no such trees, and the
    library says what comes of it."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    ests = _estimators(n_train, p)
    held = {(r.fold, r.label) for r in data.select("fold", "label").distinct().collect()}
    if any({y for f, y in held if f != k} != {0.0, 1.0} for k in range(p.folds)):
        return cross_validate(ests, data, p)
    levels = [len(m.labels) for m in feats.stages[:len(CATEGORICAL)]]
    slots = Slots(len(MODEL_NUMERIC), tuple(n - 1 for n in levels if n > 1))
    first = {name: est for name, est in ests.items() if name == "Logistic Regression"}
    with ThreadPoolExecutor(1) as beside:
        linear = beside.submit(inheritable_thread_target(data.sparkSession)(cross_validate), first, data, p)
        forest, boosting = cross_validate_trees(ests["Random Forest"], ests["Gradient Boosting"], data, slots,
                                                p.folds, _evaluator(p), p.parallelism)
        return linear.result() | {"Random Forest": forest, "Gradient Boosting": boosting}


def model_frame_row_check(mp: Marketplace, scope: Scope) -> DataFrame:
    """Rows of the feature table and of the model frame: no customer is lost."""
    a = features_imputed(mp, scope).agg(F.count(F.lit(1)).alias("feature_rows"))
    b = model_frame(mp, scope).agg(F.count(F.lit(1)).alias("model_rows"),
                                   F.count_if(F.col("no_payment") == 1).alias("without_payment"))
    return with_scalars(a, b)


def model_fold_sizes(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams()) -> DataFrame:
    """ML-10 on the model frame: customers and repeat customers per fold."""
    return model_frame(mp, scope, p).groupBy("fold").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("label")).cast("bigint").alias("repeat_customers"))


def cv_model_comparison(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                        frame: DataFrame | None = None) -> DataFrame:
    """ML-6..10, ML-17: mean and (population) std of fold ROC-AUC per model, best first.

    ``frame``: a prebuilt ``model_frame`` to reuse across model jobs."""
    import numpy as np

    spark = mp.orders.sparkSession
    ensure_checkpoint_dir(spark)
    data = frame if frame is not None else model_frame(mp, scope, p)
    feats, _ = feature_stages(data)
    data = training_rows(feats.transform(data).select("label", "fold", "features", KEY), "folds")
    n = data.count()
    n_train = int(n * (p.folds - 1) / p.folds)
    rows = []
    # dummy: per-fold exact AUC of a random stratified guess
    dscore = dummy_scores(data, p, KEY)
    per_fold = roc_auc(dscore.withColumn("label", F.col("label").cast("int")), "label", "score",
                       group="fold").select("auc").toPandas()["auc"]
    rows.append(("Dummy (baseline)", float(per_fold.mean()), float(per_fold.std(ddof=0))))
    for name, aucs in compare_models(data, feats, n_train, p).items():
        rows.append((name, float(np.mean(aucs)), float(np.std(aucs))))
    return spark.createDataFrame(rows, "model string, mean_roc_auc double, std double") \
        .orderBy(F.desc("mean_roc_auc"))


def logistic_regression(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                        frame: DataFrame | None = None) -> DataFrame:
    """ML-3, ML-7: the balanced logistic regression over all customers, by
    Newton steps: (slot, feature, mean, std, coefficient, gradient).
    Coefficients belong to standardised features; the row of slot -1 is the
    intercept.  A gradient of 0 shows that the fit is the optimum."""
    data = frame if frame is not None else model_rows(mp, scope)
    feats, names = feature_stages(data)
    rows = write_shared(with_class_weight(feats.transform(data).select("label", "features"), "label"),
                        "logistic")
    fit = fit_logistic(rows, "features", "label", "weight", reg=1.0 / max(rows.count(), 1))
    out = [(-1, "(intercept)", None, None, fit.intercept, float(fit.gradient[-1]))]
    out += [(i, n, float(fit.mean[i]), float(fit.std[i]), float(fit.coefficients[i]),
             float(fit.gradient[i])) for i, n in enumerate(names)]  # one row per feature
    return rows.sparkSession.createDataFrame(
        out, "slot int, feature string, mean double, std double, coefficient double, gradient double")


def _fit_final(data: DataFrame, p: ModelParams) -> tuple[PipelineModel, DataFrame]:
    """The boosting pipeline fitted on the stratified 75 % and the scored rest."""
    feats, _ = feature_stages(data)
    rows = training_rows(stratified_split(feats.transform(data).select(KEY, LABEL, "label", "features"),
                                          LABEL, KEY, p.test_fraction, p.seed), "split")
    model = _estimators(1, p)["Gradient Boosting"].fit(rows.filter(~F.col("is_test")))
    scored = model.transform(rows.filter("is_test")).select(
        KEY, LABEL, prob_positive("probability").alias("score"), F.col("prediction").cast("int"))
    return PipelineModel(stages=[feats, model]), scored


def final_model(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                frame: DataFrame | None = None, store: str | None = None):
    """The boosting model of the stratified 75 % split: (scored test frame,
    fitted model, feature names).  It is fitted once for equal rows and
    parameters and read from the store after that (``model_store``)."""
    data = frame if frame is not None else write_shared(model_rows(mp, scope), "model-rows")
    data = data.select(KEY, LABEL, "label", *MODEL_NUMERIC, *CATEGORICAL)
    pipeline, scored = stored_fit(data, p, lambda: _fit_final(data, p), store)
    feats, model = pipeline.stages
    return scored, model, _slot_names(feats)


def feature_importances(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                        top: int = 15, frame: DataFrame | None = None) -> DataFrame:
    """ML-15: top feature importances of the final model."""
    spark = mp.orders.sparkSession
    _, model, names = final_model(mp, scope, p, frame)
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def final_model_evaluation(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                           frame: DataFrame | None = None) -> DataFrame:
    """ML-12..16: hold-out ROC-AUC, confusion cells and top-decile lift."""
    scored, _, _ = final_model(mp, scope, p, frame)
    auc = roc_auc(scored, LABEL, "score").select("auc")
    lift = top_fraction_lift(scored, LABEL, "score", p.top_quantile, tie=KEY)
    rep = (classification_report(scored, LABEL, "prediction").filter("class = 1")
           .select(F.col("precision").alias("precision_repeat"),
                   F.col("recall").alias("recall_repeat"), F.col("f1").alias("f1_repeat")))
    return with_scalars(with_scalars(auc, lift), rep)


def final_confusion_matrix(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                           frame: DataFrame | None = None) -> DataFrame:
    """ML-14: confusion cells of the final model on the hold-out split."""
    scored, _, _ = final_model(mp, scope, p, frame)
    return confusion_matrix(scored, LABEL, "prediction")


def prefix_model(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model of the first ``n`` trees.  Boosting adds one tree after
    another, so this is the model that a fit of ``n`` iterations gives."""
    sc = SparkSession.active().sparkContext
    jvm, java = sc._jvm.org.apache.spark.ml, model._java_obj
    trees = sc._gateway.new_array(jvm.regression.DecisionTreeRegressionModel, n)
    weights = sc._gateway.new_array(sc._gateway.jvm.double, n)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = jvm.classification.GBTClassificationModel(java.uid(), trees, weights, model.numFeatures, 2)
    return GBTClassificationModel(cut)


def staged_scores(estimators: dict, data: DataFrame, p: ModelParams, stages: Sequence[int]) -> dict:
    """{(name, iterations): fold ROC-AUCs}: one fit per (name, fold), scored
    after each of ``stages`` iterations by its first trees.  Fits run side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    evaluator = _evaluator(p)

    def fit_one(task):
        name, k = task
        model = estimators[name].fit(data.filter(F.col("fold") != k))
        valid = data.filter(F.col("fold") == k)
        return [((name, n), k, float(evaluator.evaluate(prefix_model(model, n).transform(valid))))
                for n in stages]

    tasks = [(name, k) for name in estimators for k in range(p.folds)]
    with ThreadPoolExecutor(max_workers=max(1, p.parallelism)) as pool:
        results = list(pool.map(inheritable_thread_target(data.sparkSession)(fit_one), tasks))
    out: dict = {}
    for point, k, auc in sorted(x for r in results for x in r):
        out.setdefault(point, []).append(auc)
    return out


def grid_search(mp: Marketplace, scope: Scope, p: ModelParams = ModelParams(),
                frame: DataFrame | None = None) -> DataFrame:
    """ML-18: boosting grid (depth x learning rate x iterations) on the *same*
    fold column as the model comparison, so its scores are comparable with it.

    Successive halving: all points are fitted with the fewest iterations of
    ``p.grid_rungs``; the better half by mean ROC-AUC (ties: the shallower,
    then slower one) goes on to the next number, and so on.  ``rung`` says
    how far a point came.  The assembled frame is written once for all fits.
    """
    import numpy as np

    data = frame if frame is not None else model_frame(mp, scope, p)
    spark = data.sparkSession
    feats, _ = feature_stages(data)
    data = training_rows(feats.transform(data).select("label", "fold", "features"), "grid")
    gbt = _estimators(1, p)["Gradient Boosting"]
    points = [(d, st) for d in p.grid_depths for st in p.grid_steps]
    rows = []
    for rung, n in enumerate(p.grid_rungs):
        ests = {pt: gbt.copy({gbt.maxDepth: pt[0], gbt.stepSize: pt[1], gbt.maxIter: n}) for pt in points}
        scores = staged_scores(ests, data, p, [n])
        found = [(*pt, n, rung, float(np.mean(scores[pt, n])), float(np.std(scores[pt, n]))) for pt in points]
        rows += found
        ranked = sorted(found, key=lambda r: (-r[4], r[0], r[1]))
        points = [r[:2] for r in ranked[:(len(ranked) + 1) // 2]]
    return spark.createDataFrame(
        rows, "max_depth int, step_size double, iterations int, rung int, mean_roc_auc double, std double") \
        .orderBy(F.desc("mean_roc_auc"), "max_depth", "step_size", "iterations")
