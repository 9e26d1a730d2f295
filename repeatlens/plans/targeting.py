"""Targeting checks on a deterministic score (SQL-checkable ML operators).

The model pipeline's operators -- class weights, stratified folds and
split, exact ROC-AUC, confusion matrix, classification report, top-decile
lift -- applied to a transparent score: the first order's payment value,
the strongest single signal upstream.  Same operators, no model noise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.operators import evaluation as ev
from repeatlens.plans.features import label_frame
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace

LABEL, KEY, SCORE = "repeat_customer", "customer_unique_id", "payment_value"
TEST_FRACTION, FOLDS, SEED, TOP_Q = 0.25, 5, 42, 0.9


def _base(mp: Marketplace, scope: Scope, features: DataFrame | None = None,
          value: bool = True) -> DataFrame:
    """Key, label and score from ``features`` (a prebuilt ``features_imputed``
    mart) or, by default, of the same customers from the tables."""
    if features is None:
        return label_frame(mp, scope, value)
    return features.select(KEY, LABEL, *([SCORE] if value else []))


def class_weights(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.class_weights(_base(mp, scope, features, False), LABEL)


def stratified_folds(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.stratified_folds(_base(mp, scope, features, False), LABEL, KEY, FOLDS, SEED).select(KEY, LABEL, "fold")


def stratified_split(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.stratified_split(_base(mp, scope, features, False), LABEL, KEY, TEST_FRACTION, SEED).select(
        KEY, LABEL, "is_test")


def _test_rows(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.stratified_split(_base(mp, scope, features), LABEL, KEY, TEST_FRACTION, SEED).filter("is_test")


def roc_auc_rank(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.roc_auc(_base(mp, scope, features), LABEL, SCORE)


def top_decile_lift(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    from repeatlens.functions.columns import round_half

    out = ev.top_fraction_lift(_test_rows(mp, scope, features), LABEL, SCORE, TOP_Q, tie=KEY)
    return out.withColumn("cutoff", round_half("cutoff", 4))


def _flagged(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    from repeatlens.operators.selection import selected_quantiles

    t = _test_rows(mp, scope, features)
    cut = selected_quantiles(t, SCORE, [TOP_Q]).select(F.col("quantile").alias("cutoff"))
    from repeatlens.functions.columns import with_scalars

    j = with_scalars(t, cut)
    # a customer without a score (no payment rows) is not targeted
    flag = F.coalesce(F.col(SCORE) >= F.col("cutoff"), F.lit(False))
    return j.withColumn("prediction", flag.cast("int"))


def confusion_matrix(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.confusion_matrix(_flagged(mp, scope, features), LABEL, "prediction")


def classification_report(mp: Marketplace, scope: Scope, features: DataFrame | None = None) -> DataFrame:
    return ev.classification_report(_flagged(mp, scope, features), LABEL, "prediction")
