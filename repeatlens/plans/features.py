"""FEA-2..5: the customer feature table, imputation, class balance, dummies.

One row per eligible customer.  The reference LEFT-JOINs payments and
reviews to the first order side by side, which emits every
(payment, review) pair of the order; here both are rolled up to one row
per order first (payments: total value, max instalments, main type by
value; reviews: mean score), so the table is linear in the input and has
exactly one row per person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.functions.columns import days_between, round_half, weekday_sun0, with_scalars
from repeatlens.plans.base import child_rows
from repeatlens.plans.cohort import cohort, order_top_category
from repeatlens.scope import Scope
from repeatlens.session import write_shared
from repeatlens.sources.tables import Marketplace

CATEGORICAL = ["category", "customer_state", "payment_type"]
NUMERIC = ["payment_installments", "payment_value", "review_score", "delivery_days",
           "days_early_or_late", "purchase_weekday"]
FEATURE_COLUMNS = ["customer_unique_id", "customer_state", "category", "frequency",
                   "repeat_customer", "payment_installments", "payment_value", "payment_type",
                   "review_score", "delivery_days", "days_early_or_late", "purchase_weekday"]


def payment_summary(mp: Marketplace, scope: Scope) -> DataFrame:
    """Per order: summed value, max instalments, main payment type by value.

    One pass over the payments: (order, type) partial sums, then per order
    the totals and the type with the largest value (ties: type name)."""
    by_type = child_rows(mp, "order_payments", scope).groupBy("order_id", "payment_type").agg(
        F.sum("payment_value").alias("v"), F.max("payment_installments").alias("mi"))
    return by_type.groupBy("order_id").agg(
        F.sum("v").alias("payment_value"),
        F.max("mi").alias("payment_installments"),
        F.min(F.struct((-F.col("v")).alias("nv"), F.col("payment_type"))).alias("m"),
    ).select("order_id", "payment_value", "payment_installments",
             F.col("m.payment_type").alias("payment_type"))


def review_summary(mp: Marketplace, scope: Scope) -> DataFrame:
    """Per order: mean review score over the order's reviews."""
    r = child_rows(mp, "order_reviews", scope)
    return r.groupBy("order_id").agg(
        F.try_divide(F.sum("review_score").cast("double"),
                     F.count("review_score").cast("double")).alias("review_score"))


def customer_features(mp: Marketplace, scope: Scope) -> DataFrame:
    """FEA-2: the 12-column feature table, one row per eligible customer."""
    co = cohort(mp, scope)
    top = order_top_category(mp, scope, first=co).select("customer_unique_id", "category")
    c = co.join(top, "customer_unique_id")
    c = (c.join(payment_summary(mp, scope), "order_id", "left")
         .join(review_summary(mp, scope), "order_id", "left"))
    return c.select(
        "customer_unique_id", "customer_state", "category",
        F.col("frequency").cast("bigint").alias("frequency"),
        (F.col("frequency") > 1).cast("int").alias("repeat_customer"),
        # double: NULL for unpaid first orders, and a numeric model feature
        F.col("payment_installments").cast("double").alias("payment_installments"),
        F.col("payment_value").cast("double").alias("payment_value"),
        "payment_type",
        F.col("review_score").cast("double").alias("review_score"),
        round_half(days_between("order_purchase_timestamp", "order_delivered_customer_date"), 1)
        .alias("delivery_days"),
        round_half(days_between("order_estimated_delivery_date", "order_delivered_customer_date"), 1)
        .alias("days_early_or_late"),
        weekday_sun0("order_purchase_timestamp").alias("purchase_weekday"),
    )


def features_imputed(mp: Marketplace, scope: Scope) -> DataFrame:
    """FEA-3: no_review flag, median-filled review score, rows without
    delivery timing dropped (median taken before the drop, as upstream)."""
    from repeatlens.operators.ranking import bounded_quantiles

    f = write_shared(customer_features(mp, scope), "features")  # read by the median and the fill
    # mean review scores of one order: a bounded set of values
    med = bounded_quantiles(f, "review_score", [0.5]).select(F.col("quantile").alias("_med"))
    out = with_scalars(f, med)
    return (out.withColumn("no_review", F.col("review_score").isNull().cast("int"))
            .withColumn("review_score", F.coalesce("review_score", "_med"))
            .drop("_med")
            .na.drop(subset=["delivery_days", "days_early_or_late"]))


def label_frame(mp: Marketplace, scope: Scope, value: bool = True) -> DataFrame:
    """Key, label and (if ``value``) payment value of ``features_imputed``'s rows.

    The same customers, without the joins, the median and the checkpoint that
    only the other feature columns need."""
    co = cohort(mp, scope, ["order_delivered_customer_date", "order_estimated_delivery_date"])
    co = co.na.drop(subset=["order_delivered_customer_date", "order_estimated_delivery_date"])
    f = co.join(order_top_category(mp, scope, first=co).select("customer_unique_id"),
                "customer_unique_id")
    cols = ["customer_unique_id", (F.col("frequency") > 1).cast("int").alias("repeat_customer")]
    if value:
        paid = child_rows(mp, "order_payments", scope).groupBy("order_id").agg(
            F.sum("payment_value").cast("double").alias("payment_value"))
        f, cols = f.join(paid, "order_id", "left"), [*cols, "payment_value"]
    return f.select(*cols)


def null_report(df: DataFrame) -> DataFrame:
    """Total NULL cells and NULLs per column (one aggregate pass)."""
    per = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    row = df.agg(*per)
    total = sum((F.col(c) for c in df.columns), F.lit(0))
    return row.select(total.cast("bigint").alias("total_nulls"), *df.columns)


def features_null_report(mp: Marketplace, scope: Scope) -> DataFrame:
    """AGG-21: NULL cells left in the imputed feature table (total and per column)."""
    return null_report(features_imputed(mp, scope))


def target_balance(mp: Marketplace, scope: Scope) -> DataFrame:
    """FEA-4: class counts and shares of the repeat target."""
    from pyspark.sql import Window

    f = label_frame(mp, scope, value=False)
    g = f.groupBy("repeat_customer").agg(F.count(F.lit(1)).alias("customers"))
    return g.select("repeat_customer", "customers",
                    F.try_divide(F.col("customers").cast("double"),
                                 F.sum("customers").over(Window.partitionBy()).cast("double"))
                    .alias("share"))


def one_hot_long(df: DataFrame, key: str, columns: list[str] = CATEGORICAL) -> DataFrame:
    """FEA-5 in sparse long form: (key, feature) for every dummy equal to 1.

    Dummies follow ``get_dummies(drop_first=True)``: the alphabetically
    first level of each column is the dropped baseline and NULL encodes as
    all zeros.  The per-column first levels are one single-row aggregate;
    the dummies of all columns come out of one ``explode`` pass.
    """
    firsts = df.agg(*[F.min(c).alias(f"_first_{c}") for c in columns])
    j = with_scalars(df.select(key, *columns), firsts)
    dummies = F.array(*[F.when(F.col(c) != F.col(f"_first_{c}"), F.concat(F.lit(c + "_"), F.col(c)))
                        for c in columns])
    return (j.select(key, F.explode(dummies).alias("feature"))
            .filter(F.col("feature").isNotNull()))


def features_one_hot(mp: Marketplace, scope: Scope) -> DataFrame:
    """FEA-5: dummies of the imputed feature table (sparse long form)."""
    return one_hot_long(features_imputed(mp, scope), "customer_unique_id")


def checked_levels(df: DataFrame, column: str, max_levels: int | None = None) -> list[str]:
    """Distinct non-NULL levels of a categorical column, sorted.

    With ``max_levels`` more levels raise, and no more than one too many is
    fetched: a guard for columns that may not be a vocabulary."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    got = [r[0] for r in (found if max_levels is None else found.limit(max_levels + 1)).collect()]
    if max_levels is not None and len(got) > max_levels:
        raise ValueError(f"{column}: more than {max_levels} levels; not a categorical vocabulary")
    return sorted(got)


def one_hot_wide(df: DataFrame, columns: list[str] = CATEGORICAL,
                 max_levels: int | None = None) -> DataFrame:
    """Wide 0/1 dummies for inspection (level names become columns).

    The level list per column reaches the driver (a vocabulary: states,
    categories, payment types); ``max_levels`` guards against others.
    """
    dummies = [F.coalesce(F.col(c) == lv, F.lit(False)).cast("int").alias(f"{c}_{lv}")
               for c in columns for lv in checked_levels(df, c, max_levels)[1:]]
    return df.select(*(c for c in df.columns if c not in columns), *dummies)
