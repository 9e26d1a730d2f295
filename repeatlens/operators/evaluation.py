"""Distributed evaluation operators: folds, splits, weights, AUC, lift.

All of them are aggregates or range-partitioned scans; none orders the
whole table inside one task.  A label column splits the data into very
unequal classes (a few percent positive), so per-label windows would put
almost every row in one partition -- the ranked scan avoids that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from repeatlens.functions.columns import order_key_hash, with_scalars
from repeatlens.operators.ranking import ranked_scan
from repeatlens.operators.selection import selected_quantiles


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_class), as class_weight='balanced'."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    allw = Window.partitionBy()
    return g.select(label, F.col("n").cast("bigint").alias("n"),
                    (F.sum("n").over(allw).cast("double")
                     / (F.count(F.lit(1)).over(allw).cast("double") * F.col("n").cast("double")))
                    .alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(F.broadcast(w), label)  # one row per class: the rows stay where they are


def rank_within_label(df: DataFrame, label: str, key: str, seed: int = 42,
                      integral_key: bool | None = None) -> DataFrame:
    """Adds ``_rn_label``: 1-based position of the row inside its class after
    a seeded pseudo-random shuffle (hash of the key, ties by key) and
    ``_n_label``: the class size.  Integral keys use a portable integer
    hash, other keys ``xxhash64`` (detected from the schema by default)."""
    if integral_key is None:
        integral_key = isinstance(df.schema[key].dataType, IntegralType)
    h = df.withColumn("_h", order_key_hash(key, seed, integral=integral_key))
    numbered = ranked_scan(h, [label, "_h", key], out="_rn")
    sizes = numbered.groupBy(label).agg(F.count(F.lit(1)).alias("_n_label"))
    starts = sizes.select(label, "_n_label", F.coalesce(F.sum("_n_label").over(
        Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return (numbered.join(F.broadcast(starts), label)  # one row per class
            .withColumn("_rn_label", F.col("_rn") - F.col("_start"))
            .drop("_rn", "_start", "_h"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42,
                     integral_key: bool | None = None, out: str = "fold") -> DataFrame:
    """Deterministic stratified k-fold ids 0..k-1: every fold gets floor or
    ceil of each class's n/k rows."""
    r = rank_within_label(df, label, key, seed, integral_key)
    return r.withColumn(out, F.pmod(F.col("_rn_label") - 1, F.lit(k)).cast("int")) \
        .drop("_rn_label", "_n_label")


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.25,
                     seed: int = 42, integral_key: bool | None = None, out: str = "is_test") -> DataFrame:
    """Per class, the first ceil(n_class * test_fraction) shuffled rows are test."""
    r = rank_within_label(df, label, key, seed, integral_key)
    cut = F.ceil(F.col("_n_label").cast("double") * F.lit(float(test_fraction)))
    return r.withColumn(out, F.col("_rn_label") <= cut).drop("_rn_label", "_n_label")


def roc_auc(df: DataFrame, label: str, score: str, group: str | None = None) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney with mid-ranks for tied scores).

    Rows collapse to one per distinct score (positives, negatives); a
    weighted ranked scan gives the negatives below each score; AUC =
    sum(pos * (2 * neg_below + neg)) / (2 * P * N), summed exactly.  Rows
    without a score cannot be ranked; ``unscored`` says how many there are.
    Returns ``auc`` (plus ``group`` when given: one AUC per group, e.g. per
    fold or feature; groups without any scored row have none).
    """
    keys = [group] if group else []
    s = F.col(score).cast("double")
    scores = (df.groupBy(*keys, s.alias("_s"))
              .agg(F.count_if(F.col(label) == 1).alias("_pos"),
                   F.count_if(F.col(label) != 1).alias("_neg"), F.count(F.lit(1)).alias("_rows")))
    per = scores.filter(F.col("_s").isNotNull())
    without = scores.groupBy(*keys).agg(F.coalesce(F.sum(F.when(
        F.col("_s").isNull(), F.col("_rows"))), F.lit(0)).cast("bigint").alias("unscored"))
    cum = ranked_scan(per, [*keys, "_s"], out="_neg_incl", weight="_neg")
    if group:
        starts = per.groupBy(group).agg(F.sum("_neg").alias("_gn")).select(
            group, F.coalesce(F.sum("_gn").over(
                Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            .alias("_gstart"))
        cum = cum.join(starts, group).withColumn(
            "_neg_incl", F.col("_neg_incl") - F.col("_gstart"))
    contrib = F.col("_pos").cast("decimal(18,0)") * (
        F.col("_neg_incl") * 2 - F.col("_neg")).cast("decimal(19,0)")  # 2 * below + equal
    g = cum.groupBy(*keys).agg(F.sum(contrib).alias("_u"), F.sum("_pos").alias("P"),
                               F.sum("_neg").alias("N"))
    g = g.join(without, group) if group else with_scalars(g, without)
    pairs = F.col("P").cast("double") * F.col("N").cast("double") * 2.0
    return g.select(*keys, F.try_divide(F.col("_u").cast("double"), pairs).alias("auc"),
                    F.col("P").cast("bigint").alias("positives"),
                    F.col("N").cast("bigint").alias("negatives"), "unscored")


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts for every (label, prediction) cell of {0,1}^2, zero-filled."""
    cells = df.agg(*[F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"c{a}{b}")
                     for a in (0, 1) for b in (0, 1)])
    stack = "stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (label, prediction, n)"
    return cells.selectExpr(stack).select(F.col("label").cast("int"), F.col("prediction").cast("int"),
                                          F.col("n").cast("bigint"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class (from the confusion cells)."""
    y, p = F.col(label), F.col(prediction)
    aggs = []
    for cls in (0, 1):
        aggs += [F.count_if((y == cls) & (p == cls)).alias(f"tp{cls}"),
                 F.count_if(p == cls).alias(f"pp{cls}"), F.count_if(y == cls).alias(f"sp{cls}")]
    row = df.agg(*aggs)  # one pass over the scored rows
    r = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"pp{c}").alias("pp"),
                 F.col(f"sp{c}").alias("support")) for c in (0, 1)])).alias("r")).select("r.*")
    prec = F.try_divide(F.col("tp").cast("double"), F.col("pp").cast("double"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double"))
    return r.select(
        F.col("class").cast("int").alias("class"),
        F.coalesce(prec, F.lit(0.0)).alias("precision"),
        F.coalesce(rec, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
        F.col("support").cast("bigint").alias("support"))


def top_fraction_lift(df: DataFrame, label: str, score: str, quantile: float = 0.9,
                      tie: str | None = None) -> DataFrame:
    """Targeting lift: cutoff = linear-interpolated ``quantile`` of the
    scores, flagged = score >= cutoff; returns cutoff, flagged, hits,
    baseline rate, flagged rate and lift."""
    q = selected_quantiles(df, score, [quantile]).select(
        F.col("quantile").alias("cutoff"))
    j = with_scalars(df, q)
    flag = F.col(score).cast("double") >= F.col("cutoff")
    g = j.agg(F.first("cutoff").alias("cutoff"),
              F.count_if(flag).alias("flagged"),
              F.count_if(flag & (F.col(label) == 1)).alias("hits"),
              F.count(F.lit(1)).alias("n"),
              F.count_if(F.col(label) == 1).alias("positives"))
    base = F.try_divide(F.col("positives").cast("double"), F.col("n").cast("double"))
    rate = F.try_divide(F.col("hits").cast("double"), F.col("flagged").cast("double"))
    return g.select("cutoff", F.col("flagged").cast("bigint"), F.col("hits").cast("bigint"),
                    base.alias("baseline_rate"), rate.alias("flagged_rate"),
                    F.try_divide(rate, base).alias("lift"))


def prob_positive(col: str = "probability") -> Column:
    """P(label = 1) from an ML probability vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))[1]
