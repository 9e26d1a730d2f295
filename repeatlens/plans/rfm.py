"""QA-6..8 and SEG-1..3: RFM base, describe, one-time vs repeat, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.functions.columns import (pct, round_half, safe_ratio, segment_of,
                                          seconds_between, to_double, ts_lit)
from repeatlens.operators.ranking import qcut_values
from repeatlens.operators.selection import order_statistics
from repeatlens.plans.base import scoped_orders, with_person
from repeatlens.plans.kpis import customer_orders
from repeatlens.scope import Scope
from repeatlens.session import write_shared
from repeatlens.sources.tables import Marketplace


def rfm_base(mp: Marketplace, scope: Scope) -> DataFrame:
    """Recency (whole days to the snapshot, truncated), frequency, monetary."""
    co = customer_orders(mp, scope)
    secs = seconds_between("last_order_date", ts_lit(scope.snapshot))
    return co.select(
        "customer_unique_id",
        (secs.cast("double") / F.lit(86400.0)).cast("int").alias("recency_days"),
        F.col("frequency").cast("bigint").alias("frequency"),
        to_double("monetary").alias("monetary"),
    )


def one_time_vs_repeat(mp: Marketplace, scope: Scope) -> DataFrame:
    """QA-8: one-time vs repeat persons over the scope (orders, no item join)."""
    o = with_person(scoped_orders(mp, scope, cols=["order_id", "customer_id"]), mp)
    per = o.groupBy("customer_unique_id").agg(F.count_distinct("order_id").alias("frequency"))
    g = per.agg(F.count_if(F.col("frequency") == 1).alias("one_time_customers"),
                F.count_if(F.col("frequency") > 1).alias("repeat_customers"),
                F.count(F.lit(1)).alias("customers"))
    return g.select("one_time_customers", "repeat_customers", "customers",
                    round_half(pct("one_time_customers", "customers"), 1).alias("pct_one_time"))


DESCRIBE_PROBS = (0.25, 0.5, 0.75)


METRICS = ("recency_days", "frequency", "monetary")


def rfm_describe(mp: Marketplace, scope: Scope) -> DataFrame:
    """QA-7: pandas-style describe() of recency, frequency and monetary.

    Sums are exact (integers/decimals); the deviation is Spark's own, which
    does not cancel for large counts.  One pass gives these for all metrics;
    the quartiles come from one radix selection over all three.
    """
    base = write_shared(rfm_base(mp, scope), "rfm")
    cells = []
    for m in METRICS:
        x = F.col(m)
        exact = x.cast("decimal(18,2)") if m == "monetary" else x.cast("bigint")
        cells += [F.count(x).alias(f"{m}_n"), F.sum(exact).alias(f"{m}_sum"),
                  F.stddev_samp(x.cast("double")).alias(f"{m}_std"),
                  F.min(x).cast("double").alias(f"{m}_min"), F.max(x).cast("double").alias(f"{m}_max")]
    quartiles = order_statistics(base, dict.fromkeys(METRICS, list(DESCRIBE_PROBS)))
    rows = [F.struct(
        F.lit(m).alias("metric"), F.col(f"{m}_n").cast("bigint").alias("count"),
        safe_ratio(f"{m}_sum", f"{m}_n").alias("mean"),
        *(F.col(f"{m}_{c}").alias(c) for c in ("std", "min")),
        *(F.lit(quartiles[m][p]).cast("double").alias(f"p{int(p * 100)}") for p in DESCRIBE_PROBS),
        F.col(f"{m}_max").alias("max")) for m in METRICS]
    out = base.agg(*cells).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("metric", "count",
                      *[round_half(c, 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def rfm_scores(mp: Marketplace, scope: Scope) -> DataFrame:
    """SEG-1: r_score = qcut(recency, 5) labelled 5..1; m_score = qcut of the
    monetary rank (ties by person key) labelled 1..5."""
    return score(write_shared(rfm_base(mp, scope), "rfm"))


def score(base: DataFrame, q: int = 5) -> DataFrame:
    """The scores of a stored RFM base.

    Bin k of the ranks 1..n ends at rank floor(k (n - 1) / q) + 1, so the
    monetary score needs the persons at q - 1 ranks, not everyone's rank; they
    and the recency edges are selected together (``operators.selection``).
    A null monetary value ranks first.
    """
    key = "customer_unique_id"
    ranked = base.withColumn("_m", F.coalesce("monetary", F.lit(float("-inf"))))
    n = ranked.count()
    ends = [k * (n - 1) // q + 1 for k in range(1, q)] if n > 1 else []
    got = order_statistics(ranked, {"recency_days": [k / q for k in range(q + 1)], "_m": ends},
                           {"_m": key})
    edges = [F.lit(got["recency_days"][k / q]).cast("double") for k in range(q + 1)]
    m_score = F.raise_error(F.lit("qcut: bin edges must be unique (fewer than 2 values)")).cast("int")
    if n > 1:
        m_score = F.lit(q)
        for k in range(q - 1, 0, -1):
            value, tie = got["_m"][ends[k - 1]]
            upto = (F.col("_m") < value) | ((F.col("_m") == value) & (F.col(key) <= F.lit(tie)))
            m_score = F.when(upto, k).otherwise(m_score)
    return ranked.select(
        key, "recency_days", "frequency", "monetary",
        qcut_values("recency_days", edges, [5, 4, 3, 2, 1]).alias("r_score"),
        m_score.cast("int").alias("m_score"))


def rfm_segments(mp: Marketplace, scope: Scope) -> DataFrame:
    """SEG-2: one of five recency/monetary segments per person."""
    s = rfm_scores(mp, scope)
    return s.withColumn("segment", segment_of("r_score", "m_score"))


def rfm_segment_summary(mp: Marketplace, scope: Scope) -> DataFrame:
    """SEG-3: customers, mean and total monetary per segment, share of revenue."""
    return segment_summary(rfm_scores(mp, scope))


def segment_summary(scores: DataFrame) -> DataFrame:
    """The summary of scored persons."""
    seg = scores.withColumn("segment", segment_of("r_score", "m_score"))
    g = seg.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(F.col("monetary").cast("decimal(18,2)")).alias("total"))
    allw = Window.partitionBy()
    return g.select(
        "segment", F.col("customers").cast("bigint").alias("customers"),
        round_half(safe_ratio("total", "customers"), 2).alias("avg_monetary"),
        to_double("total").alias("total_monetary"),
        round_half(pct("total", F.sum("total").over(allw)), 1).alias("share_of_revenue_pct"),
    ).orderBy(F.desc("total_monetary"))
