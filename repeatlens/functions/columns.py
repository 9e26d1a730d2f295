"""Scalar Column helpers (all JVM-side built-ins, no Python UDFs).

Rounding and ratios are written so that Spark and an ANSI SQL engine
produce bit-identical doubles: aggregate exactly (integers, decimals),
cast to double once, divide once, then round half away from zero with
``sign(x) * floor(|x| * 10^d + 0.5) / 10^d``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts_lit(value: str) -> Column:
    """TIMESTAMP_NTZ literal (constant-folded, so Parquet filters push down)."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def month_label(ts: Column | str) -> Column:
    """'YYYY-MM' month bucket of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def year_month_sort(ts: Column | str) -> Column:
    """Numeric chronological sort key YEAR*100 + MONTH."""
    c = _c(ts)
    return (F.year(c) * 100 + F.month(c)).cast("int")


def weekday_sun0(ts: Column | str) -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end`` (NULL if either is NULL)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end`` (Julian-day difference)."""
    return seconds_between(start, end).cast("double") / F.lit(86400.0)


def round_half(x: Column | str, digits: int) -> Column:
    """Round a double half away from zero, identically in every IEEE engine."""
    c = _c(x).cast("double")
    scale = float(10 ** digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num: Column | str, den: Column | str) -> Column:
    """100 * num / den as double; NULL when den is 0."""
    return F.try_divide(F.lit(100.0) * _c(num).cast("double"), _c(den).cast("double"))


def money(x: Column | str) -> Column:
    """Exact money type used for every sum."""
    return _c(x).cast("decimal(18,2)")


def to_double(x: Column | str) -> Column:
    return _c(x).cast("double")


def customer_type(frequency: Column | str) -> Column:
    """'One-time' for a single order in the window, else 'Repeat'."""
    # fixed values: customer type labels of the reference
    return F.when(_c(frequency) == 1, F.lit("One-time")).otherwise(F.lit("Repeat"))


def segment_of(r_score: Column | str, m_score: Column | str) -> Column:
    """Recency/monetary segment; rules are applied in this order."""
    r, m = _c(r_score), _c(m_score)
    # fixed values: segment names and thresholds of the reference
    return (
        F.when((r >= 4) & (m >= 4), F.lit("Champions"))
        .when((r >= 4) & (m <= 3), F.lit("Recent, Lower Spend"))
        .when((r <= 2) & (m >= 4), F.lit("High Value At Risk"))
        .when((r <= 2) & (m <= 2), F.lit("Lost / Low Value"))
        .otherwise(F.lit("Needs Attention"))
    )


def total_revenue(price: Column | str = "price") -> Column:
    """The dashboard 'Total Revenue' measure.

    Apply it to a fact that is already scoped (status + window); the scope
    then propagates to every breakdown because the filter lives on the fact
    rows, not on a separate dimension.
    """
    return F.sum(money(price))


# Portable integer hash used to shuffle keys deterministically for fold
# assignment: one Lehmer (MINSTD) step, identical in Spark and DuckDB for
# integral keys and free of bigint overflow.  String keys use xxhash64.
_LEHMER_MUL = 48271
_LEHMER_MOD = 2147483647


def order_key_hash(key: Column | str, seed: int = 42, integral: bool = True) -> Column:
    c = _c(key)
    if not integral:
        return F.xxhash64(c, F.lit(seed))
    base = F.pmod(c.cast("bigint"), F.lit(_LEHMER_MOD))
    return F.pmod(base * F.lit(_LEHMER_MUL) + F.lit(seed), F.lit(_LEHMER_MOD))


def with_scalars(df, one_row) -> "DataFrame":
    """Append the columns of a single-row frame to every row of ``df``.

    Expressed as one scalar subquery (``DataFrame.scalar()``) returning a
    struct: no join, no broadcast of anything data-sized; Spark evaluates
    the subquery once and reuses it.
    """
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.select("*", *[s.getField(c).alias(c) for c in one_row.columns])


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
