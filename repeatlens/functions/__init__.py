from repeatlens.functions.columns import (  # noqa: F401
    ts_lit, month_label, year_month_sort, weekday_sun0, seconds_between,
    days_between, round_half, safe_ratio, pct, money, to_double, segment_of,
    total_revenue, customer_type, order_key_hash,
)
