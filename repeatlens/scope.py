"""Business scope shared by every job (status, time window, thresholds)."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Scope:
    """Parameters every analysis takes.

    ``window_start``/``window_end`` are half-open; ``eligible_before`` is the
    latest first-order time that still leaves a customer time to reorder;
    ``snapshot`` is the reference instant for recency.  Timestamps are ISO
    strings interpreted as TIMESTAMP_NTZ.
    """

    # fixed values: the reference's marketplace scope
    status: str = "delivered"
    window_start: str = "2017-01-01 00:00:00"
    window_end: str = "2018-09-01 00:00:00"
    eligible_before: str = "2018-03-01 00:00:00"
    snapshot: str = "2018-09-01 00:00:00"
    min_category_buyers: int = 200
    min_state_customers: int = 300
    top_categories: int = 15
    top_products_per_category: int = 3
    top_products_total: int = 30

    def with_(self, **kw) -> "Scope":
        return replace(self, **kw)


def driver_full_scope() -> Scope:
    """All months of the driver's synthetic tables."""
    return Scope(window_start="1990-01-01 00:00:00", window_end="2010-01-01 00:00:00",
                 eligible_before="2009-07-01 00:00:00", snapshot="2010-01-01 00:00:00")


def driver_cohort_scope() -> Scope:
    """All months, with six months to reorder before the last order."""
    whole = driver_full_scope()
    return driver_scope().with_(window_start=whole.window_start, window_end=whole.window_end)


def driver_scope(min_n: int = 10) -> Scope:
    """Scope that fits the driver's synthetic tables (see FIXTURES.md)."""
    return Scope(
        window_start="2000-08-01 00:00:00",
        window_end="2001-08-01 00:00:00",
        eligible_before="2001-02-01 00:00:00",
        snapshot="2001-08-01 00:00:00",
        min_category_buyers=min_n,
        min_state_customers=min_n,
    )
