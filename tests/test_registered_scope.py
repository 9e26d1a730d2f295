"""The registered queries read the driver tables' whole span."""

import pytest

from repeatlens.catalog import FULL_SPAN, JOBS, registered_scope
from repeatlens.oracle import build


@pytest.mark.parametrize("name", JOBS)
def test_every_query_covers_all_orders(name):
    s = registered_scope(name)
    assert s.window_start <= "1995-01-01 00:00:00" and s.window_end > "2001-08-01 00:00:00"
    assert name in FULL_SPAN or s.eligible_before == "2001-02-01 00:00:00"
    assert "2000-08-01" not in build().get(name, "")
