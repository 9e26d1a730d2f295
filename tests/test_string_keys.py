"""Real marketplace data has string ids: every job must run on them too."""

import os

import pytest
from pyspark.sql import functions as F

from repeatlens.catalog import JOBS
from repeatlens.plans import modeling
from repeatlens.report import MODEL_JOBS
from repeatlens.scope import driver_scope
from repeatlens.sources.driver_adapter import from_driver_tables
from repeatlens.sources.tables import Marketplace

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
IDS = {"order_id", "customer_id", "customer_unique_id", "product_id", "seller_id"}


def _stringify(mp: Marketplace) -> Marketplace:
    def conv(df):
        return df.select(*[(F.format_string("id-%09d", F.col(c)).alias(c) if c in IDS else F.col(c))
                           for c in df.columns])
    return Marketplace(**{n: conv(df) for n, df in mp.tables().items()})


@pytest.fixture(scope="module")
def both(spark):
    mp = from_driver_tables(spark, SF)
    return mp, _stringify(mp)


@pytest.mark.parametrize("name", [n for n in JOBS if n not in MODEL_JOBS])
def test_job_runs_on_string_ids(both, name):
    mp, smp = both
    s = driver_scope()
    assert JOBS[name](smp, s).count() == JOBS[name](mp, s).count()


def test_model_frame_on_string_ids(both):
    _, smp = both
    f = modeling.model_frame(smp, driver_scope(), modeling.ModelParams()).toPandas()
    assert set(f.fold) == {0, 1, 2, 3, 4}
