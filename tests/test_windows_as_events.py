"""Every hysteresis window gets a prediction record, not only the first of its type."""

from pathlib import Path

import pytest

from faultsift.plans.queries import QUERIES

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_each_window_has_a_record(spark):
    windows = QUERIES["hysteresis_windows"](spark, str(SF)).count()
    records = QUERIES["prediction_records"](spark, str(SF)).collect()
    assert windows > 5 and len(records) == windows
