"""Every registered query against DuckDB, and the driver entry points."""

import __spark_entry__ as entry_module
import pytest
from compare import check

from waveloom.plans import catalog

# queries whose windows are longer than the recordings of the smallest scale
MAY_BE_EMPTY = {"con04_band_wpli", "con06_envelope_correlation", "qc03_drop_bad_windows", "qc04_prepared_windows"}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    rows, _, _, diff = check(spark, con, name, sf_dir)
    assert rows > 0 or name in MAY_BE_EMPTY
    assert not diff or diff.startswith("~"), diff


def test_entry_points(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
