"""The search of a period where the autocorrelation has no high peak."""

from __future__ import annotations

import duckdb
import pytest

from tidewatch.core.spec import SeriesSpec
from tidewatch.operators import transformers as T
from tidewatch.plans import catalog

SF = "/root/testdata/sf0.001"


def test_query_gives_no_rows_without_a_period(same_as_sql, tmp_path):
    """Prices so high that the weekly pattern added to them is lost."""
    duckdb.execute(
        f"""COPY (SELECT l_shipdate, CAST(l_extendedprice AS DOUBLE) * 6000 AS l_extendedprice, CAST(l_quantity AS DOUBLE) AS l_quantity
FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)"""
    )
    assert same_as_sql(catalog.QUERIES["seasonal_acf"], catalog.ORACLE["seasonal_acf"], str(tmp_path)) == 0


def test_fit_still_refuses(spark):
    df = catalog.daily(spark, SF).selectExpr("ts", "1.0D * (t % 2) * 0 + 3 AS value")
    with pytest.raises(T.NoPeriodError):
        T.ClassicSeasonalDecomposition().fit(df, SeriesSpec(values=("value",), freq="1d"))
