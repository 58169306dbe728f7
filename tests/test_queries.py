"""Every registered query against its SQL; those on monthly orders also where some months are missing."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from tidecast.plans.registry import ORACLE_SQL, QUERIES

SF, GAPS = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def views(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def duck():
    return {folder: views(folder) for folder in (SF, GAPS)}


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return f"{v:.5f}" if abs(v) < 1e9 else f"{v:.6e}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(shown, r)) for r in df.itertuples(index=False, name=None))


ON_ORDERS = (
    "forecast_table", "flagship", "metrics_point", "metrics_rank", "metrics_mase", "metrics_error", "combine_mean", "combine_inverse", "test_diebold", "test_directional",
    "diagnostic_rolling", "oos", "run_", "study", "evaluate", "interpret_dual", "vintage_actuals", "filter_hamilton_one",
)


@pytest.mark.parametrize("folder, name", [(SF, n) for n in sorted(ORACLE_SQL)] + [(GAPS, n) for n in sorted(ORACLE_SQL) if n.startswith(ON_ORDERS)])
def test_matches_sql(spark, duck, folder, name):
    got, want = QUERIES[name](spark, folder).toPandas(), duck[folder].sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    # A column may be all null, or whole numbers, on one side; compare what is shown.
    assert rows(got.astype(object)) == rows(want.astype(object)) or rows(got) == rows(want)


@pytest.mark.parametrize("name", ["combine_bates_granger", "test_model_confidence_set", "features_pca_expanding", "filter_hp", "search_grid", "impute_em_factor", "run_recursive"])
def test_kernels_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["analysis_cleaning_effects", "analysis_changed_cells", "analysis_distribution_shift"])
def test_cells_are_compared_within_one_computation(spark, duck, monkeypatch, name):
    """A panel that is computed twice may differ in the last bits, as the order of its sums is not fixed."""
    from pyspark.sql import functions as F

    from tidecast.plans import panel_queries, study_queries

    calls = []

    def slightly_off(panel):
        def made(s, d):
            calls.append(d)
            df = panel(s, d)
            return df.select(*[(F.col(c) * (1 + len(calls) * 1e-14)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        return made

    monkeypatch.setattr(study_queries, "order_panel", slightly_off(study_queries.order_panel))
    monkeypatch.setattr(panel_queries, "ship_panel", slightly_off(panel_queries.ship_panel))
    got, want = QUERIES[name](spark, SF).toPandas(), duck[SF].sql(ORACLE_SQL[name]).df()
    assert calls and rows(got.astype(object)) == rows(want.astype(object))


def test_changed_cells_of_odd_values(spark):
    from tidecast.operators import analysis

    nan, inf = math.nan, math.inf
    cells = [("a", 1, 1.0, 1.0), ("a", 2, nan, nan), ("a", 3, inf, inf), ("a", 4, None, 2.0), ("a", 5, 2.0, None), ("a", 6, None, None), ("a", 7, 1.0, nan), ("a", None, 1.0, 2.0), (None, 1, 1.0, 2.0)]
    df = spark.createDataFrame(cells, "series string, date int, raw double, clean double")
    got = {r["date"]: r["changed"] for r in analysis.cell_changes(df).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}
