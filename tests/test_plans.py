"""Physical plans: what must hold at any scale."""

from pathlib import Path

import pytest

from plumbline.plans import bindings as B
from plumbline.operators import grid

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not mounted")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_or_row_python_in_the_sources():
    for path in Path(__file__).parent.parent.glob("plumbline/**/*.py"):
        code = path.read_text()
        for banned in ("crossJoin", "localCheckpoint", "F.udf(", "toPandas()", ".rdd"):
            assert banned not in code, f"{banned} in {path.name}"


def test_error_scan_reads_only_needed_columns(spark):
    plan = _plan(B.errors(spark, FOLDER).select("region_id", "e_wind_mps"))
    line = next(p for p in plan.splitlines() if "lineitem.parquet" in p)
    assert "l_quantity" not in line and "l_extendedprice" not in line


def test_derivatives_take_two_shuffles_after_the_grid(spark):
    cells = B.grid(spark, FOLDER)
    before = _plan(cells).count("Exchange hashpartitioning")
    after = _plan(grid.gradient_and_vorticity(cells, "f", "u", "v", ["yr"])).count("Exchange hashpartitioning")
    assert after - before == 2
