"""Tools by name in SQL."""

import numpy as np
import pytest

from terraspan.operators import tools
from terraspan.sources import encoders


def test_tools_in_sql(spark):
    assert tools.register(spark) == ["equivalent_looks", "luminance", "normalised_difference", "read_pixels", "validate_raster"]
    m = np.arange(24, dtype=np.uint8).reshape(3, 4, 2)
    df = spark.createDataFrame([("a", 1, encoders.png(m)), ("b", 2, b"junk"), ("c", 3, None)], "name string, n int, content binary")
    got = {r.name: r for r in spark.sql("SELECT * FROM validate_raster(TABLE({f}))", f=df).collect()}
    assert (got["a"].format, got["a"].width, got["a"].height, got["a"].samples, got["a"].n) == ("PNG", 4, 3, 2, 1)
    assert got["b"].format == "UNKNOWN" and got["c"].format == "EMPTY"
    rows = spark.sql("SELECT * FROM read_pixels(TABLE({f}))", f=df).collect()
    assert {(r.y, r.x, r.band): r.value for r in rows if r.problem is None} == {k: float(v) for k, v in np.ndenumerate(m)}
    assert {(r.name, r.problem) for r in rows if r.problem} == {("b", "UNSUPPORTED"), ("c", "EMPTY")}
    one = spark.sql("SELECT normalised_difference(3, 1) AS a, normalised_difference(0, 0) AS b, luminance(1, 1, 1) AS c, equivalent_looks(4, 2) AS d, equivalent_looks(4, 0) AS e").first()
    assert one.a == 0.5 and one.b is None and one.c == pytest.approx(1) and one.d == 4 and one.e == 1
    assert "PythonUDTF" not in spark.sql("SELECT luminance(id, id, id) FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="content"):
        spark.sql("SELECT * FROM read_pixels(TABLE({f}))", f=df.select("n")).collect()


def test_tools_for_a_task(spark):
    assert [r.name for r in tools.tools_for(spark, "SAR_ANALYSIS", "SAR").collect()] == ["equivalent_looks", "validate_raster"]
    assert tools.tools_for(spark).count() == 5 and tools.tools_for(spark, "NONE").count() == 0


def test_pixels_are_not_broadcast(spark):
    """The planner takes the pixels of files for as small as the files' keys."""
    from terraspan.plans import registry

    plan = registry.QUERIES["udf_tools_in_sql"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
