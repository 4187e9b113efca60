"""Plan hygiene for every registered query: no nested-loop / cartesian
joins, and Python execution only where a user function is the feature."""

import pytest

from textlab.plans import catalog
from textlab.plans.plan_report import summarise

SF = "/root/testdata/sf0.001"
PYTHON_KEYS = {"answer_parse", "map_text_fallback", "scorer_predict"}  # user answer / mapping functions via mapInPandas


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_plan(spark, key):
    s = summarise(catalog.queries()[key](spark, SF))
    assert not any(j.startswith(("BroadcastNestedLoopJoin", "CartesianProduct")) for j in s["joins"]), s
    if key in PYTHON_KEYS:
        assert s["python"] == ["MapInPandas"], s
    else:
        assert not s["python"], s
