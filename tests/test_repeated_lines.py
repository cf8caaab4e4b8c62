"""Queries whose rows repeat their lines read each different line once."""

import os

import pytest
from tamis.plans.queries import QUERIES

DATA = os.environ.get("TAMIS_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["nested_container", "pack_and_dual_range", "additive_terms", "conversion_discrepancy"])
def test_lines_are_read_once(spark, capsys, name):
    QUERIES[name](spark, DATA).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "_once" in plan and "Join" in plan and "Aggregate" in plan
