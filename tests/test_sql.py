"""Queries give the rows of their SQL: those of parsed answers always, all of them where ALL_SQL is set (ten minutes)."""

import os

import pytest

from against_sql import differences
from spanloom.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
ALWAYS = ["p_answered_labels", "p_resolved_sections", "t_hint_blocks", "t_numbered_answers"]


@pytest.mark.parametrize("name", sorted(ORACLE) if os.environ.get("ALL_SQL") else ALWAYS)
def test_rows_are_those_of_the_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SMALL) == []
