"""How plans grow: rows are dealt before much is computed from each, no large side is broadcast, frames grow row by row."""

import pytest

from harrow.plans import registry


def plan(spark, tiny, name):
    return registry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["DM1_skills", "DM5_overall", "DM6_reconcile"])
def test_pairs_are_not_broadcast(spark, tiny, name):
    told = plan(spark, tiny, name)
    assert "BroadcastExchange" not in told and "Generate" not in told


@pytest.mark.parametrize("name", ["ST17_split_skills", "ST22_first_phone", "AR6_round_trip", "DM17_gold_cells"])
def test_small_files_are_dealt(spark, tiny, name):
    assert "REPARTITION_BY_NUM" in plan(spark, tiny, name)


@pytest.mark.parametrize("name", ["DM10_entries", "DM10_experience", "DM9_sections"])
def test_frames_grow_row_by_row(spark, tiny, name):
    told = plan(spark, tiny, name)
    assert "unboundedfollowing" not in told and "REPARTITION_BY_NUM" in told


def test_texts_are_taken_apart_once(spark, tiny):
    assert plan(spark, tiny, "JN14_phrases").count("documents.parquet") == 1
