"""What keeps tasks and the driver small when tables grow."""

import re

import pytest
from pyspark.sql import functions as F

from titleloom.operators import catalog
from titleloom.plans import inputs as I
from titleloom.plans.queries import QUERIES
from titleloom.session import cut_lineage
from titleloom.sources import documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_cut_into_pieces_are_never_broadcast(spark):
    """Pieces and affixes are hundreds of rows a name, of which the planner's sizes know nothing."""
    names = cut_lineage(catalog.reduce_catalog(I.catalog(spark, SF)))
    asked = cut_lineage(catalog.reduce_queries(I.catalog_queries(spark, SF)))
    for df in (catalog._tier(asked, names, catalog.TIERS[-1]), catalog.first_almost_similar(asked, names)):
        text = plan(df)
        assert "SortMergeJoin" in text and not re.search(r"BroadcastHashJoin|BroadcastExchange", text)


@pytest.mark.parametrize("name", ["link_provider_a", "link_provider_b", "link_text_years", "link_cascade", "link_fan_out", "link_with_memo", "link_tally"])
def test_tasks_with_candidates_follow_the_keys(spark, monkeypatch, name):
    """Candidates are sorted where they are derived, so a task holds a bounded number of keys, not of bytes."""
    monkeypatch.setattr(I, "KEYS_OF_TASK", 100)
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"hashpartitioning\(lookup_key#\d+, 15\), REPARTITION_BY_NUM", text)


def test_entry_fields_are_taken_once(spark):
    """Inside ``transform`` an expression runs as often as it is written."""
    df = documents.with_entries(spark.createDataFrame([("[]",)], "json string"))
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("$.filename") == 1 and text.count("$.hash") == 1
