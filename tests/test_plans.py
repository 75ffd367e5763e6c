"""Physical plans: what must and must not be in them."""

import re
import tempfile

import pytest

from titleloom.operators import queue, routing, upsert
from titleloom.plans import inputs as I, stages
from titleloom.plans.queries import QUERIES
from titleloom.sources.tables import write_bucketed

SF = "/root/testdata/sf0.001"
STREAMS = {n for n in QUERIES if n.startswith("stream_")}
STAGES = {n for n in QUERIES if n.startswith("stage_")} | {  # store results while they are planned
    "parse_stage_unparsed", "link_tiers", "first_nonempty_tiers", "upsert_touched", "stored_page", "maintained_depths",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - STAGES - {"deep_page"}))
def test_no_nested_loops_windows_or_row_udfs(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "WindowExec", "Window ["):
        assert bad not in text, bad


def test_python_only_where_the_codec_needs_it(spark):
    python = {n for n in set(QUERIES) - STREAMS - STAGES if "InArrow" in plan(QUERIES[n](spark, SF))}
    codecs = {"decode_payloads", "document_items", "document_errors", "container_files", "bare_containers"}
    assert python == codecs


def test_deep_page_ranks_inside_range_partitions(spark, no_broadcast):
    """Windows: one over a row per partition, one inside the partitions that reach the page."""
    text = plan(QUERIES["deep_page"](spark, SF))
    assert len(re.findall(r"Window \[", text)) == 2 and "NestedLoopJoin" not in text
    assert re.search(r"Window \[row_number\(\).*\[_part#", text)


def test_stages_decode_once(spark):
    """Every output of a stage reads the stored results; no codec or parser is left in its plan."""
    step = stages.parse(I.items(spark, SF), I.parsed_items(spark, SF), I.AS_OF)
    assert all("regexp_" not in plan(df) for df in step.values())


def test_pending_filter_and_columns_reach_the_scan(spark, tmp_path):
    where = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/items"
    I.items(spark, SF).write.partitionBy("completed").parquet(where)
    ready = queue.pending(spark.read.parquet(where), I.AS_OF, 3, 20).select("item_hash")
    text = plan(ready)
    assert re.search(r"PartitionFilters: \[[^\]]*completed", text)
    assert "LessThan(attempts,3)" in text
    assert "filename" not in re.search(r"ReadSchema: .*", text).group(0)


def test_pending_batch_and_pages_are_top_k(spark):
    for name in ("pending_batch", "items_page", "outputs_page"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, SF))


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("link_provider_a", "link_cascade", "minute_counters", "upsert_items", "first_nonempty_source"):
        assert "partial_" in plan(QUERIES[name](spark, SF)), name


def test_bucketed_tables_join_and_upsert_without_moving_the_target(spark, no_broadcast):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    frames = {"items": I.items, "parsed_items": I.parsed_items, "mappings": I.mappings}
    try:
        for name, make in frames.items():
            write_bucketed(make(spark, SF), f"b_{name}", f"{root}/{name}", "item_hash", 4)
        t = {name: spark.table(f"b_{name}") for name in frames}
        singles = routing.singles(t["mappings"], t["items"], t["parsed_items"], I.AS_OF)
        assert "Exchange" not in plan(singles)
        assert "Exchange" not in plan(routing.packs(t["mappings"], t["items"], t["parsed_items"], I.AS_OF))
        I.parsed_items(spark, SF).where("attempts > 1").write.parquet(f"{root}/changes")
        changes = spark.read.parquet(f"{root}/changes")
        text = plan(upsert.upsert_parsed(t["parsed_items"], changes, I.AS_OF))
        # The changes only: once to reduce them, once to meet the buckets.
        assert len(re.findall(r"Exchange", text)) == 2
        target = text[: text.index("FileScan parquet spark_catalog")]
        assert "Exchange" not in target
        assert singles.count() > 0
    finally:
        for name in frames:
            spark.sql(f"DROP TABLE IF EXISTS b_{name}")


def test_name_parser_is_one_codegen_stage(spark):
    parsed = stages.parse_items(I.items(spark, SF))
    # A filter on the result must not copy the regexes below it.
    assert plan(parsed.where("parsed IS NULL")).count("regexp_") == plan(parsed).count("regexp_")
    text = plan(stages.parse_items(I.items(spark, SF)))
    assert text.count("Project") >= 4 and "Python" not in text
