"""Physical-plan properties the design relies on (final AQE plans)."""

import re

import pytest

from farebox.plans import QUERIES


def final_plan(spark, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_partial_before_shuffle(spark, small_dir):
    plan = final_plan(spark, "daily_event_listing", small_dir)
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_scoring_lookup_is_broadcast(spark, small_dir, tmp_path):
    """Requests that lie in files are scored without a shuffle of theirs."""
    from farebox.operators.score import parse_records, score, validate
    from farebox.plans.prepared import baseline, prepare
    from farebox.sources.requests import requests_for
    requests_for(spark, small_dir).write.parquet(str(tmp_path / "requests"))
    valid = validate(parse_records(spark.read.parquet(str(tmp_path / "requests")))).filter("reason is null")
    df = score(valid, baseline(prepare(spark, small_dir)), "v1")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not re.search(r"Exchange hashpartitioning\(request_id", plan)


def test_station_join_does_not_shuffle_on_station(spark, small_dir):
    plan = final_plan(spark, "station_predictions", small_dir)
    lines = plan.splitlines()
    # The only exchange on the station key is the distinct of matched keys,
    # fed by a map-side partial aggregate (at most 56 rows per mapper).
    for i, line in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(name#", line):
            assert "HashAggregate" in lines[i + 1]
    assert re.search(r"BroadcastHashJoin \[name#\d+, line#\d+\], \[name#\d+, line#\d+\], Inner", plan)


def test_fusion_lookups_broadcast(spark, small_dir):
    plan = final_plan(spark, "fused_observations", small_dir)
    assert len(re.findall(r"BroadcastHashJoin \[service_date", plan)) >= 2


@pytest.mark.parametrize("name, wanted", [
    ("options_long", {"event_id", "ts", "user_id"}), ("open_hours", {"event_id", "ts"}),
    ("service_hours_by_day", {"event_id", "ts"}), ("weather_readings", {"ts", "user_id", "value"}),
    ("line_summary", {"event_id", "ts", "user_id", "value"})])
def test_scans_of_the_source_are_pruned(spark, small_dir, name, wanted):
    """The scan of ``events`` itself reads no more than the query's columns."""
    plan = final_plan(spark, name, small_dir)
    schemas = [set(re.findall(r"(\w+)#", s)) for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)]
    assert schemas and set().union(*schemas) <= wanted | {"user_id"}


@pytest.mark.parametrize("name", ["clean_observations", "service_filtered", "service_mask_counts", "open_hours",
                                  "service_hours_by_day", "split_bucket", "line_summary", "options_listing"])
def test_single_pass_queries_store_no_copy(spark, small_dir, name, monkeypatch):
    from farebox import session
    from farebox.plans import prepared

    def fail(*_args, **_kwargs):
        raise AssertionError("stored a copy")
    monkeypatch.setattr(session, "materialize", fail)
    monkeypatch.setattr(prepared, "materialize", fail)
    QUERIES[name](spark, small_dir).collect()


def test_cleaning_is_compiled(spark, small_dir):
    """Methods above 8,000 bytes run interpreted: the cleaning's stay below."""
    df = QUERIES["clean_observations"](spark, small_dir)
    df.collect()
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))
