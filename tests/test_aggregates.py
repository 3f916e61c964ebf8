"""Mode with deterministic ties, typical line with fallback, options."""

from farebox.operators.aggregates import most_frequent
from farebox.operators.options import options_listing, options_long
from farebox.operators.profile import typical_line


def test_mode_ties_smallest_nulls_ignored(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "x string")
    assert [r["x"] for r in most_frequent(df, "x").collect()] == ["a"]
    nothing = most_frequent(spark.createDataFrame([(None,)], "x string"), "x").collect()
    assert [r["x"] for r in nothing] in ([], [None])


def test_mode_per_key(spark):
    df = spark.createDataFrame([(1, "z"), (1, "y"), (1, "z"), (2, "q"), (2, "p"), (3, None)],
                               "k int, v string")
    got = {r["k"]: r["v"] for r in most_frequent(df, "v", ["k"]).collect()}
    assert got == {1: "z", 2: "p"}


def test_typical_line_case_insensitive_with_fallback(spark):
    df = spark.createDataFrame(
        [("Finch", "1"), ("FINCH ", "1"), ("finch", "2"), ("Union", None), ("Kipling", "2"),
         ("Kipling", "2"), ("Bay", "2"), ("Bay", "1")], "station string, line string")
    got = {r["station_key"]: (r["line"], r["is_fallback"]) for r in typical_line(df).collect()}
    assert got["finch"] == ("1", False)
    assert got["union"] == ("2", True)     # no known line: most common overall ("2": 4 rows)
    assert got["bay"] == ("1", False)      # tie -> smallest


def test_options_sorted_distinct(spark):
    raw = spark.createDataFrame(
        [(" Monday", "Union ", "1"), ("monday", "Bay", " 2"), (None, None, None), ("SUNDAY ", "Bay", "1")],
        "day string, station string, line string")
    row = options_listing(spark, raw).first()
    assert row["hours"] == list(range(24))
    assert row["days"] == ["monday", "sunday"]
    assert row["stations"] == ["Bay", "Union"]
    assert row["lines"] == ["1", "2"]
    assert options_long(spark, raw).filter("kind = 'hour'").count() == 24


def test_events_for_one_day(spark, small_dir):
    from farebox.operators.context import event_listings, events_for_day
    from farebox.sources.dimensions import venues
    from farebox.sources.payloads import events_payload_standin
    landed = events_payload_standin(spark, spark.read.parquet(f"{small_dir}/events.parquet"))
    listings = event_listings(landed)
    day = listings.filter("event_date is not null").select("event_date").first()[0]
    out = events_for_day(listings, venues(spark), str(day), page_size=3).collect()
    assert 0 < len(out) <= 3 and all(str(r["event_date"]) == str(day) for r in out)
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1))


def test_typical_line_for_one_station(spark):
    from farebox.operators.profile import typical_line_for
    df = spark.createDataFrame([("Finch", "1"), ("finch ", "2"), ("Finch", "1"), ("Bay", "2"),
                                ("Bay", "2"), ("Bay", "2")], "station string, line string")
    assert typical_line_for(df, "FINCH") == "1"
    assert typical_line_for(df, "Nowhere") == "2"


def test_typical_line_fallback_counts_rows_without_station(spark):
    # Overall mode over all rows: "9" (3 rows, two of them without a station).
    df = spark.createDataFrame([(None, "9"), (None, "9"), ("A", "9"), ("A", "1"), ("A", "1"),
                                ("B", None)], "station string, line string")
    got = {r["station_key"]: r["line"] for r in typical_line(df).collect()}
    assert got == {"a": "1", "b": "9"}
