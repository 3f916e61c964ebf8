"""Streaming scoring: restart from the checkpoint, no duplicates, equals batch."""

from farebox.operators.baseline import fit_baseline
from farebox.operators.score import parse_records, score, validate
from farebox.session import scratch_path
from farebox.streaming import scoring as st

TRAIN = [(1, "Union", "1", "monday", 6.0, 0, 0, 100.0), (2, "Bay", "2", "sunday", 9.0, 0, 1, 10.0)]


def test_restart_processes_only_new_files(spark, small_dir):
    from farebox.sources.requests import request_standin
    train = spark.createDataFrame(TRAIN, "obs_id long, station string, line string, day string, "
                                         "hour double, minute int, is_weekend int, riders double")
    model = fit_baseline(train)
    reqs = request_standin(spark, spark.read.parquet(f"{small_dir}/events.parquet"))
    first, second = reqs.filter("request_id % 2 = 0"), reqs.filter("request_id % 2 != 0")
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "out", "ckpt"))
    first.repartition(2).write.json(f"{landing}/a")
    q = st.start_scoring_stream(spark, f"{landing}/*", out, ckpt, model, "v1")
    q.awaitTermination()
    n_first = st.read_output(spark, out).count()
    second.repartition(2).write.json(f"{landing}/b")
    q = st.start_scoring_stream(spark, f"{landing}/*", out, ckpt, model, "v1")
    q.awaitTermination()
    got = st.read_output(spark, out)
    batch = score(validate(parse_records(reqs)).filter("reason is null"), model, "v1")
    cols = ["request_id", "pos", "riders"]
    assert 0 < n_first < got.count()
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    rejected = st.read_output(spark, out, "rejected")
    assert rejected.count() == validate(parse_records(reqs)).filter("reason is not null").count()
