"""Histogram boosting against a plain row-by-row booster; layout; scoring by distinct vectors."""

import json
import pickle
import random

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from farebox.operators import boosting as B
from farebox.operators import model as ml

SCHEMA = "a int, b int, n int, label double, weight double"


def rows_of(n, seed):
    """Distinct code vectors with a label that depends on them, and whole weights."""
    rng = random.Random(seed)
    cells = rng.sample([(a, b, k) for a in range(6) for b in range(3) for k in range(9)], n)
    return [(a, b, k, 10.0 * (a == 2) - 4.0 * (b == 1) * (k > 4) + k + rng.randrange(16) / 4, float(rng.randint(1, 5))) for a, b, k in cells]


def plain_boost(rows, trees, depth, rate, l2, draws=lambda number: (lambda i: True)):
    """Each node tries every split on its own rows; ties go to the first feature, then the first cut."""
    codes, y, w = [r[:3] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
    base = sum(a * b for a, b in zip(y, w)) / sum(w)
    prediction = [base] * len(rows)

    def grow(own, level):
        g = sum(w[i] * (prediction[i] - y[i]) for i in own)
        h = sum(w[i] for i in own)
        best = (B.LEAST_GAIN, None, None)
        if level < depth:
            for f in range(3):
                for cut in (sorted({c[f] for c in codes}) if f < 2 else range(1, 9)):
                    right = [i for i in own if (codes[i][f] == cut if f < 2 else codes[i][f] >= cut)]
                    gr, hr = sum(w[i] * (prediction[i] - y[i]) for i in right), sum(w[i] for i in right)
                    if hr >= 1 and h - hr >= 1:
                        gain = gr * gr / (hr + l2) + (g - gr) ** 2 / (h - hr + l2) - g * g / (h + l2)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, f, cut)
        if best[1] is None:
            return lambda c, v=-rate * g / (h + l2): v
        _, f, cut = best
        goes = lambda c: c[f] == cut if f < 2 else c[f] >= cut
        left, right = grow([i for i in own if not goes(codes[i])], level + 1), grow([i for i in own if goes(codes[i])], level + 1)
        return lambda c: right(c) if goes(c) else left(c)

    for _ in range(trees):
        tree = grow(range(len(rows)), 0)
        prediction = [p + tree(c) for p, c in zip(prediction, codes)]
    return prediction


def booster(**other):
    return B.BoostedTrees(inputCols=["a", "b", "n"], categories=["a", "b"], **{
        "maxIter": 12, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "blocks": 3, **other}).setWeightCol("weight")


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_equals_a_plain_booster(spark, depth):
    rows = rows_of(110, depth)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[:3]: r["prediction"] for r in booster(maxDepth=depth).fit(df).transform(df).select("a", "b", "n", "prediction").collect()}
    want = plain_boost(rows, 12, depth, 0.3, 1.0)
    assert np.allclose([got[r[:3]] for r in rows], want, rtol=1e-9)


def test_joint_levels_and_partitions_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(140, 9), SCHEMA)
    found = []
    for cells, levels, blocks, parts in ((B.JOINT_CELLS, 3, 1, 2), (0, 3, 4, 5), (B.JOINT_CELLS, 2, 7, 1), (B.JOINT_CELLS, 3, 2, 3), (400, 3, 3, 1)):
        monkeypatch.setattr(B, "JOINT_CELLS", cells)
        monkeypatch.setattr(B, "JOINT_LEVELS", levels)
        fitted = booster(subsamplingRate=0.8, featureSubsetStrategy="0.7", blocks=blocks).fit(df.repartition(parts))
        found.append(fitted.getOrDefault(fitted.trees))
    assert len(set(found)) == 1


def test_driver_gets_trees_not_sums(spark, monkeypatch):
    """However many blocks and bins there are, a pass sends the driver one tree."""
    rows = [(i % 300, i % 7, i % 40, float(i % 11), 1.0) for i in range(4200)]
    df = spark.createDataFrame(rows, SCHEMA)
    sent, whole = [], RDD.collect

    def watched(self):
        found = whole(self)
        sent.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", watched)
    fitted = [booster(maxIter=2, maxDepth=5, blocks=n).fit(df) for n in (1, 2, B.FAN_IN * 2 + 3)]
    assert len({f.getOrDefault(f.trees) for f in fitted}) == 1
    assert len(sent) >= 12 and max(sent) < 10_000


def test_requests_are_parsed_once(spark, tmp_path, monkeypatch):
    """Scoring reads the requests twice, so it reads a stored copy of what was parsed and judged."""
    from farebox.plans import queries as Q
    spark.sql("""select id event_id, timestamp'2024-01-01 07:00:00' + make_interval(0, 0, 0, 0, cast(id % 200 as int)) ts, id % 90 user_id,
                 'view' event_type, cast(id % 50 as double) value, '{}' props from range(3000)""").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setitem(ml.GBT_PARAMS, "maxIter", 2)
    scored = Q.gbt_scored_requests(spark, str(tmp_path))
    plan = scored._jdf.queryExecution().toString()
    assert "parseJson" not in plan and "parse_json" not in plan
    valid = Q._validated_requests(spark, str(tmp_path)).where("reason is null")
    assert scored.select("request_id", "pos").exceptAll(valid.select("request_id", "pos")).isEmpty() and scored.count() == valid.count() > 0


def test_rows_and_columns_are_drawn_by_tree():
    plan = B.Plan([40, 5, 9], [True, True, False], columns=0.9, rows=0.9)
    drawn = [np.concatenate(plan.drawn(t)) for t in range(50)]
    assert {d.sum() for d in drawn} == {int(0.9 * 46)} and len({tuple(d) for d in drawn}) > 40
    codes = np.array([[i % 40 for i in range(1800)], [i // 40 % 5 for i in range(1800)], [i // 200 for i in range(1800)]], dtype=float)
    block = B.Block.of([(*c, 1.0, 1.0) for c in codes.T], 3, 0.0, 1.0)
    taken = [block.sums(B.Tree.empty(5), t, 0, 1, plan)[40:80].sum() for t in range(30)]
    assert all(abs(n / 1800 - 0.9) < 0.03 for n in taken) and len(set(taken)) > 5


def test_unseen_codes_and_single_bins(spark):
    rows = rows_of(100, 4)
    model = booster().fit(spark.createDataFrame(rows, SCHEMA))
    probe = spark.createDataFrame([(99, 99, 0), (99, 0, 50), (2, 99, -3)], "a int, b int, n int")
    assert all(np.isfinite(r["prediction"]) for r in model.transform(probe).collect())
    alone = spark.createDataFrame([(0, 0, 0, 5.0, 2.0), (0, 0, 0, 7.0, 2.0)], SCHEMA)
    assert booster(maxIter=3).fit(alone).transform(alone).first()["prediction"] == 6.0


def test_scoring_evaluates_each_vector_once(spark, monkeypatch):
    """However many rows are scored, the trees see distinct code vectors only; results are those of each row."""
    rows = rows_of(90, 5)
    model = booster().fit(spark.createDataFrame(rows, SCHEMA))
    seen = []
    whole = B.BoostedTreesModel.predictions

    def watched(self, vectors):
        seen.append(vectors.count())
        return whole(self, vectors)

    monkeypatch.setattr(B.BoostedTreesModel, "predictions", watched)
    many = spark.createDataFrame([(*r[:3], k) for r in rows for k in range(40)], "a int, b int, n int, prediction_id int")
    got = {tuple(r)[:4]: r["prediction"] for r in model.transform(many).collect()}
    assert seen == [90] and len(got) == 3600
    content = model.content()
    for r in rows:
        total = content["base"]
        for f, c, leaf in zip(content["feature"], content["cut"], content["leaf"]):
            place = B.Tree(np.array(f), np.array(c), np.array(leaf)).nodes(np.array(r[:3])[:, None], 4, np.array([True, True, False]))[0]
            total += leaf[place]
        assert abs(got[(*r[:3], 7)] - total) < 1e-9


def test_numbers_with_many_values_are_cut_at_quantiles(spark):
    df = spark.range(3000).select((F.col("id") / 7).alias("x_num"), F.lit(1.5).alias("y_num"))
    model = B.NumericBinner(inputCols=["x", "y"]).fit(df)
    cuts = model.cut_points()
    assert cuts["y"] == [] and 200 < len(cuts["x"]) < B.MAX_BINS
    out = model.transform(df)
    assert out.agg(F.max("x_bin"), F.max("y_bin")).first() == (float(len(cuts["x"])), 0.0)
    assert out.groupBy("x_bin").count().agg(F.max("count")).first()[0] < 60


def test_stages_survive_saving(spark, tmp_path):
    train = spark.createDataFrame([(f"S{i % 5}", str(i % 2), "monday", float(i % 20), 0, 0, float(i % 13)) for i in range(200)],
                                  "station string, line string, day string, hour double, minute int, is_weekend int, riders double")
    model = ml.fit_model(train, max_iter=3)
    model.write().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert json.loads(loaded.stages[-1].getOrDefault(loaded.stages[-1].trees)) == model.stages[-1].content()
    assert isinstance(ml.build_pipeline("gbt"), Pipeline)
