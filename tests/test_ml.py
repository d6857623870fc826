import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from feloom.ml import aligner, equalizer, kernels, models
from feloom.ml.apply import apply_models, parse_models
from feloom.ml.estimators import NEPriorClassProba, ScoreEqualizer, ScoreQuantileThreshold


def test_pchip_is_monotone_and_exact():
    x = np.array([0.0, 0.1, 0.4, 0.5, 1.0])
    y = np.array([0.0, 0.5, 0.5, 0.9, 1.0])
    c = kernels.bernstein(x, y)
    assert np.allclose(kernels.evaluate(x, x, c), y)
    z = kernels.evaluate(np.linspace(0, 1, 1000), x, c)
    assert (np.diff(z) >= -1e-12).all()


def test_stretch_is_monotone():
    x = np.linspace(-3, 4, 5001)
    y = equalizer.stretch(x, 1e-3)
    assert (np.diff(y) > 0).all() and 0 < y.min() and y.max() < 1


def test_equalizer_gives_uniform(spark):
    x = np.random.default_rng(1).gamma(2, 1, 5000)
    message, model = equalizer.fit(x, random_value=0.5)
    u = model(x)
    assert message == "" and abs(np.quantile(u, [0.1, 0.5, 0.9]) - [0.1, 0.5, 0.9]).max() < 0.01
    assert equalizer.fit(np.zeros(3))[0] and equalizer.fit(np.zeros(0))[1] is None
    df = spark.createDataFrame([("a", float(v)) for v in x[:500]] + [("b", None), ("c", float("nan"))], "g string, x double")
    got = ScoreEqualizer(inputCol="x", outputCol="y", groupCols=["g"], randomValue=0.5).fit(df).transform(df)
    assert got.where("g <> 'a' and y is not null").count() == 0 and got.where("g = 'a' and y between 0 and 1").count() == 500


def test_quantile_threshold_golden(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double")
    model = ScoreQuantileThreshold(inputCol="x", outputCol="label", rankCol="rank", priorValues=[1.0, 2.0, 3.0, 4.0], labels=["foo", "bar", "baz", "qux"]).fit(df)
    got = {r.x: (r.label, r["rank"]) for r in model.transform(df).collect()}
    assert [got[float(i)][0] for i in range(10)] == ["foo", "bar", "bar", "baz", "baz", "baz", "qux", "qux", "qux", "qux"]
    expected = [1.0, 0.111, 0.778, 0.222, 0.963, 0.296, 0.167, 0.444, 0.722, 1.0]
    assert np.allclose([got[float(i)][1] for i in range(10)], expected, atol=6e-4) and got[None] == (None, None)
    with pytest.raises(ValueError):
        ScoreQuantileThreshold(inputCol="x", priorValues=[1.0, 2.0]).fit(df)


def test_aligner(spark):
    p = np.random.default_rng(2).dirichlet([1, 1, 1], 600)
    message, factors = aligner.fit(p, [3.0, 7.0, 11.0])
    shares = np.bincount((p * factors).argmax(axis=1), minlength=3) / len(p)
    assert message == "" and np.allclose(shares, np.array([3, 7, 11]) / 21, atol=0.02)
    assert aligner.fit(p, [1.0, 0.0, 2.0])[1] is None
    df = spark.createDataFrame([(row.tolist(),) for row in p] + [([0.1, float("nan"), 0.2],), ([0.0, 0.0, 0.0],), ([0.5, 0.5],), (None,)], "p array<double>")
    got = NEPriorClassProba(inputCol="p", outputCol="q", priorValues=[3.0, 7.0, 11.0]).fit(df).transform(df)
    assert got.where("q is null").count() == 4
    assert np.allclose([sum(r.q) for r in got.where("q is not null").limit(20).collect()], 1)


def test_aligner_keeps_all_groups(spark, monkeypatch):
    monkeypatch.setattr("feloom.ml.estimators.MOST_GROUPS", 2)
    p = np.random.default_rng(3).dirichlet([1, 1], 100)
    df = spark.createDataFrame([(f"g{i % 5}", row.tolist()) for i, row in enumerate(p)], "g string, p array<double>")
    got = NEPriorClassProba(inputCol="p", outputCol="q", groupCols=["g"], priorValues=[1.0, 2.0]).fit(df).transform(df)
    assert got.count() == 100 and got.where("q is null").count() == 0


def test_steps():
    x = np.array([[np.nan, 2.0, 0.0], [1.0, 0.0, 0.0]])
    assert models.impute(x, np.array([9.0, 0, 0]))[0, 0] == 9
    t = models.tfidf(np.array([[1.0, 3.0, 5.0], [0.0, 0.0, 5.0]]), [[0, 1]], norm="l1")
    assert np.allclose(t, [[0.25, 0.75, 5], [0, 0, 5]])
    p = models.naive_bayes(np.eye(2), np.log([[0.9, 0.1], [0.2, 0.8]]), np.log([0.5, 0.5]))
    assert np.allclose(p, [[0.9 / 1.1, 0.2 / 1.1], [0.1 / 0.9, 0.8 / 0.9]])
    out = models.guarded(lambda z: np.ones((len(z), 2)), np.array([[1.0, 1.0], [0.0, 0.0]]), 1, 2)
    assert np.isnan(out[1]).all() and not np.isnan(out[0]).any()
    pmml = "<PMML><RegressionModel><RegressionTable intercept='0.5'><NumericPredictor name='a' coefficient='2'/></RegressionTable><RegressionTable intercept='0'/></RegressionModel></PMML>"
    w, b = models.pmml_regression(pmml)
    assert w.tolist() == [2.0] and b == 0.5


def test_apply_models(spark):
    bayes = {"type": "lookalike_bayes", "audience": "nb", "groups": [["m", ["a", "b"]]], "fill": [0, 0], "feature_log": np.log([[0.9, 0.1], [0.2, 0.8]]).tolist(), "class_log": np.log([0.5, 0.5]).tolist()}
    logit = {"type": "lookalike_logistic", "audience": "lr", "groups": [["m", ["b"]], ["l", [0]]], "fill": [0, 0], "tfidf_groups": [], "weights": [1.0, 1.0], "bias": 0.0}
    df = spark.createDataFrame([("u", {"a": 1.0}, [2.0]), ("v", {"b": 1.0}, None)], "uid string, m map<string,double>, l array<double>")
    got = {(r.uid, r.audience_name): r.score for r in apply_models(df, [bayes, json.dumps(logit), {"type": "zzz"}], ["uid"]).collect()}
    assert len(got) == 4 and np.isclose(got["u", "nb"], 0.2 / 1.1) and np.isclose(got["u", "lr"], 1 / (1 + np.exp(-2))) and np.isclose(got["v", "lr"], 1 / (1 + np.exp(-1)))
    assert parse_models("a->x; b->y") == {"a": "x", "b": "y"}
    assert models.make_model("not json").ok is False
