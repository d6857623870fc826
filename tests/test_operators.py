import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feloom.operators import compare, domains, joins, pipelines, projections, sampling, topn

NAN = float("nan")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_rule_parser():
    tree = joins.parse_rule("a inner b left_outer (c full_outer d)")
    assert joins.names_of(tree) == ["a", "b", "c", "d"]
    assert joins.evaluate(tree, lambda n: n, lambda l, r, how: f"({l} {how} {r})") == "((a inner b) left_outer (c full_outer d))"
    for bad in ("", "(a inner b", "a inner b)", "a inner", "a ( b"):
        with pytest.raises(ValueError):
            joins.parse_rule(bad)


def test_empty_rule_is_first(spark):
    df = spark.createDataFrame([(1,)], "uid int")
    assert joins.join_by_rule({"x": df}, "", ["uid"]) is df


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k int, w string")
    plain, salted = left.join(right, ["k"], how), joins.salted_join(left, right, ["k"], how, 4)
    assert rows(plain) == rows(salted)
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], "full_outer")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_broadcasts_nothing(spark, how):
    """The repeated side isn't broadcast, however small the planner thinks it is, also after adaptive execution has seen its size."""
    left, right = spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).select(F.col("id").alias("k"), F.lit("a").alias("w"))
    made = joins.salted_join(left, right, ["k"], how, 4)
    assert made.count() == (990 if how == "left_anti" else 1000 if how == "left" else 10)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_join_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "a"), (3, None)], "x int, y string")
    assert rows(joins.join_filter(df, [{"x": 1, "y": "a"}, {"x": None, "y": "a"}])) == [(None, "a"), (1, "a")]
    assert len(rows(joins.join_filter(df, [{"x": 1, "y": "a"}, {"x": 2, "y": None}], exclusion=True))) == 3
    assert joins.join_filter(df, []).count() == 0
    assert joins.join_filter(df, [], exclusion=True).count() == 4


def test_match_uids_same_type(spark):
    data = spark.createDataFrame([("1", "A", 10), ("2", "A", 20), ("9", "B", 90)], "uid string, uid_type string, v int")
    cross = spark.createDataFrame([("1", "9", "A", "B"), ("9", "9", "B", "B"), ("9", "8", "B", "B")], "uid1 string, uid2 string, uid1_type string, uid2_type string")
    assert rows(joins.match_uids(data, cross, ["A", "B"], "B")) == [("8", "B", 90), ("9", "B", 10), ("9", "B", 90)]
    assert rows(joins.match_uids(data, cross, ["A"], "B")) == [("9", "B", 10)]


def test_array_domain(spark):
    df = spark.createDataFrame([("u", True, "2", 3, None)], "uid string, a boolean, b string, c int, d float")
    assert domains.array_domain(df, "x", keys=("uid",)).first()["x"] == [1, 2, 3, None]
    df = spark.createDataFrame([("u", None, 1), ("v", [9, 8], 2)], "uid string, l array<int>, p int")
    got = dict(rows(domains.array_domain(df, "x", "int", keys=("uid",))))
    assert got == {"u": [1, None, None], "v": [2, 9, 8]}
    unknown = spark.createDataFrame([("u", None)], "uid string, l array<int>")
    with pytest.raises(ValueError):
        domains.array_domain(unknown, "x", keys=("uid",))
    assert domains.array_domain(unknown.limit(0), "x", keys=("uid",)).count() == 0
    uneven = spark.createDataFrame([("u", [1]), ("v", [1, 2])], "uid string, l array<int>")
    with pytest.raises(ValueError):
        domains.array_domain(uneven, "x", keys=("uid",), strict=True)
    assert dict(rows(domains.array_domain(uneven, "x", "int", keys=("uid",), pad=True)))["u"] == [1, None]


def test_map_domain(spark):
    df = spark.createDataFrame([("u", 1, {"p": 7.0, "q": None}), ("v", None, None)], "uid string, p int, m map<string,double>")
    got = dict(rows(domains.map_domain(df, "x", "double", keys=("uid",)), "uid"))
    assert got == {"u": {"p": 7.0}, "v": None}


def test_dense_vector(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": None}, [5.0])], "m map<string,double>, l array<double>")
    vector = df.select(domains.dense_vector([("m", ["a", "b", "c"]), ("l", [0, 1])], df.schema)).first()[0]
    assert vector[0] == 1 and vector[1] != vector[1] and vector[2] == 0 and vector[3] == 5 and vector[4] != vector[4]
    merged = domains.merge_groups([[("m", ["b"])], [("m", ["a"]), ("l", [1])]])
    assert merged == [("m", ["a", "b"]), ("l", ["1"])]
    assert domains.group_indices([("l", [1]), ("m", ["b"])], merged) == [2, 1]


def test_transform_feature(spark):
    df = spark.createDataFrame([(1, {"1": 0.5, "x": 1.0, "2": 2.0}, ["7", "foo"])], "id int, m map<string,double>, c array<string>")
    assert domains.transform_feature(df, "m", 1).first()["score_map"] == {"2": 2.0}
    assert domains.transform_feature(df, "c").count() == 0  # a row with a string that is no uint32 goes
    assert domains.transform_feature(df.select("id", F.array(F.lit("7")).alias("c")), "c").first()["cat_list"] == ["7"]
    assert domains.transform_feature(df, "c", hashing=True).first()["cat_list"][1] == "176538449"
    assert domains.transform_feature(df, "id").first()["score"] == 1.0
    rows = [(1, 1.0, [1.0, 2.0], {"1": 1.0}), (2, NAN, [], {"x": 1.0}), (3, float("inf"), [1.0, None], {"1": NAN}), (4, None, [1.0, NAN], {}), (5, -2.0, [3.0], {"1": NAN, "2": 4.0})]
    odd = spark.createDataFrame(rows, "id int, f double, l array<double>, m map<string,double>")
    kept = lambda c, out: [(r.id, r[out]) for r in domains.transform_feature(odd.select("id", c), c, 1).orderBy("id").collect()]
    assert kept("f", "score") == [(1, 1.0), (5, -2.0)]
    assert kept("l", "score_list") == [(1, [1.0]), (5, [3.0])]
    assert kept("m", "score_map") == [(1, {"1": 1.0}), (5, {"2": 4.0})]
    assert domains.transform_feature(odd.select("id", "m"), "m", 5, hashing=True).count() == 3


def test_global_rank_of_many_wide_rows(spark):
    """Adaptive execution merges and splits the ranges; ranks are whole all the same."""
    df = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("x"), "id", F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    ranked = topn.global_rank(df, ["x", "id"])
    window = Window.orderBy("rank")
    facts = ranked.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    assert tuple(facts) == (2_000_000, 2_000_000, 1, 2_000_000)
    step = ranked.where("rank % 1000 < 2").select("rank", "x", "id", F.lag("rank").over(window).alias("r"), F.lag("x").over(window).alias("px"), F.lag("id").over(window).alias("pid"))
    assert step.where("rank = r + 1 and not (px > x or px = x and pid > id)").count() == 0
    assert step.where("rank = r + 1").count() >= 1999
    assert topn.top_rows_ranked(df, 150_000, ["x", "id"]).select("id").exceptAll(df.orderBy(F.desc("x"), F.desc("id")).limit(150_000).select("id")).count() == 0


def test_joins_with_maps(spark):
    left = spark.createDataFrame([(i % 3, {"a": float(i)}, [{"b": i}]) for i in range(30)], "k int, m map<string,double>, l array<map<string,int>>")
    right = spark.createDataFrame([(0, "x"), (1, "y")], "k int, y string")
    assert joins.salted_join(left, right, ["k"], "left", 4).count() == 30
    assert domains.map_domain(spark.createDataFrame([("u", 1.0, {"x": 2.0, "b": 3.0})], "uid string, x double, m map<string,double>"), "d").first()["d"] == {"x": 2.0, "b": 3.0}


def test_stratified_sample_repeats(spark):
    df = spark.range(10_000).withColumn("g", F.col("id") % 2)
    one, two = (sampling.stratified_sample(d, ["g"], 300, 5, key=["id"]) for d in (df, df.repartition(7)))
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0 and 450 < one.count() < 750


def test_pipelines(spark):
    df = spark.createDataFrame([("u", 1.0, [1.0, NAN], {"a": 1.0}), ("u", None, [3.0], {"a": 2.0, "b": NAN})], "uid string, x double, l array<double>, m map<string,double>")
    got = pipelines.aggregate_columns(df, {}, ["uid"]).first()
    assert (got["x"], got["l"], got["m"]) == (1.0, [2.0, None], {"a": 1.5})
    zero = [{"type": "filter", "name": "drop_null"}, {"type": "agg", "name": "avg"}]
    got = pipelines.aggregate_columns(df, {"x": {"domain": zero}, "m": {"domain": zero, "a": [{"type": "agg", "name": "max"}]}}, ["uid"]).first()
    assert (got["x"], got["m"]) == (0.5, {"a": 2.0, "b": 0.0})
    freq = lambda i: {"x": {"domain": [{"type": "agg", "name": "most_freq", "parameters": {"rnd_value": str(i)}}]}}
    tied = spark.createDataFrame([("u", v) for v in (2.0, 1.0, 2.0, 1.0, 3.0)], "uid string, x double")
    assert [pipelines.aggregate_columns(tied, freq(i), ["uid"]).first()["x"] for i in range(3)] == [1.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        pipelines.aggregate_columns(df, {"l": {"domain": [{"type": "agg", "name": "none"}]}}, ["uid"])


def test_source_preparation(spark):
    df = spark.createDataFrame([("1", "OKID", 5), ("-1", "OKID", 6), ("x", "EMAIL", 7), (None, "EMAIL", 8)], "uid string, uid_type string, v int")
    assert [r[0] for r in rows(projections.drop_invalid_uid(df))] == ["1", "x"]
    assert projections.drop_repeated_columns(df.selectExpr("v", "v as V", "uid")).columns == ["v", "uid"]
    assert projections.select_csv(df, "concat(uid, ',') as a, v").columns == ["a", "v"]
    assert projections.order_columns(df.selectExpr("v", "uid_type", "'d' as dt", "uid")).columns == ["uid", "v", "dt", "uid_type"]
    assert projections.temp_column_name(["a", "bcd"]) == "uuuu"
    with pytest.raises(ValueError):
        projections.validate_feature_type(T.StructType())


def test_valid_features(spark):
    df = spark.createDataFrame([(1.0, {"1": 1.0}), (NAN, {"1": 1.0}), (1.0, {"x": 1.0}), (1.0, None)], "x double, m map<string,double>")
    assert projections.filter_features(df, ["x", "m"]).count() == 1


def test_ranks(spark):
    df = spark.range(500).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    ranked = topn.global_rank(df, ["v", "id"])
    expected = {i: n + 1 for n, (i, _) in enumerate(sorted(((r.id, r.v) for r in df.collect()), key=lambda r: (-r[1], -r[0])))}
    assert {r["id"]: r["rank"] for r in ranked.collect()} == expected
    assert topn.top_rows_approx(df, 40, ["v"], 4).count() == 40


def test_sampling(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 10 == 0).cast("string"))
    got = {r["g"]: r["count"] for r in sampling.stratified_sample(df, ["g"], 100, seed=1).groupBy("g").count().collect()}
    assert got["true"] == 100 and 60 < got["false"] < 140
    assert sampling.sample_fast(df, 7).count() == 7


def test_dataset_diff(spark):
    left = spark.createDataFrame([(1, 1.0, [1.0]), (2, 1.0, None), (3, NAN, [1.0])], "id int, x double, l array<double>")
    right = spark.createDataFrame([(1, 1.0 + 1e-9, [2.0]), (3, NAN, [1.0]), (4, 0.0, None)], "id int, x double, l array<double>")
    assert rows(compare.dataset_diff(left, right, ["id"])) == [(1, "l"), (2, "only_left"), (4, "only_right")]
    with pytest.raises(ValueError):
        compare.check_schemas(left, left.drop("x"))
