import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feloom.plans import exports, joiner
from feloom.operators.projections import SourceConfig
from feloom.sources import checkpoints, partitions, tables, writers
from feloom.streaming.microbatch import run_plan


def test_partition_finder(spark):
    parts = spark.createDataFrame([("2020-01", "a"), ("2020-01", "b"), ("2020-02", "a"), ("2020-03", "b"), ("2020-03", "a")], "dt string, t string")
    conf = {"t": ["a", "b"]}
    assert partitions.find_partitions(parts, conf) == [{"dt": "2020-03", "t": "a"}, {"dt": "2020-03", "t": "b"}]
    assert partitions.find_partitions(parts, conf, max_dt="2020-02")[0]["dt"] == "2020-01"
    assert [p["dt"] for p in partitions.find_partitions(parts, conf, max_dt="2020-02", match="any")] == ["2020-02"]
    assert len(partitions.find_partitions(parts, conf, mode="list")) == 4
    assert partitions.find_partitions(parts, {"t": "z"}) == []


def test_partition_filter_empty(spark):
    df = spark.createDataFrame([("d", 1), (None, 2)], "dt string, x int")
    assert df.where(partitions.partition_filter([])).count() == 1


def test_bucketed_write_and_union_read(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("dt"))
    path = f"{tmp_path}/t"
    writers.insert_bucketed(df, path, ["dt"], 100, fmt="orc")
    assert spark.read.orc(path).count() == 1000
    writers.insert_bucketed(df.where("dt = '0'").limit(10), path, ["dt"], 100, fmt="orc")
    back = tables.read_union(spark, path, T.StructType.fromDDL("id int, more double, dt string"), lambda v: v["dt"] in ("0", "1"))
    assert back.count() == 10 + 333 and back.where("more is null").count() == 343
    with pytest.raises(ValueError):
        tables.read_union(spark, path, df.schema, lambda v: False)
    with pytest.raises(Exception):
        writers.bucket_stats(spark.createDataFrame([(1, None)], "x int, dt string"), ["dt"], 5).collect()


def test_bucketed_write_of_maps(spark, tmp_path):
    df = spark.range(500).select(F.create_map(F.lit("a"), F.col("id")).alias("m"), "id", (F.col("id") % 2).cast("string").alias("dt"))
    writers.insert_bucketed(df, f"{tmp_path}/m", ["dt"], 50)
    back = spark.read.parquet(f"{tmp_path}/m")
    assert back.count() == 500 and back.where("m['a'] <> id").count() == 0 and len(back.inputFiles()) >= 10


def test_marks_and_moves(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a")
    partitions.set_mark(spark, f"{tmp_path}/a", "done")
    assert partitions.has_mark(spark, f"{tmp_path}/a", "done") and spark.read.parquet(f"{tmp_path}/a").count() == 3
    with pytest.raises(ValueError):
        partitions.set_mark(spark, f"{tmp_path}/a", "numFiles")
    spark.range(5).write.parquet(f"{tmp_path}/b")
    writers.swap_directory(spark, f"{tmp_path}/b", f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 5
    assert len(writers.move_files(spark, [(f"{tmp_path}/none", f"{tmp_path}/x/y")])) == 1


def test_ddl():
    schema = T.StructType.fromDDL("uid string, x double, dt string")
    assert writers.create_table_ddl("d.t", schema, ["dt"]) == "CREATE TABLE IF NOT EXISTS d.t (`uid` string, `x` double, `dt` string) USING ORC PARTITIONED BY (`dt`)"
    for bad in (("t", ["dt"]), ("d.t", ["uid", "x", "dt"])):
        with pytest.raises(ValueError):
            writers.create_table_ddl(bad[0], schema, bad[1])


def test_gates(spark, tmp_path):
    df = spark.range(5)
    assert checkpoints.stage_and_gate(df, f"{tmp_path}/s", 5).count() == 5
    with pytest.raises(ValueError):
        checkpoints.stage_and_gate(df, f"{tmp_path}/s2", 6)
    with pytest.raises(ValueError):
        checkpoints.check_unique(df.withColumn("k", F.lit(1)), ["k"])
    cut = checkpoints.IntervalCheckpoint(2, f"{tmp_path}/c")
    assert cut(df) is df and cut(df) is not df


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([("1", "VKID", {"92": 0.2, "93": 0.3}), ("2", "VKID", None), ("3", "VKID", {"x": 1.0})], "uid string, uid_type string, score map<string,float>")
    made = exports.export_features(df.withColumn("uid", F.concat(F.lit("vk:"), "uid")), {"feature_foo": "gmax(score)"}, users_from_types=False)
    assert made.columns == ["user", "num:feature_foo"]
    assert [tuple(r) for r in made.collect()] == [("vk:1", "92:0.2,93:0.3")]
    writers.write_csv(made, f"{tmp_path}/csv")
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/csv").collect())
    assert lines == ["user;num:feature_foo", "vk:1;92:0.2,93:0.3"]


def test_audience(spark):
    df = spark.createDataFrame([("1", "A", 0.2), ("1", "A", 0.4), ("x", "A", 0.9), ("3", "A", None)], "uid string, uid_type string, score double")
    top = exports.audience(df, 0.0, 1.0, exclude=spark.createDataFrame([("9",)], "uid string"), top=5)
    got = [tuple(r) for r in exports.audience_rows(top, 7, 1, 999, 0).select("id_number", "id_string", "score").collect()]
    assert sorted(got, key=str) == sorted([(1, None, 1), (None, "x", 999)], key=str)


def test_joiner_from_json(spark, tmp_path):
    text = '{"domains": [{"name": "d", "layout": "map", "sources": {"s": {"uid_column": "id", "uid_imitation_type": "A"}}}], "match_in": ["A"], "match_out": "B"}'
    config = joiner.config_from_json(text)
    source = spark.createDataFrame([(1, 2.0), (2, 4.0)], "id int, x double")
    cross = spark.createDataFrame([("1", "b", "A", "B"), ("2", "b", "A", "B")], "uid1 string, uid2 string, uid1_type string, uid2_type string")
    got = joiner.run(config, {"s": source}, f"{tmp_path}/stage", cross).collect()
    assert [(r.uid, r.uid_type, r.d) for r in got] == [("b", "B", {"x": 3.0})]
    with pytest.raises(ValueError):
        joiner.build(joiner.JoinerConfig([joiner.Domain("d", "prefix", {"s": SourceConfig(uid_column="id", uid_imitation_type="A")}, extra="x")]), {"s": source})


def test_microbatch(spark, tmp_path):
    spark.range(10).withColumn("dt", F.lit("d")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, dt string").parquet(f"{tmp_path}/in")
    run_plan(stream, lambda df: df.where("id > 4"), f"{tmp_path}/out", ["dt"], f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
