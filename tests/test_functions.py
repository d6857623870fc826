import math

import pytest
from pyspark.sql import functions as F

from feloom.functions import aggregates as agg
from feloom.functions import hashes, registry, scalar, vectors
from feloom.functions.validity import is_finite, is_inf

NAN, INF = float("nan"), float("inf")


def one(df):
    return df.first()[0]


def test_hash_goldens():
    assert [hashes.string_hash(s) for s in ("0", "1", "-1", "2147483647", "-2147483648", "foo")] == [3222849387, 2622836501, 1771093052, 2460312044, 3194330916, 176538449]
    assert hashes.murmur3_32(b"SOCIAL") == 3625832686
    assert hashes.murmur3_32(b"DATING") == 1545499902


def test_hash_columns(spark):
    df = spark.createDataFrame([("foo",), (None,), ("foo",)], "s string")
    assert [r[0] for r in df.select(hashes.hash_to_uint32("s")).collect()] == ["176538449", None, "176538449"]
    assert one(spark.createDataFrame([("a &amp; b&#33;",)], "s string").select(hashes.html_unescape("s"))) == "a & b!"


def test_uid64(spark):
    df = spark.createDataFrame([("foo@bar.baz",), ("1@mrg",), (None,)], "s string")
    assert [r[0] for r in df.select(scalar.uid64("s")).collect()] == ["2627216423570133136", "-8194459535396332297", None]


@pytest.mark.parametrize("text,expected", [("0", True), ("4294967295", True), ("4294967296", False), ("-1", False), ("", False), ("12345678901", False), (None, None)])
def test_is_uint32(spark, text, expected):
    assert one(spark.createDataFrame([(text,)], "s string").select(scalar.is_uint32("s"))) is expected


@pytest.mark.parametrize(
    "uid,kind,expected",
    [
        ("12", "UID", "12"),
        ("x", "UID", None),
        ("ff", "T3ID", "t3:255"),
        ("0123456789ABCDEF0123456789abcdef", "GAID", "gaid:01234567-89ab-cdef-0123-456789abcdef"),
        ("0123456789ABCDEF0123456789abcdef", "IDFA", "idfa:01234567-89AB-CDEF-0123-456789ABCDEF"),
        ("0123", "IDFA", None),
        ("a@b.c", "EMAIL", "email:a@b.c"),
        ("a@b@c.d", "EMAIL", None),
        ("1", "NONE", None),
        (None, "UID", None),
    ],
)
def test_uid2user(spark, uid, kind, expected):
    assert one(spark.createDataFrame([(uid, kind)], "u string, t string").select(scalar.uid2user("u", "t"))) == expected


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0], [5.0, 6.0])], "a array<double>, b array<double>, m array<double>, n array<double>, v array<double>")
    got = df.select(vectors.coomul("a", "b"), vectors.semisum("a", "b"), vectors.semidiff("a", "b"), vectors.matmul("m", "n"), vectors.matmul("m", "v"), vectors.matmul("m", "a"), vectors.coomul("a", "v")).first()
    assert list(got) == [[4, 10, 18], [2.5, 3.5, 4.5], [-1.5, -1.5, -1.5], [19, 22, 43, 50], [17, 39], None, None]


def test_vector_invalid(spark):
    df = spark.createDataFrame([([1.0, NAN, None, INF], [1.0, 1.0, 1.0, 1.0], [])], "a array<double>, b array<double>, e array<double>")
    got = df.select(vectors.coomul("a", "b"), vectors.matmul("b", "a"), vectors.matmul("e", "e")).first()
    assert list(got) == [[1, None, None, None], [None, None, None, None], []]


def test_predicates(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    assert [tuple(r) for r in df.select(is_finite("x"), is_inf("x")).collect()] == [(True, False), (False, False), (False, True), (False, True), (False, False)]


SCALARS = {
    "B": ([None, INF, NAN, -INF, NAN, NAN], (None, None, None, None)),
    "D": ([None, 0.0, 0.0, -INF, INF, 4.0, 3.0, NAN], (7.0, 0.0, 4.0, 1.75)),
}


@pytest.mark.parametrize("part", SCALARS)
def test_scalar_aggregates(spark, part):
    values, expected = SCALARS[part]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert tuple(df.agg(agg.gsum("x"), agg.gmin("x"), agg.gmax("x"), agg.gavg("x")).first()) == expected


def test_integer_average_truncates(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert tuple(df.agg(agg.gavg("x", "int"), agg.gsum("x", "int")).first()) == (1, 3)


MAPS = {
    "E": ([None, None], None),
    "F": ([None, {}], {}),
    "G": ([{"1": None, "2": NAN}, {"1": 3.0, "2": NAN}, {"2": NAN}, {"1": 4.0, "2": INF}, {"2": None}], {"1": 7.0, "2": None}),
    "J": ([{}, {"1": 1.0}, {"2": 2.0}, {"3": 3.0}], {"1": 1.0, "2": 2.0, "3": 3.0}),
}


@pytest.mark.parametrize("part", MAPS)
@pytest.mark.parametrize("relational", [False, True])
def test_map_sum(spark, part, relational):
    values, expected = MAPS[part]
    df = spark.createDataFrame([("g", v) for v in values], "k string, m map<string,double>")
    if relational:
        got = agg.aggregate_elements(df, ["k"], "m", "sum").first()["m"]
    else:
        got = one(df.agg(agg.generic("sum", "m", "map<string,double>")))
    assert got == expected


ARRAYS = {"E": ([None, None], None), "F": ([None, []], []), "mixed": ([[1.0], [3.0, NAN, 2.0], None, [None, INF]], [2.0, None, 2.0])}


@pytest.mark.parametrize("part", ARRAYS)
@pytest.mark.parametrize("relational", [False, True])
def test_array_avg(spark, part, relational):
    values, expected = ARRAYS[part]
    df = spark.createDataFrame([("g", v) for v in values], "k string, m array<double>")
    if relational:
        got = agg.aggregate_elements(df, ["k"], "m", "avg").first()["m"]
    else:
        got = one(df.agg(agg.generic("avg", "m", "array<double>")))
    assert got == expected


@pytest.mark.parametrize(
    "values,options,expected",
    [
        ([0.0, 0.0, 1.0, NAN, None], {}, 0.0),
        ([0.0, 0.0, 1.0], {"prefer": "1.0"}, 1.0),
        ([0.0, 0.0, 1.0], {"threshold": 2 / 3.0001}, 0.0),
        ([0.0, 0.0, 1.0], {"threshold": 2.0001 / 3}, None),
        ([0.0, 1.0, 0.0, 1.0, 4.2, 42.0], {"index": 0}, 1.0),
        ([0.0, 1.0, 0.0, 1.0, 4.2, 42.0], {"index": 1}, 0.0),
        ([0.0, 1.0, 0.0, 1.0, 42.0], {"prefer": "42.0"}, 42.0),
        ([NAN, None, INF], {}, None),
    ],
)
def test_most_freq(spark, values, options, expected):
    df = spark.createDataFrame([("g", v) for v in values], "k string, x double")
    assert agg.most_freq(df, ["k"], "x", **options).first()["x"] == expected


def test_hive_average(spark):
    df = spark.createDataFrame([(NAN,), (NAN,)], "x double")
    assert math.isnan(one(df.agg(agg.gavg("x", nan_policy="hive"))))
    df = spark.createDataFrame([(NAN,), (INF,), (1.0,)], "x double")
    assert one(df.agg(agg.gavg("x", nan_policy="hive"))) == INF


def test_map_functions(spark):
    df = spark.createDataFrame([({"b": 1.0, "a": NAN, "c": 3.0},)], "m map<string,double>")
    assert one(df.select(scalar.map_values_ordered("m", ["a", "c", "z"]))) == [None, 3.0, None]
    assert "a:null" in one(df.select(scalar.map_join("m")))
    assert one(df.select(scalar.map_topk(F.map_filter("m", lambda k, v: ~F.isnan(v)), 1))) == {"c": 3.0}


def test_registry(spark):
    registry.register_all(spark)
    got = spark.sql("select isfinite(double('nan')), generic_isinf(double('inf')), coomul(array(1D, 2D), array(3D, 4D)), is_uint32('7'), hash_to_uint32('foo'), murmurhash3_32_positive('SOCIAL')").first()
    assert list(got) == [False, True, [3.0, 8.0], True, "176538449", "3625832686"]
    with pytest.raises(registry.UnknownFunction):
        registry.register_as(spark, "nothing")


def test_macros(spark):
    df = spark.createDataFrame([("a", 1.0, [1.0, 3.0], {"x": 2.0}), ("a", NAN, [3.0], {"y": 1.0})], "k string, x double, l array<double>, m map<string,double>")
    got = registry.grouped(df, ["k"], {"s": "gsum(x)", "l": "gavg(l)", "m": "gmax(m)", "n": "gsum(map_from_arrays(array('42'), array(x)))", "t": "concat('gsum(x)', '')" if False else "max('gsum(x)')"}).first()
    assert (got["s"], got["l"], got["m"], got["n"], got["t"]) == (1.0, [2.0, 3.0], {"x": 2.0, "y": 1.0}, {"42": 1.0}, "gsum(x)")


def test_scale(spark):
    df = spark.createDataFrame([(5.0, 0.0, 10.0), (3.0, 3.0, 3.0)], "s double, lo double, hi double")
    assert [r[0] for r in df.select(scalar.scale("s", "lo", "hi", 1, 999)).collect()] == [500, 999]


def test_string_helpers():
    assert scalar.slugify("Ünï code, text") == "uni-code-text"
    assert scalar.split_trim(" a, b ,,c") == ["a", "b", "c"]
    assert scalar.parse_map("a=1, b=2=3") == {"a": "1", "b": "2=3"}
    assert scalar.b64_decode(scalar.b64_encode("é")) == "é"
