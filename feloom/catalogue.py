"""Queries over the test tables, one or more per operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import aggregates as agg
from .functions import hashes, scalar, vectors
from .functions.registry import expand, grouped
from .functions.validity import is_finite, is_inf
from .operators import compare, domains, joins, pipelines, projections, sampling, topn
from .session import load
from .sources import partitions, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# Events whose values are invalid in every way, and the same in SQL

_SPOILED = (
    "case when event_id % 7 = 0 then double('nan') when event_id % 11 = 0 then double('inf') "
    "when event_id % 13 = 0 then double('-inf') when event_id % 5 = 0 then null else value end"
)
_SPOILED_SQL = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN 'nan'::DOUBLE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE WHEN event_id % 13 = 0 THEN '-inf'::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").withColumn("x", F.expr(_SPOILED))


# Audience: average per user, range, subtraction, top rows, scaling


@query(
    """
WITH a AS (SELECT user_id, avg(value) AS score FROM events GROUP BY user_id HAVING avg(value) > 1 AND avg(value) <= 1000000),
     b AS (SELECT a.* FROM a WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)),
     t AS (SELECT * FROM b ORDER BY score DESC, user_id DESC LIMIT 50),
     m AS (SELECT min(score) AS lo, max(score) AS hi FROM t)
SELECT user_id, round(score, 4) AS score, round(1 + 998 * coalesce((score - lo) / nullif(hi - lo, 0), 1))::INTEGER AS scaled FROM t, m"""
)
def audience_topn(spark, sf):
    events = load(spark, sf, "events").where("value is not null")
    scores = events.groupBy("user_id").agg(F.avg("value").alias("score")).where("score > 1 and score <= 1000000")
    excluded = load(spark, sf, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("user_id"))
    top = topn.top_rows(joins.subtract_by(scores, excluded, ["user_id"]), 50, ["score", "user_id"])
    stats = joins.with_global_stats(top, lo=F.min("score"), hi=F.max("score"))
    return stats.select("user_id", F.round("score", 4).alias("score"), scalar.scale("score", "lo", "hi", 1, 999).alias("scaled"))


# Scalar aggregates


def _scalar_query(fn: str):
    @query(f"SELECT event_type, round({fn}(x) FILTER (WHERE isfinite(x)), 4) AS v FROM {_SPOILED_SQL} GROUP BY event_type")
    def run(spark, sf):
        return _events(spark, sf).groupBy("event_type").agg(F.round(agg.generic(fn, "x", "double"), 4).alias("v"))

    QUERIES[f"g{fn}_scalar"] = QUERIES.pop("run")
    ORACLES[f"g{fn}_scalar"] = ORACLES.pop("run")


for _fn in ("min", "max", "sum", "avg"):
    _scalar_query(_fn)


@query("SELECT o_orderpriority, trunc(avg(o_custkey))::BIGINT AS v, round(sum(o_totalprice::DECIMAL(12,2))::DOUBLE, 2) AS d FROM orders GROUP BY o_orderpriority")
def gavg_integer(spark, sf):
    """The result has the input's type: an integer average truncates, a decimal sum gains digits."""
    orders = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))
    return orders.groupBy("o_orderpriority").agg(agg.gavg("o_custkey", "bigint").alias("v"), F.round(agg.gsum("price", "decimal(12,2)").cast("double"), 2).alias("d"))


@query(f"SELECT event_type, round(avg(x) FILTER (WHERE NOT isnan(x) AND NOT isinf(x)), 4) AS v FROM {_SPOILED_SQL} WHERE coalesce(NOT isinf(x), true) GROUP BY event_type")
def gavg_hive(spark, sf):
    """The other rule for averages: NaN is ignored, infinities would count (left out here)."""
    rows = _events(spark, sf).where(~is_inf("x"))
    return rows.groupBy("event_type").agg(F.round(agg.gavg("x", nan_policy="hive"), 4).alias("v"))


# Array aggregates over embeddings, composable and relational


def _array_query(fn: str, relational: bool):
    name = f"g{fn}_array" + ("_relational" if relational else "")
    sql = f"""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings)
SELECT label, place, round({fn}(x), 4) + 0.0::DOUBLE AS v FROM e GROUP BY label, place"""

    @query(sql)
    def run(spark, sf):
        vectors_ = load(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
        if relational:
            made = agg.aggregate_elements(vectors_, ["label"], "embedding", fn, "all")
        else:
            made = vectors_.groupBy("label").agg(agg.generic(fn, "embedding", "array<double>").alias("all"))
        flat = made.select("label", F.posexplode("all").alias("place", "v"))
        return flat.select("label", F.col("place").cast("bigint").alias("place"), (F.round("v", 4) + F.lit(0.0)).alias("v"))

    QUERIES[name] = QUERIES.pop("run")
    ORACLES[name] = ORACLES.pop("run")


for _fn in ("avg", "sum", "max", "min"):
    _array_query(_fn, relational=False)
_array_query("avg", relational=True)


# Map aggregates: event type to value per user and day

_MAPS_SQL = f"(SELECT user_id, event_type AS k, max(x) AS x FROM (SELECT *, ts::DATE AS d FROM {_SPOILED_SQL}) GROUP BY user_id, d, event_type)"


def _maps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).withColumn("d", F.to_date("ts")).groupBy("user_id", "d", "event_type").agg(F.max("x").alias("x"))
    return rows.groupBy("user_id", "d").agg(agg.map_collect("event_type", "x").alias("m"))


def _map_query(fn: str, relational: bool):
    name = f"g{fn}_map" + ("_relational" if relational else "")

    @query(f"SELECT user_id, k, round({fn}(x) FILTER (WHERE isfinite(x)), 8) AS v FROM {_MAPS_SQL} GROUP BY user_id, k")
    def run(spark, sf):
        maps = _maps(spark, sf)
        if relational:
            made = agg.aggregate_elements(maps, ["user_id"], "m", fn, "all")
        else:
            made = maps.groupBy("user_id").agg(agg.generic(fn, "m", "map<string,double>").alias("all"))
        return made.select("user_id", F.explode("all").alias("k", "v")).select("user_id", "k", F.round("v", 8).alias("v"))

    QUERIES[name] = QUERIES.pop("run")
    ORACLES[name] = ORACLES.pop("run")


for _fn in ("avg", "sum", "min"):
    _map_query(_fn, relational=False)
_map_query("sum", relational=True)


# Most frequent value

_FREQ = "SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL"


@query(f"SELECT o_custkey, v FROM ({_FREQ}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v DESC) = 1")
def most_freq_default(spark, sf):
    return agg.most_freq(load(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", out="v")


@query(
    f"""
WITH f AS ({_FREQ}), s AS (SELECT *, n / sum(n) OVER (PARTITION BY o_custkey) AS share FROM f),
     r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v DESC) AS r FROM s WHERE share >= 0.3)
SELECT k.o_custkey, r.v FROM (SELECT DISTINCT o_custkey FROM orders) k LEFT JOIN r ON r.o_custkey = k.o_custkey AND r.r = 1"""
)
def most_freq_threshold(spark, sf):
    return agg.most_freq(load(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", threshold=0.3, out="v")


@query(
    f"""
WITH f AS ({_FREQ}), t AS (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS r FROM f),
     i AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC) - 1 AS nth, count(*) OVER (PARTITION BY o_custkey) AS ties FROM t WHERE r = 1),
     p AS (SELECT DISTINCT o_custkey, v FROM f WHERE v = '2-HIGH')
SELECT i.o_custkey, coalesce(p.v, i.v) AS v FROM i LEFT JOIN p ON p.o_custkey = i.o_custkey WHERE nth = 1 % ties"""
)
def most_freq_prefer(spark, sf):
    return agg.most_freq(load(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", index=1, prefer="2-HIGH", out="v")


# Vectors

_PAIRS_SQL = """
WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y, unnest(range(len(a.embedding))) AS place
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, place, round({f}, 4) + 0.0::DOUBLE AS v FROM p"""


def _vector_query(name: str, sql: str):
    @query(_PAIRS_SQL.format(f=sql))
    def run(spark, sf):
        e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
        made = e.join(nxt, "vec_id").select("vec_id", F.posexplode(getattr(vectors, name)("a", "b")).alias("place", "v"))
        return made.select("vec_id", F.col("place").cast("bigint").alias("place"), (F.round("v", 4) + F.lit(0.0)).alias("v"))

    QUERIES[name] = QUERIES.pop("run")
    ORACLES[name] = ORACLES.pop("run")


for _name, _sql in (("coomul", "x * y"), ("semisum", "(x + y) / 2"), ("semidiff", "(x - y) / 2")):
    _vector_query(_name, _sql)


@query(
    """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings),
     a AS (SELECT vec_id, pos // 8 AS i, pos % 8 AS k, x FROM e), b AS (SELECT vec_id, pos // 8 AS k, pos % 8 AS j, x FROM e)
SELECT a.vec_id, a.i * 8 + b.j AS place, round(sum(a.x * b.x), 3) + 0.0::DOUBLE AS v FROM a JOIN b ON a.vec_id = b.vec_id AND a.k = b.k GROUP BY a.vec_id, a.i, b.j"""
)
def matmul_mat(spark, sf):
    """Each vector as an 8 x 8 matrix, squared."""
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    made = e.select("vec_id", F.posexplode(vectors.matmul("a", "a")).alias("place", "v"))
    return made.select("vec_id", F.col("place").cast("bigint").alias("place"), (F.round("v", 3) + F.lit(0.0)).alias("v"))


@query(
    """
WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings)
SELECT a.vec_id, a.pos // 8 AS place, round(sum(a.x * b.x), 3) + 0.0::DOUBLE AS v FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.pos % 8 = b.pos AND b.pos < 8 GROUP BY a.vec_id, a.pos // 8"""
)
def matmul_vec(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    made = e.select("vec_id", F.posexplode(vectors.matmul(F.col("a"), F.slice("a", 1, 8))).alias("place", "v"))
    return made.select("vec_id", F.col("place").cast("bigint").alias("place"), (F.round("v", 3) + F.lit(0.0)).alias("v"))


# Scalar functions


@query(f"SELECT event_id, coalesce(isfinite(x), false) AS fin, coalesce(isinf(x), false) AS inf FROM {_SPOILED_SQL}")
def isfinite_flags(spark, sf):
    return _events(spark, sf).select("event_id", is_finite("x").alias("fin"), is_inf("x").alias("inf"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN false ELSE o_orderkey * 99991 <= 4294967295 END AS ok FROM orders")
def is_uint32(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise((F.col("o_orderkey") * 99991).cast("string"))
    return load(spark, sf, "orders").select("o_orderkey", scalar.is_uint32(text).alias("ok"))


_IDS = "case o_orderkey % 5 when 0 then 'UID' when 1 then 'T3ID' when 2 then 'GAID' when 3 then 'IDFA' else 'EMAIL' end"


@query(
    """
WITH i AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey::VARCHAR WHEN 1 THEN to_hex(o_orderkey) WHEN 4 THEN 'u' || o_orderkey || '@mail.example' ELSE md5(o_orderkey::VARCHAR) END AS id FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN id WHEN 1 THEN 't3:' || o_orderkey WHEN 4 THEN 'email:' || id
  ELSE CASE WHEN o_orderkey % 5 = 2 THEN 'gaid:' ELSE 'idfa:' END || regexp_replace(CASE WHEN o_orderkey % 5 = 2 THEN lower(id) ELSE upper(id) END, '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS u FROM i"""
)
def uid2user(spark, sf):
    key = F.col("o_orderkey")
    uid = F.expr("case o_orderkey % 5 when 0 then cast(o_orderkey as string) when 1 then hex(o_orderkey) when 4 then concat('u', o_orderkey, '@mail.example') else md5(cast(o_orderkey as string)) end")
    return load(spark, sf, "orders").select(key, scalar.uid2user(uid, F.expr(_IDS)).alias("u"))


@query(
    """
WITH m AS (SELECT c_custkey, md5(c_name) AS h FROM customer),
     n AS (SELECT c_custkey, ('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UHUGEINT::HUGEINT AS u FROM m)
SELECT c_custkey, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::VARCHAR AS id FROM n"""
)
def uid64(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", scalar.uid64("c_name").alias("id"))


@query()
def hash_uint32(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", hashes.hash_to_uint32("c_name").alias("h"))


@query()
def murmur3(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", hashes.murmurhash3_32_positive("c_name").alias("h"))


@query()
def html_unescape(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.md5(hashes.html_unescape("html")).alias("h"))


_USER_MAPS_SQL = "(SELECT user_id, event_type AS k, round(sum(value), 2) AS v FROM events GROUP BY user_id, event_type)"


def _user_maps(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    return rows.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("m"))


@query(f"SELECT user_id, string_agg(k || ':' || round(v)::BIGINT, ',' ORDER BY k) AS t FROM {_USER_MAPS_SQL} GROUP BY user_id")
def map_join(spark, sf):
    whole = F.transform_values("m", lambda k, v: F.round(v).cast("bigint"))
    return _user_maps(spark, sf).select("user_id", scalar.map_join(whole).alias("t"))


@query(f"SELECT user_id, max(v) FILTER (WHERE k = 'click') AS click, max(v) FILTER (WHERE k = 'nothing') AS nothing FROM {_USER_MAPS_SQL} GROUP BY user_id")
def map_values_ordered(spark, sf):
    picked = scalar.map_values_ordered("m", ["click", "nothing"])
    return _user_maps(spark, sf).select("user_id", picked[0].alias("click"), picked[1].alias("nothing"))


@query(f"SELECT user_id, k, v FROM {_USER_MAPS_SQL} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, k DESC) <= 2")
def map_topk(spark, sf):
    return _user_maps(spark, sf).select("user_id", F.explode(scalar.map_topk("m", 2)).alias("k", "v"))


@query("SELECT vec_id, unnest(range(5)) AS place, unnest(embedding[1:5])::DOUBLE AS v FROM embeddings")
def array_firstk(spark, sf):
    made = load(spark, sf, "embeddings").select("vec_id", F.posexplode(scalar.array_firstk("embedding", 5)).alias("place", "v"))
    return made.select("vec_id", F.col("place").cast("bigint").alias("place"), F.col("v").cast("double").alias("v"))


@query(
    f"""
WITH b AS (SELECT user_id, k, v FROM {_USER_MAPS_SQL}), a AS (SELECT DISTINCT user_id, 'click' AS k, -1.0 AS v FROM events UNION ALL SELECT DISTINCT user_id, 'extra', 1.0 FROM events)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.user_id = b.user_id AND a.k = b.k"""
)
def combine_maps(spark, sf):
    more = F.create_map(F.lit("click"), F.lit(-1.0), F.lit("extra"), F.lit(1.0))
    return _user_maps(spark, sf).select("user_id", F.explode(scalar.combine("m", more, kind="map")).alias("k", "v"))


@query(f"SELECT event_type, round(sum(x) FILTER (WHERE isfinite(x)), 4) AS total, count(*) FILTER (WHERE isfinite(x)) AS n FROM {_SPOILED_SQL} GROUP BY event_type")
def sql_macros(spark, sf):
    """Registered names inside SQL strings, also within lambdas."""
    events = _events(spark, sf)
    made = grouped(events, ["event_type"], {"total": "round(gsum(x), 4)", "n": "cast(sum(size(filter(array(x), v -> isfinite(v)))) as bigint)"})
    return made


# Joins


def _sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    orders = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    customers = load(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("uid"), "c_acctbal")
    events = load(spark, sf, "events").groupBy(F.col("user_id").alias("uid")).agg(F.count("*").alias("n"))
    return {"o": orders, "c": customers, "e": events}


_SOURCES_SQL = """
WITH o AS (SELECT o_custkey AS uid, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1),
     c AS (SELECT c_custkey AS uid, c_acctbal FROM customer WHERE c_custkey % 4 <> 0),
     e AS (SELECT user_id AS uid, count(*) AS n FROM events GROUP BY 1)
"""


@query(_SOURCES_SQL + "SELECT uid, spent, c_acctbal, n FROM (SELECT * FROM o FULL JOIN c USING (uid)) LEFT JOIN e USING (uid)")
def join_rule_full(spark, sf):
    return joins.join_by_rule(_sources(spark, sf), "o full_outer c left_outer e", ["uid"]).select("uid", "spent", "c_acctbal", "n")


@query(_SOURCES_SQL + "SELECT uid, spent, c_acctbal, n FROM o JOIN (SELECT * FROM c FULL JOIN e USING (uid)) USING (uid)")
def join_rule_nested(spark, sf):
    return joins.join_by_rule(_sources(spark, sf), "o inner (c full_outer e)", ["uid"]).select("uid", "spent", "c_acctbal", "n")


@query(_SOURCES_SQL + "SELECT uid, spent FROM o WHERE uid IN (SELECT uid FROM c) AND uid NOT IN (SELECT uid FROM e)")
def join_rule_semi(spark, sf):
    return joins.join_by_rule(_sources(spark, sf), "o left_semi c left_anti e", ["uid"])


_BRANDS_SQL = "SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"


def _brands(joined: DataFrame) -> DataFrame:
    return joined.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


def _brand_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), "l_quantity")
    return items, load(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand")


@query(_BRANDS_SQL)
def skewed_join(spark, sf):
    items, parts = _brand_sides(spark, sf)
    return _brands(joins.configured_join(items, parts, ["key"], "inner", "skewed", 8))


@query(_BRANDS_SQL)
def broadcast_join(spark, sf):
    items, parts = _brand_sides(spark, sf)
    return _brands(joins.configured_join(items, parts, ["key"], "inner", "broadcast"))


_LIST = [{"o_orderstatus": "F", "o_orderpriority": p, "o_shippriority": None} for p in ("1-URGENT", "5-LOW")]
_LISTED = [{k: v for k, v in r.items() if v} for r in _LIST]


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def join_filter_in(spark, sf):
    return joins.join_filter(load(spark, sf, "orders"), _LISTED).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW'))")
def join_filter_not_in(spark, sf):
    return joins.join_filter(load(spark, sf, "orders"), _LISTED, exclusion=True).select("o_orderkey")


def _matching(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = load(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("v"))
    rows = events.select(F.col("user_id").cast("string").alias("uid"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("uid_type"), "v")
    users = events.select(F.col("user_id").cast("string").alias("uid1"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("uid1_type"), "user_id")
    pairs = users.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    cross = pairs.select("uid1", "uid1_type", (F.col("user_id") + F.col("k") * 1000).cast("string").alias("uid2"), F.when(F.col("k") == 0, F.col("uid1_type")).otherwise(F.lit("B")).alias("uid2_type"))
    return rows, cross


_MATCH_SQL = """
WITH r AS (SELECT user_id::VARCHAR AS uid, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS uid_type, round(sum(value), 2) AS v FROM events GROUP BY user_id),
     x AS (SELECT uid AS uid1, uid_type AS uid1_type, uid AS uid2, uid_type AS uid2_type FROM r
           UNION ALL SELECT uid, uid_type, (uid::BIGINT + 1000)::VARCHAR, 'B' FROM r)
"""


@query(_MATCH_SQL + "SELECT x.uid2 AS uid, 'B' AS uid_type, v FROM r JOIN x ON r.uid = x.uid1 AND r.uid_type = x.uid1_type WHERE x.uid2_type = 'B' AND r.uid_type = 'A'")
def uid_matching(spark, sf):
    rows, cross = _matching(spark, sf)
    return joins.match_uids(rows, cross, ["A"], "B").select("uid", "uid_type", "v")


@query(
    _MATCH_SQL
    + """SELECT x.uid2 AS uid, 'B' AS uid_type, v FROM r JOIN x ON r.uid = x.uid1 AND r.uid_type = x.uid1_type WHERE x.uid2_type = 'B' AND NOT (x.uid1 = x.uid2 AND x.uid1_type = x.uid2_type)
UNION ALL SELECT uid, uid_type, v FROM r WHERE uid_type = 'B'"""
)
def uid_matching_self(spark, sf):
    rows, cross = _matching(spark, sf)
    return joins.match_uids(rows, cross, ["A", "B"], "B").select("uid", "uid_type", "v")


@query(_MATCH_SQL + "SELECT x.uid2 AS uid, 'B' AS uid_type, v FROM r JOIN x ON r.uid = x.uid1 AND r.uid_type = x.uid1_type WHERE x.uid2_type = 'B' AND r.uid_type = 'A' UNION ALL SELECT uid, uid_type, v FROM r WHERE uid_type = 'B'")
def uid_matching_split(spark, sf):
    rows, cross = _matching(spark, sf)
    return joins.match_uids_split(rows, cross, ["A"], "B").select("uid", "uid_type", "v")


@query("SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT o_custkey FROM orders)")
def intersection(spark, sf):
    users = load(spark, sf, "events").select("user_id").distinct()
    return joins.intersect_by(users, load(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")), ["user_id"])


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def subtraction(spark, sf):
    users = load(spark, sf, "events").select("user_id").distinct()
    return joins.subtract_by(users, load(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id")), ["user_id"])


@query("SELECT s_suppkey, n FROM supplier LEFT JOIN (SELECT DISTINCT n_nationkey, n_name AS n FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def dimension_join(spark, sf):
    rows = load(spark, sf, "supplier").withColumn("key", F.col("s_nationkey"))
    made = joins.dimension_join(rows, load(spark, sf, "nation"), ["key"], "n_regionkey < 3", ["n_nationkey as key", "n_name as n"], "left", "broadcast")
    return made.select("s_suppkey", "n")


@query("SELECT n_name AS uid, round(sum(s_acctbal), 2) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def link_matching(spark, sf):
    rows = load(spark, sf, "supplier").withColumn("uid", F.col("s_name"))
    linked = joins.match_link_ids(rows, load(spark, sf, "nation"), "s_nationkey + 0", "n_nationkey", "n_name")
    return linked.groupBy("uid").agg(F.round(F.sum("s_acctbal"), 2).alias("v"))


@query(_SOURCES_SQL + "SELECT uid, o.spent AS o_spent, c.spent AS c_spent FROM o JOIN (SELECT c_custkey AS uid, c_acctbal AS spent FROM customer) c USING (uid)")
def join_aliases(spark, sf):
    frames = {"o": _sources(spark, sf)["o"], "c": load(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_acctbal").alias("spent"))}
    return joins.join_with_aliases(frames, "o inner c", ["uid"])


# Domains


def _features(spark: SparkSession, sf: str) -> DataFrame:
    items = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("uid")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    return items.select("uid", F.col("n").cast("int").alias("n"), F.when(F.col("uid") % 3 != 0, F.col("q")).alias("q"), F.when(F.col("uid") % 2 == 0, F.array(F.col("q"), F.col("n").cast("double"))).alias("pair"))


_FEATURES_SQL = "(SELECT l_suppkey AS uid, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1)"


@query(
    f"""
WITH f AS (SELECT uid, [n::FLOAT, CASE WHEN uid % 3 <> 0 THEN q::FLOAT END] || CASE WHEN uid % 2 = 0 THEN [q::FLOAT, n::FLOAT] ELSE [NULL, NULL]::FLOAT[] END AS d FROM {_FEATURES_SQL})
SELECT uid, unnest(range(4)) AS place, unnest(d)::DOUBLE AS v FROM f"""
)
def domain_array(spark, sf):
    made = domains.array_domain(_features(spark, sf), "d", keys=("uid",))
    flat = made.select("uid", F.posexplode("d").alias("place", "v"))
    return flat.select("uid", F.col("place").cast("bigint").alias("place"), F.col("v").cast("double").alias("v"))


@query(f"SELECT uid, 'n' AS k, n::FLOAT::DOUBLE AS v FROM {_FEATURES_SQL} UNION ALL SELECT uid, 'q', q::FLOAT::DOUBLE FROM {_FEATURES_SQL} WHERE uid % 3 <> 0")
def domain_map(spark, sf):
    made = domains.map_domain(_features(spark, sf), "d", keys=("uid",))
    return made.select("uid", F.explode("d").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"SELECT uid, n::DOUBLE AS d_n, CASE WHEN uid % 3 <> 0 THEN q END AS d_q FROM {_FEATURES_SQL}")
def domain_prefix(spark, sf):
    return domains.prefix_domain(_features(spark, sf).drop("pair"), "d", "double", keys=("uid",))


@query("SELECT c_custkey::VARCHAR AS uid, 'CUST' AS uid_type, c_nationkey FROM customer UNION ALL SELECT c_name, 'NAME', c_nationkey FROM customer")
def uids_explode(spark, sf):
    rows = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return domains.explode_uids(rows, {"'CUST'": "c_custkey", "'NAME'": "c_name"}).select("uid", "uid_type", "c_nationkey")


@query(f"SELECT user_id, unnest([coalesce(max(v) FILTER (WHERE k = 'click'), 0), coalesce(max(v) FILTER (WHERE k = 'zzz'), 0)]) AS v, unnest(range(2)) AS place FROM {_USER_MAPS_SQL} GROUP BY user_id")
def dense_vectors(spark, sf):
    maps = _user_maps(spark, sf)
    merged = domains.merge_groups([[("m", ["zzz"])], [("m", ["click"])]])
    vector = domains.slice_vector(domains.dense_vector(merged, maps.schema), domains.group_indices([("m", ["click", "zzz"])], merged))
    return maps.select("user_id", F.posexplode(vector).alias("place", "v")).withColumn("place", F.col("place").cast("bigint"))


@query(f"SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(x) THEN x END AS y FROM {_SPOILED_SQL}")
def nan_inf_to_null(spark, sf):
    rows = _events(spark, sf).select("event_id", "x", F.array("x").alias("a"))
    return projections.replace_nan_inf(rows).select("event_id", "x", F.get("a", 0).alias("y"))


@query(f"SELECT event_id, x FROM {_SPOILED_SQL} WHERE isfinite(x)")
def valid_features(spark, sf):
    return projections.filter_features(_events(spark, sf).select("event_id", "x"), ["x"])


@query("SELECT c_custkey::VARCHAR AS uid, 'VKID' AS uid_type, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 0")
def prepare_source(spark, sf):
    cfg = projections.SourceConfig(where="c_mktsegment = 'BUILDING'", uid_column="c_custkey", uid_imitation_type="VKID", uid_types=["VKID"], features=["c_acctbal", "c_acctbal"])
    return projections.prepare_source(load(spark, sf, "customer"), cfg)


# Configured aggregation

_PIPELINE = {
    "x": {"domain": [{"type": "agg", "name": "avg", "parameters": {"null": "1.5"}}]},
    "y": {"domain": [{"type": "filter", "name": "drop_null"}, {"type": "agg", "name": "sum"}]},
    "z": {"domain": [{"type": "agg", "name": "max"}]},
    "w": {"domain": [{"type": "agg", "name": "most_freq", "parameters": {"rnd_value": "0"}}]},
}


@query(
    f"""
WITH f AS (SELECT event_type, floor(x) AS w, count(*) AS n FROM {_SPOILED_SQL} WHERE isfinite(x) GROUP BY ALL),
     t AS (SELECT event_type, w FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, w) = 1)
SELECT e.event_type, round(avg(CASE WHEN isfinite(x) THEN x ELSE 1.5 END), 2) AS x, round(sum(CASE WHEN isfinite(x) THEN x ELSE 0 END) / 1000, 1) AS y,
       round(max(x) FILTER (WHERE isfinite(x)), 2) AS z, max(t.w) AS w
FROM {_SPOILED_SQL} e JOIN t ON t.event_type = e.event_type GROUP BY e.event_type"""
)
def agg_pipeline_config(spark, sf):
    rows = _events(spark, sf).select("event_type", "x", F.col("x").alias("y"), F.col("x").alias("z"), F.floor(F.when(is_finite("x"), F.col("x"))).cast("double").alias("w"))
    made = pipelines.aggregate_columns(rows, _PIPELINE, ["event_type"])
    return made.select("event_type", F.round(F.col("x").cast("double"), 2).alias("x"), F.round(F.col("y").cast("double") / 1000, 1).alias("y"), F.round(F.col("z").cast("double"), 2).alias("z"), F.col("w").cast("double").alias("w"))


@query(f"SELECT user_id, k, sum(x) FILTER (WHERE isfinite(x))::FLOAT::DOUBLE AS v FROM {_MAPS_SQL} GROUP BY user_id, k HAVING count(*) FILTER (WHERE isfinite(x)) > 0")
def agg_pipeline_map(spark, sf):
    """Map features: keys without a value go."""
    stages = {"m": {"domain": [{"type": "agg", "name": "sum"}]}}
    made = pipelines.aggregate_columns(_maps(spark, sf).select("user_id", "m"), stages, ["user_id"])
    return made.select("user_id", F.explode("m").alias("k", "v")).select("user_id", "k", F.col("v").cast("double").alias("v"))


# Top rows, samples, partitions, writing


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def topn_exact(spark, sf):
    return topn.top_rows(load(spark, sf, "orders"), 100, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 100")
def topn_ranked(spark, sf):
    return topn.top_rows_ranked(load(spark, sf, "orders"), 100, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS rank FROM orders")
def global_rank(spark, sf):
    ranked = topn.global_rank(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return ranked.select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query()
def topn_approx(spark, sf):
    return topn.top_rows_approx(load(spark, sf, "orders"), 100, ["o_totalprice", "o_orderkey"], 10, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS upto FROM events")
def cumulative_sum(spark, sf):
    rows = load(spark, sf, "events")
    return rows.select("user_id", "event_id", F.round(topn.cumulative_sum("value", ["event_id"], ["user_id"]), 2).alias("upto"))


@query()
def stratified_sample(spark, sf):
    return sampling.stratified_sample(load(spark, sf, "events"), ["event_type"], 100, seed=7, key=["event_id"]).select("event_id", "event_type")


@query()
def sample_fast(spark, sf):
    return sampling.sample_fast(load(spark, sf, "events"), 50).select("event_id")


_MONTHS_SQL = "(SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS dt, o_orderstatus AS s FROM orders)"


@query(f"WITH g AS (SELECT dt FROM {_MONTHS_SQL} WHERE s IN ('F', 'O') AND dt <= '1997-01' GROUP BY dt HAVING count(*) = 2) SELECT dt, s FROM {_MONTHS_SQL} WHERE s IN ('F', 'O') AND dt = (SELECT max(dt) FROM g)")
def partition_finder(spark, sf):
    parts = load(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("dt"), F.col("o_orderstatus").alias("s"))
    found = partitions.find_partitions(parts, {"s": ["F", "O"]}, max_dt="1997-01")
    return spark.createDataFrame([(r["dt"], r["s"]) for r in found], "dt string, s string")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderstatus = 'P'")
def partition_filter(spark, sf):
    df = load(spark, sf, "orders").withColumnRenamed("o_orderdate", "dt")
    return partitions.select_partitions(df, ["o_orderkey"], [{"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, {"o_orderstatus": "P"}])


@query(
    """
WITH c AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS rows FROM orders GROUP BY ALL), b AS (SELECT *, ceil(rows / 500.0)::BIGINT AS buckets FROM c)
SELECT *, coalesce(sum(buckets) OVER (ORDER BY s, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_bucket FROM b"""
)
def bucketed_counts(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return writers.bucket_stats(rows, ["s", "p"], 500)


@query("SELECT o_orderkey, 'o_totalprice' AS diff FROM orders WHERE o_orderkey % 50 = 1 AND o_orderkey % 97 <> 5 UNION ALL SELECT o_orderkey, 'only_left' FROM orders WHERE o_orderkey % 97 = 5")
def dataset_diff(spark, sf):
    left = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    changed = F.when(F.col("o_orderkey") % 50 == 1, F.col("o_totalprice") + 1000).otherwise(F.col("o_totalprice") * (1 + 1e-9))
    right = left.where("o_orderkey % 97 <> 5").withColumn("o_totalprice", changed)
    return compare.dataset_diff(left, right, ["o_orderkey"])


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 7")
def macro_filter(spark, sf):
    """A filter string with a registered name in it reaches the scan as built-ins."""
    return load(spark, sf, "part").where(expand("isfinite(p_retailprice) and p_size = 7")).select("p_partkey", "p_name")


# Post-processing of scores, models and composed plans


@query(
    """
WITH q AS (SELECT event_type, quantile_cont(value, [0.0, 0.1, 0.3, 0.6, 1.0]) AS q FROM events GROUP BY event_type),
     c AS (SELECT event_id, value AS x, q, 1 + (q[2] <= value)::INT + (q[3] <= value)::INT + (q[4] <= value)::INT AS c FROM events JOIN q USING (event_type)),
     m AS (SELECT *, q[c] AS l, q[c + 1] AS r, CASE c WHEN 1 THEN q[1] WHEN 4 THEN q[5] ELSE (q[c] + q[c + 1]) / 2 END AS mid FROM c)
SELECT event_id, ['foo', 'bar', 'baz', 'qux'][c] AS label,
       round(CASE WHEN x <= mid THEN CASE WHEN c = 1 THEN 1 ELSE (x - l) / nullif(mid - l, 0) END ELSE CASE WHEN c = 4 THEN 1 ELSE (r - x) / nullif(r - mid, 0) END END, 5) AS rank
FROM m"""
)
def quantile_threshold(spark, sf):
    from .ml.estimators import ScoreQuantileThreshold

    estimator = ScoreQuantileThreshold(inputCol="value", groupCols=["event_type"], priorValues=[1.0, 2.0, 3.0, 4.0], labels=["foo", "bar", "baz", "qux"], outputCol="label", rankCol="rank", sampleSize=10**9)
    rows = load(spark, sf, "events").select("event_id", "event_type", "value")
    return estimator.fit(rows).transform(rows).select("event_id", "label", F.round("rank", 5).alias("rank"))


@query()
def score_equalize(spark, sf):
    from .ml.estimators import ScoreEqualizer

    rows = load(spark, sf, "events").select("event_id", "event_type", "value")
    model = ScoreEqualizer(inputCol="value", groupCols=["event_type"], outputCol="score", randomValue=0.5).fit(rows)
    return model.transform(rows).select("event_id", F.round("score", 6).alias("score"))


@query()
def prior_align(spark, sf):
    from .ml.estimators import NEPriorClassProba

    probabilities = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x).cast("double") + 1e-6)
    rows = load(spark, sf, "embeddings").select("vec_id", "label", probabilities.alias("p"))
    model = NEPriorClassProba(inputCol="p", groupCols=["label"], priorValues=[1.0, 2.0, 3.0], outputCol="aligned", sampleSize=10_000).fit(rows)
    return model.transform(rows).select("vec_id", F.posexplode("aligned").alias("place", "v"))


_AUDIENCE_MODEL = {"type": "audience_score", "audience": "a", "groups": [["embedding", list(range(8))]], "weights": [0.3, -0.2, 0.5, 0.1, 0.4, -0.1, 0.2, 0.3], "bias": -0.1, "idf": [1.0, 2.0, 0.5, 1.5], "link": "linear"}


@query(
    """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
     t AS (SELECT vec_id, x, list_transform(range(1, 5), lambda i: CASE WHEN x[4 + i] > 0.1 THEN (1 + ln(x[4 + i])) * (CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 0.5 ELSE 1.5 END) ELSE 0 END) AS tf FROM e),
     n AS (SELECT *, sqrt(list_sum(list_transform(tf, lambda v: v * v))) AS size FROM t)
SELECT vec_id, round(0.3 * x[1] - 0.2 * x[2] + 0.5 * x[3] + 0.1 * x[4]
  + CASE WHEN size = 0 THEN 0 ELSE (0.4 * tf[1] - 0.1 * tf[2] + 0.2 * tf[3] + 0.3 * tf[4]) / size END - 0.1, 5) + 0.0::DOUBLE AS score FROM n"""
)
def apply_models(spark, sf):
    from .ml.apply import apply_models as apply

    rows = load(spark, sf, "embeddings").select("vec_id", "embedding")
    scored = apply(rows, [_AUDIENCE_MODEL, {"type": "unknown"}], ["vec_id"])
    return scored.select("vec_id", (F.round("score", 5) + F.lit(0.0)).alias("score"))


@query(
    """
SELECT CASE WHEN user_id % 2 = 0 THEN 'vk:' ELSE 'ok:' END || user_id AS "user", string_agg(k || ':' || v, ',' ORDER BY k) AS "num:m"
FROM (SELECT user_id, CASE event_type WHEN 'click' THEN '1' ELSE '2' END AS k, round(sum(value))::BIGINT || '.0' AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL) GROUP BY user_id"""
)
def export_features(spark, sf):
    from .functions.scalar import uid2user as to_user
    from .plans import exports

    rows = load(spark, sf, "events").where("event_type in ('click', 'view')").withColumn("k", F.when(F.col("event_type") == "click", "1").otherwise("2"))
    # in the events' order, since rounding shows the order of sums at halves; as decimals, since doubles print 1.0E7
    sums = agg.ordered_sums(rows, ["user_id", "k"], "value", ["event_id"], "v").withColumn("v", F.round("v").cast("decimal(20,1)"))
    user = to_user(F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "VKID").otherwise("OKID"), {"VKID": ("dec", "vk:"), "OKID": ("dec", "ok:")})
    maps = sums.groupBy("user_id").agg(agg.map_collect("k", "v").alias("m")).withColumn("uid", user)
    return exports.export_features(maps, {"m": "gmax(m)"}, users_from_types=False)


@query(
    f"""
SELECT user_id, k, v FROM (SELECT user_id, CASE k WHEN 'click' THEN '11' WHEN 'view' THEN '12' END AS k, v::FLOAT::DOUBLE AS v FROM {_USER_MAPS_SQL})
WHERE k IS NOT NULL AND user_id IN (SELECT o_custkey FROM orders)"""
)
def combine_features(spark, sf):
    from .plans import exports

    ids = F.transform_keys("m", lambda k, v: F.when(k == "click", "11").when(k == "view", "12").otherwise(F.concat(F.lit("x"), k)))
    rows = _user_maps(spark, sf).withColumn("m", ids)
    users = load(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"))
    made = exports.combine_features(rows, ["user_id"], "f", "gavg(m)", users=users)
    return made.select("user_id", F.explode("score_map").alias("k", "v")).withColumn("v", F.col("v").cast("double"))


@query(
    _SOURCES_SQL
    + """SELECT uid::VARCHAR AS uid, 'CUST' AS uid_type, spent::FLOAT::DOUBLE AS spent, c_acctbal::FLOAT::DOUBLE AS balance, n AS e_n
FROM o FULL JOIN (SELECT c_custkey AS uid, c_acctbal FROM customer WHERE c_custkey > 0) c USING (uid) LEFT JOIN e USING (uid) WHERE uid > 0"""
)
def joiner_plan(spark, sf):
    """Three domains of different layouts from a configuration, joined by rule."""
    from .operators.projections import SourceConfig
    from .plans import joiner

    source = lambda column: SourceConfig(uid_column=column, uid_imitation_type="CUST", where=f"{column} > 0")
    tables = {
        "orders": load(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent")),
        "customer": load(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")),
        "events": load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")),
    }
    config = joiner.JoinerConfig(
        domains=[
            joiner.Domain("o", "map", {"orders": source("o_custkey")}),
            joiner.Domain("c", "array", {"customer": source("c_custkey")}),
            joiner.Domain("e", "prefix", {"events": source("user_id")}),
        ],
        rule="o full_outer c left_outer e",
    )
    made = joiner.build(config, tables)
    return made.select("uid", "uid_type", F.col("o")["spent"].cast("double").alias("spent"), F.get("c", 0).cast("double").alias("balance"), "e_n")


@query("SELECT user_id::VARCHAR AS uid, 'U' AS uid_type, audience, CASE audience WHEN 'x' THEN -1 ELSE 30 END AS lifetime FROM (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) > 40 AND avg(value) <= 60) CROSS JOIN (VALUES ('a'), ('b'), ('x')) t(audience)")
def audience_lifetimes(spark, sf):
    from .plans import exports

    rows = load(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.lit("U").alias("uid_type"), F.col("value").alias("score"))
    return exports.audience_lifetimes(exports.audience(rows, 40, 60), ["a", "b"], ["x"], 30)
