"""Exports of features and audiences, and features combined into one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import grouped
from ..functions.scalar import scale, uid2user
from ..operators import joins, topn
from ..operators.domains import transform_feature
from ..operators.projections import filter_features
from ..sources.checkpoints import check_rows
from ..sources.writers import export_frame


def combine_features(source: DataFrame, keys: list[str], feature: str, expression: str, *, where: str | None = None, users: DataFrame | None = None, links: tuple[DataFrame, str, str, str] | None = None, max_size: int = 1000, hashing: bool = False) -> DataFrame:
    """One feature per key, routed to one of the four columns of a universal feature row.

    ``links`` is (table, id expression, its column, its out column).
    """
    df = source.where(where) if where else source
    if links:
        table, expr, column, out = links
        df = joins.match_link_ids(df, table, expr, column, out, name=keys[0])
    df = grouped(df, keys, {feature: expression})
    if users is not None:
        df = joins.intersect_by(df, users, [k for k in keys if k in users.columns])
    made = transform_feature(df.where(F.col(feature).isNotNull()), feature, max_size, hashing)
    return made.select(*keys, "score", "score_list", "score_map", "cat_list").withColumn("feature_name", F.lit(feature))


def export_features(source: DataFrame, features: dict[str, str], *, max_size: int = 1000, users_from_types: bool = True, prefixes: bool = True, rows: tuple[int, int] | None = None) -> DataFrame:
    """``user`` and one string per feature: grouped by user, validated, filtered."""
    user = uid2user("uid", "uid_type") if users_from_types else F.col("uid").cast("string")
    df = source.withColumn("user", user).where("user is not null")
    df = filter_features(grouped(df, ["user"], features), list(features), max_size)
    if rows:
        check_rows(df, *rows)
    return export_frame(df, "user", list(features), prefixes)


def audience(source: DataFrame, low: float, high: float, *, include: DataFrame | None = None, exclude: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Average score per id within (low, high], with others' ids required or left out, the best ``top``."""
    df = source.where("score is not null").groupBy("uid", "uid_type").agg(F.avg("score").alias("score"))
    df = df.where((F.col("score") > low) & (F.col("score") <= high))
    if include is not None:
        df = joins.intersect_by(df, include, ["uid"])
    if exclude is not None:
        df = joins.subtract_by(df, exclude, ["uid"])
    return topn.top_rows(df, top, ["score", "uid"]) if top else df


def audience_rows(df: DataFrame, audience_id: int, low: int, high: int, ts: int, reverse: bool = False) -> DataFrame:
    """Rows of the binary export: ids as number or string, scores scaled over the audience."""
    stats = joins.with_global_stats(df, lo=F.min("score"), hi=F.max("score"))
    number = F.col("uid").try_cast("bigint")
    return stats.select(
        F.col("uid_type").alias("id_type"),
        number.alias("id_number"),
        F.when(number.isNull(), F.col("uid")).alias("id_string"),
        F.lit(audience_id).alias("audience_id"),
        scale("score", "lo", "hi", low, high, reverse).alias("score"),
        F.lit(ts).alias("ts"),
    )


def audience_lifetimes(df: DataFrame, audiences: list[str], excluded: list[str], lifetime: int) -> DataFrame:
    """One row per id and audience: its lifetime, or -1 for an excluded audience."""
    entries = [F.struct(F.lit(a).alias("audience"), F.lit(lifetime).alias("lifetime")) for a in audiences]
    entries += [F.struct(F.lit(a).alias("audience"), F.lit(-1).alias("lifetime")) for a in excluded]
    return df.select("uid", "uid_type", F.explode(F.array(*entries)).alias("e")).select("uid", "uid_type", "e.*")


def compare_exports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Users whose exported strings differ between two exports."""
    columns = [c for c in old.columns if c != "user"]
    pack = lambda df, n: df.select("user", F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`"), F.lit("\u0000")) for c in columns]).alias(n))
    return pack(old, "old").join(pack(new, "new"), "user", "full_outer").where("not (old <=> new)").select("user")
