"""Joins: a rule language for chains, join strategies, list filters and id matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import row_hash

#: A side of a ``broadcast`` join is hinted only if the planner's size estimate is below this.
BROADCAST_BYTES = 64 << 20
#: Cells of a filter list that may be broadcast.
BROADCAST_CELLS = 250_000
SALTABLE = ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti")


@dataclass(frozen=True)
class Join:
    """A node of a parsed rule."""

    left: "Join | str"
    right: "Join | str"
    how: str


def parse_rule(rule: str) -> Join | str:
    """``operand (how operand)*`` with parentheses; all operators bind equally, to the left."""
    tokens = re.findall(r"\w+|[()]", rule)
    if re.sub(r"[\w()\s]", "", rule) or not tokens:
        raise ValueError(f"not a join rule: {rule!r}")
    at = 0

    def operand() -> Join | str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"the join rule ends early: {rule!r}")
        token, at = tokens[at], at + 1
        if token == "(":
            inner = expression()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"unbalanced parentheses: {rule!r}")
            at += 1
            return inner
        if token == ")":
            raise ValueError(f"unbalanced parentheses: {rule!r}")
        return token

    def expression() -> Join | str:
        nonlocal at
        node = operand()
        while at < len(tokens) and tokens[at] != ")":
            how, at = tokens[at], at + 1
            if how == "(":
                raise ValueError(f"a join type is missing: {rule!r}")
            node = Join(node, operand(), how)
        return node

    tree = expression()
    if at != len(tokens):
        raise ValueError(f"unbalanced parentheses: {rule!r}")
    return tree


def names_of(tree: Join | str) -> list[str]:
    return [tree] if isinstance(tree, str) else names_of(tree.left) + names_of(tree.right)


def evaluate(tree: Join | str, item: Callable[[str], object], combine: Callable[[object, object, str], object]) -> object:
    """Fold a rule from its leaves."""
    if isinstance(tree, str):
        return item(tree)
    return combine(evaluate(tree.left, item, combine), evaluate(tree.right, item, combine), tree.how)


def join_by_rule(frames: dict[str, DataFrame], rule: str, keys: list[str], checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Equi-joins on ``keys`` as the rule says; an empty rule gives the first frame.

    ``checkpoint`` gets each join's result, for long chains (see sources.checkpoints).
    """
    if not rule.strip():
        return next(iter(frames.values()))
    cut = checkpoint or (lambda df: df)
    return evaluate(parse_rule(rule), frames.__getitem__, lambda left, right, how: cut(left.join(right, on=keys, how=how)))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a check of size; beyond it the planner and AQE decide."""
    return F.broadcast(df) if estimated_bytes(df) <= most_bytes else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", parts: int = 16) -> DataFrame:
    """An equi-join whose hot keys are spread over ``parts`` tasks: the right side is repeated once per salt.

    Always a sort-merge join: the planner's estimate leaves out the repetition, so it would broadcast
    ``parts`` times more rows than its threshold is meant for, all of them through the driver.
    """
    if how not in SALTABLE:
        raise ValueError(f"a salted join can't be {how}")
    salt = F.pmod(F.xxhash64(row_hash(left, [c for c in left.columns if c not in on]), F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    salted = left.withColumn("_salt", salt)
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def configured_join(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "inner", kind: str = "regular", salt_parts: int = 16) -> DataFrame:
    """``regular``, ``broadcast`` (behind a size check) or ``skewed``."""
    if kind == "regular":
        return left.join(right, on, how)
    if kind == "broadcast":
        return left.join(broadcast_if_small(right), on, how)
    if kind == "skewed":
        return salted_join(left, right, on, how, salt_parts)
    raise ValueError(f"unknown join type {kind!r}")


def join_filter(df: DataFrame, rows: list[dict], exclusion: bool = False, most_cells: int = BROADCAST_CELLS) -> DataFrame:
    """Rows of ``df`` whose values are, or are not, in a list; NULL equals NULL, values compare as strings.

    An empty list keeps nothing (or everything, if it excludes). Columns with one
    value in the whole list become a filter, so it can be pushed to the scan.
    """
    if not rows:
        return df if exclusion else df.where(F.lit(False))
    columns = sorted({c for r in rows for c in r})
    distinct = sorted({tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows}, key=str)
    same = lambda c, v: F.col(c).cast("string").eqNullSafe(F.lit(v))
    constant = [i for i in range(len(columns)) if len({r[i] for r in distinct}) == 1]
    varying = [i for i in range(len(columns)) if i not in constant]
    fixed = reduce(lambda a, b: a & b, [same(columns[i], distinct[0][i]) for i in constant], F.lit(True))
    if not varying:
        return df.where(~fixed if exclusion else fixed)
    names = [f"_f_{i}" for i in varying]
    listed = df.sparkSession.createDataFrame([tuple(r[i] for i in varying) for r in distinct], ", ".join(f"{n} string" for n in names))
    if len(distinct) * len(varying) <= most_cells:
        listed = F.broadcast(listed)
    match = reduce(lambda a, b: a & b, [F.col(columns[i]).cast("string").eqNullSafe(F.col(n)) for i, n in zip(varying, names)])
    if not exclusion:
        return df.where(fixed).join(listed, match, "left_semi")
    return df.join(listed, match & fixed, "left_anti")


def match_uids(rows: DataFrame, cross: DataFrame, in_types: Iterable[str], out_type: str, keep_own: bool = True) -> DataFrame:
    """Replace ``uid`` by its matches in ``cross`` (``uid1, uid1_type, uid2, uid2_type``).

    If ``out_type`` is one of ``in_types``, identity pairs are ignored and the
    rows of that type are added as they are.
    """
    in_types = list(in_types)
    pairs = cross.where(F.col("uid1_type").isin(*in_types) & (F.col("uid2_type") == out_type))
    own = out_type in in_types and keep_own
    if own:
        pairs = pairs.where(~((F.col("uid1") == F.col("uid2")) & (F.col("uid1_type") == F.col("uid2_type"))))
    pairs = pairs.select(F.col("uid1").alias("uid"), F.col("uid1_type").alias("uid_type"), "uid2")
    matched = rows.join(pairs, ["uid_type", "uid"]).withColumn("uid", F.col("uid2")).withColumn("uid_type", F.lit(out_type)).select(*rows.columns)
    if own:
        matched = matched.unionByName(rows.where(F.col("uid_type") == out_type))
    return matched


def match_uids_split(rows: DataFrame, cross: DataFrame, in_types: Iterable[str], out_type: str) -> DataFrame:
    """The newer rule: match everything if ``out_type`` is an input type, else match the others and add rows of it."""
    in_types = list(in_types)
    if out_type in in_types:
        return match_uids(rows, cross, in_types, out_type, keep_own=False)
    others = match_uids(rows.where(F.col("uid_type") != out_type), cross, in_types, out_type, keep_own=False)
    return others.unionByName(rows.where(F.col("uid_type") == out_type).select(*others.columns))


def join_with_aliases(frames: dict[str, DataFrame], rule: str, keys: list[str]) -> DataFrame:
    """Sources joined by rule; a column that several sources have is named ``source_column``."""
    seen: dict[str, int] = {}
    for df in frames.values():
        for c in df.columns:
            seen[c] = seen.get(c, 0) + (c not in keys)
    renamed = {n: df.select(*keys, *[F.col(c).alias(f"{n}_{c}" if seen[c] > 1 else c) for c in df.columns if c not in keys]) for n, df in frames.items()}
    return join_by_rule(renamed, rule, keys)


def dimension_join(rows: DataFrame, dimension: DataFrame, on: list[str], where: str | None = None, select: list[str] | None = None, how: str = "left", kind: str = "regular") -> DataFrame:
    """Join with a filtered, renamed and distinct dimension."""
    d = dimension.where(where) if where else dimension
    d = d.selectExpr(*select) if select else d
    return configured_join(rows, d.distinct(), on, how, kind)


def intersect_by(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key others have."""
    return rows.join(others.select(*on), on, "left_semi")


def subtract_by(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key others don't have."""
    return rows.join(others.select(*on), on, "left_anti")


def match_link_ids(rows: DataFrame, links: DataFrame, id_expr: str, link_column: str, out_column: str, name: str = "uid", kind: str = "regular") -> DataFrame:
    """Replace ``name`` by the linked id where ``id_expr`` equals ``link_column``."""
    l = links.select(F.col(link_column).alias("_link"), F.col(out_column).alias("_out"))
    met = rows.withColumn("_link", F.expr(id_expr))
    return configured_join(met, l, ["_link"], "inner", kind).drop("_link").withColumn(name, F.col("_out")).drop("_out")


def with_global_stats(rows: DataFrame, **stats: Column) -> DataFrame:
    """Each row with aggregates over all rows (one row, broadcast)."""
    return rows.crossJoin(F.broadcast(rows.agg(*[c.alias(n) for n, c in stats.items()])))


def activity_filter(rows: DataFrame, active: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows of active users; ``inner`` repeats a row once per match, ``left_semi`` does not."""
    return rows.join(active.select(*on), on, how)


def pack_and_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Full outer join of both sides packed in structs ``l`` and ``r``."""
    pack = lambda df, n: df.select(*on, F.struct(*df.columns).alias(n))
    return pack(left, "l").join(pack(right, "r"), on, "full_outer")
