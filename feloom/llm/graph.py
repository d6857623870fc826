"""Candidate pairs from buckets and connected components, as DataFrame operations.

Nothing here gathers a bucket, a neighbourhood or a component in one task:
groups are reduced by partial aggregates (``min``, ``max``, ``count``) and met
again by equi-joins, which adaptive execution can split when a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _is_stars(edges: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other edge to one that has no smaller neighbour."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.min("out").alias("low"))
    return seen.where("outs > 1 or (outs = 1 and low = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of the neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, moves to the smallest one."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges``; the component is its smallest node.

    Alternates large-star and small-star steps until only stars are left, a number of
    rounds logarithmic in the length of chains. Each round is a table of its own,
    so a lost executor costs one round. Self loops and repeated edges are allowed.
    """
    now = cut(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), "edges")
    while not _is_stars(now):
        after = cut(_small_star(_large_star(now)), "edges")
        drop(now)
        now = after
    inner = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return inner.unionAll(roots)


def star_pairs(buckets: DataFrame) -> DataFrame:
    """``(a, b)``: each member of a bucket with the bucket's smallest member ``a``.

    ``buckets`` has ``key`` and ``id``. A bucket of any size gives one pair per member.
    """
    least = buckets.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    return buckets.join(least, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def mixed_keys(members: DataFrame) -> DataFrame:
    """What :func:`crossing_work` and :func:`met_in_cells` read of each key (``key, id, component``) that holds more than one component.

    ``g``: members of the key; ``own``: the sum of squares of its components' members; ``top``: its largest component; ``few``: the members outside it.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    square = F.sum(F.col("n").cast("double") * F.col("n")).alias("own")
    by_key = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("g"), square, F.max(F.struct("n", "component")).alias("most"))
    return by_key.where("parts > 1").select("key", "g", "own", F.col("most.component").alias("top"), (F.col("g") - F.col("most.n")).alias("few"))


def open_buckets(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component: ``key, id, component`` and what :func:`mixed_keys` gives."""
    named = buckets.join(components.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    return named.join(mixed_keys(named), "key")


def crossing_work(members: DataFrame) -> tuple[int, int]:
    """How many pairs of open buckets lie in different components, and the members of open buckets."""
    g = F.col("g").cast("double")
    work, rows = members.agg(F.sum((g * g - F.col("own")) / g) / 2, F.count("*")).first()
    return round(work or 0), rows


#: Members that are drawn from each open bucket in one pass.
DRAWS = 4


def reseeded_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Each member of an open bucket with up to ``DRAWS`` members of other components, drawn anew by ``seed``."""
    order = [F.xxhash64("id", "key", F.lit(DRAWS * seed + i)) for i in range(DRAWS)]
    drawn = members.groupBy("key").agg(*[f.alias(f"{n}{i}") for i, o in enumerate(order) for n, f in (("c", F.min_by("id", o)), ("of", F.min_by("component", o)))])
    partners = F.array(*[F.struct(F.col(f"c{i}").alias("c"), F.col(f"of{i}").alias("of")) for i in range(DRAWS)])
    met = members.join(drawn.select("key", partners.alias("partners")), "key")
    pairs = met.select("id", "component", F.explode(F.array_distinct("partners")).alias("p")).where("component <> p.of")
    return pairs.select(F.least("id", "p.c").alias("a"), F.greatest("id", "p.c").alias("b")).distinct()


#: Members of a bucket that one task compares with as many others.
BLOCK = 2000


def met_in_cells(full: DataFrame, condition) -> DataFrame:
    """``(a, b)`` for each two members of one key that lie in different components and that ``condition(l, r)`` admits.

    ``full`` has ``key, id, component``, what :func:`mixed_keys` gives of the key, and what the condition
    reads as columns of the aliases ``l`` and ``r``; the condition is part of the join's, so that
    hopeless pairs are never made into rows. ``earlier`` lists keys of the member: a pair that has one of them in common is made there. Of two members in different components one at least is outside the
    key's largest component, so these alone meet all members: what is linked already is not compared with itself.
    A key of more than ``BLOCK`` members on a side is dealt to blocks, and each two blocks meet in a
    cell of their own: no task compares more than about ``BLOCK`` squared pairs of a key.
    """
    last = lambda n: F.floor((F.col(n) - 1) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), last(n) + 1).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), last(n)))
    l = full.where("component <> top").withColumn("i", block("few")).withColumn("j", every("g")).drop("g", "own", "few").alias("l")
    r = full.withColumn("j", block("g")).withColumn("i", every("few")).drop("g", "own", "few").alias("r")
    # two members outside the largest component meet once, ordered by component
    apart = (F.col("l.component") < F.col("r.component")) | ((F.col("r.component") == F.col("r.top")) & (F.col("l.component") != F.col("r.component")))
    cell = (F.col("l.key") == F.col("r.key")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
    # exists, not arrays_overlap: it keeps the join out of whole-stage code, where so long a condition is one method that the JVM only interprets
    before = F.exists("l.earlier", lambda k: F.array_contains("r.earlier", k))
    met = l.join(r, cell & apart & condition("l", "r") & ~before)
    return met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))


def crossing_pairs(members: DataFrame, facts: DataFrame, possible) -> DataFrame:
    """All pairs of one open bucket that lie in different components and that ``possible(l, r)`` admits.

    ``facts`` holds by ``id`` what ``possible`` reads; see :func:`met_in_cells`. A pair that shares several
    buckets is made only in the one with the smallest key.
    """
    keys = members.groupBy("id").agg(F.collect_list("key").alias("keys"))
    full = members.join(keys, "id").join(facts, "id").withColumn("earlier", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    return met_in_cells(full, possible)


#: Passes with newly drawn partners at most.
RESEEDS = 2


def search(buckets: DataFrame, links, complete, partners: int, label: str, worth: int | None = None) -> DataFrame:
    """``(node, component)`` of the links among the members of common buckets (``key, id``).

    ``links(pairs, last)`` confirms pairs; ``complete(members)`` gives all pairs of members of
    open buckets in different components that may be linked. Members meet
    the smallest one of their bucket first. While more than ``partners`` partners of other
    components are left to a member on average, they then meet others drawn anew, which joins
    what is densely linked at the cost of a few pairs a member; that ends after ``RESEEDS``
    passes, one without a link, or one that took more than ``worth`` pairs a link. All pairs of different
    components that are left are then searched, in every case, so the number of passes changes only the cost.
    """
    tried = cut(star_pairs(buckets), f"{label}-pairs")
    found = links(tried, False)
    groups = cut(connected_components(found, "a", "b"), f"{label}-groups")
    turn, done, latest = 0, False, tried
    while not done:
        members = cut(open_buckets(buckets, groups), f"{label}-open")
        work, rows = crossing_work(members)
        if not work:
            break
        done = work <= partners * rows or turn >= RESEEDS or found.isEmpty() or bool(worth) and worth * found.count() < latest.count()
        pairs = complete(members) if done else reseeded_pairs(members, turn)
        fresh = cut(pairs.join(tried, ["a", "b"], "left_anti"), f"{label}-fresh")
        drop(members)
        found = links(fresh, done)
        if not found.isEmpty():
            joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found)
            groups = cut(connected_components(joined, "a", "b"), f"{label}-groups")
        if not done:
            tried = tried.unionAll(fresh)
        turn, latest = turn + 1, fresh
    return groups


#: Buckets of a bitmap of ids, a power of two; as a table it has at most BITMAP / 64 rows.
BITMAP = 1 << 22


def only_listed(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows that may have one of the listed ids, before a shuffle: all that have one, and some others.

    The bitmap is broadcast; its size does not depend on the data. The more ids
    there are, the less it keeps out, and the join that follows decides.
    """
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(BITMAP))
    bit = lambda c: (bucket(c) % 64).cast("int")
    word = lambda c: F.floor(bucket(c) / 64).cast("int")
    marks = ids.select(word(name).alias("_fl_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(name)).alias("_fl_mark"))
    bitmap = marks.groupBy("_fl_word").agg(F.bit_or("_fl_mark").alias("_fl_bits"))
    met = rows.withColumn("_fl_word", word(name)).join(F.broadcast(bitmap), "_fl_word")
    set_ = F.call_function("shiftrightunsigned", F.col("_fl_bits"), bit(name)).bitwiseAND(F.lit(1)) == 1
    return met.where(set_).drop("_fl_word", "_fl_bits")
