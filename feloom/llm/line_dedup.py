"""Fuzzy line deduplication by MinHash.

A line is compared without case and outer spaces. Its set is the hashes of the
``SHINGLE_CHARS`` characters that begin at each of its characters; a shorter
line is one shingle. Its signature is the smallest hashes of the set in order,
and runs of neighbours in it are the bands: two lines meet in a bucket if so
many common hashes follow each other in both signatures.

- Sets of at most ``DENSE`` hashes: every run of 4 in the 24 smallest.
- Sets of 0.8 * ``DENSE`` to ``LONG``: of the 64 smallest, the runs of 5 that begin
  with a multiple of 5.
- Sets of at least 0.8 * ``LONG``: of the 128 smallest, the runs of 7 that begin
  with a multiple of 6.

Similar sets differ in size by less than a fifth, so any two that can be linked
have one of the rules in common. Long lines share some shingles with any other in their
language, and the pairs that meet by these alone grow with the square of the table; the longer
run keeps nearly all of them apart. At a similarity of 0.8 the rules find a pair with
a probability of 0.98, at 0.85 of 0.99. Lines that meet
are verified by the exact Jaccard similarity of their whole sets; verified links
are joined to components by distributed union-find; one line of each component
stays, the one that comes first by ``doc_id`` and place.

Lines, buckets, union-find and the new texts are DataFrame operations. Shingles are not: as array functions
they alone take more than the whole budget of the check tool (see the README), so Arrow batches make
signatures and compare sets.

Equal lines are one node from the start, so copies of any number cost one row
each. Nodes are named by 64-bit hashes of the lines, and a second hash tells lines apart that
share the first: they get names of their own. Buckets are searched as :func:`graph.search` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, map_arrow
from .graph import crossing_pairs, only_listed, search
from .textarrays import Texts, mix, pieces

SHINGLE_CHARS = 5
#: Signature length and run length of small sets, of larger ones and of the largest; see above.
SMALL, SMALL_RUN = 24, 4
LARGE, LARGE_RUN, STEP = 64, 5, 5
HUGE, HUGE_RUN, HUGE_STEP = 128, 7, 6
DENSE, LONG = 80, 200
PERCENT = 80
#: Partners left to a member on average from which it meets newly drawn ones before the complete search.
CROSSING_WORK = 64
#: Compared pairs a link beyond which newly drawn partners are not worth their cost.
WORTH = 8
SPACES = " \t\x0b\x0c\r"
#: Passes in which keys of several lines are found, each over its share of all keys: no more of them are in shuffle files at once.
PARTS = 2
#: Bits of a line's first hash that name it (all; fewer in tests of shared names).
NAME_BITS = -1


def normal_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, _fl_text (hash of the text), place, norm, line, twin``: the lines with a word and two hashes of ``norm``."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("_fl_text"), F.posexplode(F.split(F.lower(text), "\n")).alias("place", "norm"))
    lines = lines.withColumn("norm", F.trim("norm", F.lit(SPACES))).where("norm <> ''")
    return lines.withColumns({"line": F.xxhash64("norm").bitwiseAND(F.lit(NAME_BITS)), "twin": F.xxhash64("norm", F.lit(1))})


_FACTOR = np.uint64(0x9FB21C651E98DF25)


def code_points(lines: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines and their limits; a byte that is no UTF-8 is one code point."""
    raw = lines.data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(raw):
        return points, lines.limits
    seen = np.concatenate([[0], np.cumsum((lines.data & 0xC0) != 0x80)])
    if seen[-1] == len(points):
        return points, seen[lines.limits]
    sizes = [len(raw[a:b].decode("utf-8", "surrogateescape")) for a, b in zip(lines.limits[:-1], lines.limits[1:])]
    return points, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def shingles(lines: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle of each line, repeated ones too, and the number of its line, ascending."""
    points, limits = code_points(lines)
    size = np.diff(limits)
    owner = np.repeat(np.arange(lines.n), size)
    padded = np.zeros(len(points) + SHINGLE_CHARS, np.uint64)
    padded[: len(points)] = points
    padded[: len(points)] += np.uint64(1)
    total = padded[: len(points)].copy()
    for i in range(1, SHINGLE_CHARS):
        total *= _FACTOR
        total += padded[i : i + len(points)]
    whole = np.ones(len(points), bool)
    for back in range(SHINGLE_CHARS - 1):  # nothing begins at the last four characters
        whole[limits[1:][size > back] - 1 - back] = False
    for n in range(1, SHINGLE_CHARS):  # but a shorter line is one shingle
        first = limits[:-1][size == n]
        short = np.full(len(first), n, np.uint64)
        for i in range(n):
            short = short * _FACTOR + padded[first + i]
        total[first], whole[first] = ~short, True
    return mix(total[whole]), owner[whole]


#: Bits of a hash that signatures and first comparisons use; the number of a line takes the others.
LOW = 42
#: Lines handled together, and bytes of text (more only if one line alone is longer).
MOST_LINES = 1 << (63 - LOW)
PIECE = 1 << 18


def line_pieces(column: pa.Array, most: int = MOST_LINES) -> Iterator[tuple[int, int, Texts]]:
    for row, stop, lines in pieces(column, PIECE):
        for at in range(0, lines.n, most):
            end = min(lines.n, at + most)
            limits = lines.limits[at : end + 1]
            yield row + at, row + end, Texts(lines.data[limits[0] : limits[-1]], limits - limits[0])


def sorted_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes (their upper ``LOW`` bits), ascending within each line, their lines and the size of each set."""
    values = np.sort((owner.astype(np.uint64) << np.uint64(LOW)) | (hashes >> np.uint64(64 - LOW)))
    if len(values):
        values = values[np.concatenate([[True], values[1:] != values[:-1]])]
    owner = (values >> np.uint64(LOW)).astype(np.int64)
    return values & np.uint64((1 << LOW) - 1), owner, np.bincount(owner, minlength=n)


def band_keys(values: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands and their lines, for sets as :func:`sorted_sets` gives them."""
    begin = np.concatenate([[0], np.cumsum(size)])
    rank, of = np.arange(len(values)) - begin[owner], size[owner]

    def runs(at: np.ndarray, length: int) -> np.ndarray:
        key = np.full(len(at), length, np.uint64)
        for i in range(length):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[at + i])
        return key

    small = np.flatnonzero((of <= DENSE) & (rank + SMALL_RUN <= np.minimum(of, SMALL)))
    large = np.flatnonzero((5 * of >= 4 * DENSE) & (of <= LONG) & (rank + LARGE_RUN <= np.minimum(of, LARGE)) & (values % np.uint64(STEP) == 0))
    huge = np.flatnonzero((5 * of >= 4 * LONG) & (rank + HUGE_RUN <= np.minimum(of, HUGE)) & (values % np.uint64(HUGE_STEP) == 0))
    parts = [(runs(small, SMALL_RUN), owner[small]), (runs(large, LARGE_RUN), owner[large]), (runs(huge, HUGE_RUN), owner[huge])]
    for n in range(1, SMALL_RUN):
        at = np.flatnonzero((of == n) & (rank == 0))
        parts.append((runs(at, n), owner[at]))
    return np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])


def keyed_lines(docs: DataFrame) -> DataFrame:
    """The lines as a narrow table, ``doc_id, _fl_text, place, line, twin, keys``: the one pass that makes shingles of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, lines in line_pieces(batch.column(5)):
                values, owner, size = sorted_sets(*shingles(lines), lines.n)
                keys, of = band_keys(values, owner, size)
                order = np.argsort(of, kind="stable")
                limits = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=lines.n))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(limits), pa.array(keys[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[row:stop] for i in range(5)), lists], ["doc_id", "_fl_text", "place", "line", "twin", "keys"])

    lines = normal_lines(docs).select(F.col("doc_id").cast("long"), "_fl_text", "place", "line", "twin", "norm")
    return cut(map_arrow(lines, run, "doc_id long, _fl_text long, place int, line long, twin long, keys array<long>"), "lines")


def named_lines(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyed`` with ``id``, one for each different line, and ``id, line, twin, owner, copies`` of each id.

    The id is the first hash; where lines with another second hash share it, all
    but one of them take a name of both hashes.
    """
    keyed = keyed.withColumn("id", F.col("line"))
    salt = 2
    while True:
        facts = [F.min("line").alias("line"), F.min("twin").alias("twin"), F.max("twin").alias("other"), F.min("doc_id").alias("owner"), F.count("*").alias("copies")]
        owners = cut(keyed.groupBy("id").agg(*facts), "owners")
        shared = owners.where("twin <> other").select("id", F.col("twin").alias("_fl_first"))
        if shared.isEmpty():
            return keyed, owners.drop("other")
        # a handful of rows at any size: pairs of different lines with one 64-bit hash
        met = keyed.join(shared, "id", "left")
        moved = F.when(F.col("twin") != F.col("_fl_first"), F.xxhash64("line", "twin", F.lit(salt))).otherwise(F.col("id"))
        keyed = met.withColumn("id", moved).drop("_fl_first")
        salt += 1


def texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``id, norm`` of the asked lines (``id, line, twin, owner``), read from the document that owns each."""
    lines = normal_lines(docs).select("doc_id", "line", "twin", "norm")
    listed = only_listed(lines, asked, "line")
    where = asked.withColumnRenamed("owner", "doc_id").hint("merge")
    known = listed.where("doc_id is not null").join(where, ["line", "twin", "doc_id"]).select("id", "norm")
    # lines that only rows without an id have
    rest = listed.where("doc_id is null").join(where.where("doc_id is null").drop("doc_id"), ["line", "twin"]).select("id", "norm")
    return known.unionAll(rest).groupBy("id").agg(F.min("norm").alias("norm"))


def _linked(a: Texts, b: Texts, percent: int) -> np.ndarray:
    """Which lines of ``a`` and ``b`` in the same place have sets of that similarity.

    Sets of ``LOW`` bits of each hash decide what is compared by whole hashes: few
    of them agree by chance, and each takes at most one from what is common or differs.
    """
    (ha, oa), (hb, ob) = shingles(a), shingles(b)
    (va, oa_, na), (vb, ob_, nb) = sorted_sets(ha, oa, a.n), sorted_sets(hb, ob, b.n)
    tag = np.uint64(LOW)
    both = np.sort(np.concatenate([(oa_.astype(np.uint64) << tag) | va, (ob_.astype(np.uint64) << tag) | vb]))
    common = np.bincount((both[1:][both[1:] == both[:-1]] >> tag).astype(np.int64), minlength=a.n)
    likely = (100 + percent) * (common + 4) >= percent * (na + nb)
    la, lb = np.searchsorted(oa, np.arange(a.n + 1)), np.searchsorted(ob, np.arange(b.n + 1))
    for i in np.flatnonzero(likely):
        x, y = np.unique(ha[la[i] : la[i + 1]]), np.unique(hb[lb[i] : lb[i + 1]])
        merged = np.sort(np.concatenate([x, y]))
        met = int((merged[1:] == merged[:-1]).sum())
        likely[i] = 100 * met >= percent * (len(merged) - met)
    return likely


def verified_links(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact similarity reaches ``percent``."""
    a, b = (texts.select(F.col("id").alias(s), F.col("norm").alias(f"t{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for row, stop, x in line_pieces(batch.column(2)):
                for at, end, y in line_pieces(batch.column(3)[row:stop]):
                    some = Texts(x.data[x.limits[at] : x.limits[end]], x.limits[at : end + 1] - x.limits[at])
                    linked[row + at : row + end] = _linked(some, y, percent)
            yield batch.filter(pa.array(linked)).select(["a", "b"])

    return cut(map_arrow(both, run, "a long, b long").distinct(), "line-links")


#: Longs of the bitmap that :func:`set_facts` makes of a set.
WORDS = 32


def set_facts(texts: DataFrame) -> DataFrame:
    """``id, n, x0..``: set size and a bitmap whose bits tell whether an odd number of the set's hashes fall on them."""
    names = ["id", "n", *(f"x{i}" for i in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, lines in line_pieces(batch.column(1), 1024):
                values, owner, size = sorted_sets(*shingles(lines), lines.n)
                bits = 64 * WORDS
                odd = np.bincount(owner * bits + (values % np.uint64(bits)).astype(np.int64), minlength=lines.n * bits) & 1
                words = np.packbits(odd.astype(np.uint8).reshape(lines.n, bits), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], pa.array(size), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS))], names)

    made = map_arrow(texts.select("id", "norm"), run, ", ".join(f"{n} long" for n in names))
    return cut(made, "line-facts")


def _possible(l: str, r: str, percent: int):
    """Whether sizes and bitmaps allow a link, with room for two hashes that agree in their first bits by chance.

    A differing bit needs a hash that only one set has, so no link is lost.
    """
    na, nb = F.col(f"{l}.n"), F.col(f"{r}.n")
    near = 100 * (F.least(na, nb) + 2) >= percent * F.greatest(na, nb)
    bits = [F.bit_count(F.col(f"{l}.x{i}").bitwiseXOR(F.col(f"{r}.x{i}"))) for i in range(WORDS)]
    # a quarter of the bitmap settles most pairs before the rest is read
    few, differ = sum(bits[: WORDS // 4]), sum(bits)
    return near & ((100 + percent) * few <= (100 - percent) * (na + nb + 4)) & ((100 + percent) * differ <= (100 - percent) * (na + nb + 4))


def line_groups(docs: DataFrame, keyed: DataFrame, owners: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``node, component`` for the lines that are linked with another text; nodes are the ids of :func:`named_lines`."""
    bands = keyed.select(F.explode("keys").alias("key"), "id")
    parts = []
    for part in range(PARTS):
        some = bands.where(F.pmod("key", F.lit(PARTS)) == part)
        parts.append(cut(some.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key"), "shared-bands"))
    shared = reduce(DataFrame.unionAll, parts)
    buckets = cut(only_listed(bands, shared, "key").join(shared, "key").select("key", "id").distinct(), "line-buckets")
    for part in parts:
        drop(part)
    asked = buckets.select("id").distinct().join(owners.select("id", "line", "twin", "owner"), "id")
    texts = cut(texts_of(docs, cut(asked, "asked-lines")), "line-texts")

    def complete(members: DataFrame) -> DataFrame:
        some = texts.join(members.select("id").distinct(), "id", "left_semi")
        return crossing_pairs(members, set_facts(some), lambda l, r: _possible(l, r, percent))

    groups = search(buckets, lambda pairs, _: verified_links(texts, pairs, percent), complete, CROSSING_WORK, "line", WORTH)
    drop(texts)
    return groups


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, _fl_text, removed``: places (from 0) of the lines of each row that go, only rows that lose one."""
    keyed, owners = named_lines(keyed_lines(docs))
    groups = line_groups(docs, keyed, owners, percent)
    named = owners.join(groups.withColumnRenamed("node", "id"), "id", "left").where("copies > 1 or component is not null")
    named = cut(named.select("id", F.coalesce("component", "id").alias("component"), "owner"), "repeated")
    keepers = named.groupBy("component").agg(F.min("owner").alias("keeper"))
    verdict = cut(named.join(keepers, "component").select("id", "component", "keeper"), "verdicts")
    hit = keyed.select("doc_id", "_fl_text", "place", "id").join(verdict, "id")
    by_group = hit.groupBy("doc_id", "_fl_text", "component", "keeper").agg(F.min("place").alias("first"), F.collect_list("place").alias("places"))
    own = F.col("doc_id").eqNullSafe(F.col("keeper"))
    gone = F.when(own, F.array_except("places", F.array("first"))).otherwise(F.col("places"))
    removed = by_group.groupBy("doc_id", "_fl_text").agg(F.array_distinct(F.flatten(F.collect_list(gone))).alias("removed"))
    return removed.where(F.size("removed") > 0)


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and the ``text`` that remains.

    Of each component of equal or similar lines the first by ``doc_id`` and place
    stays. Lines without a word stay while another line of their text stays; a
    text that loses all its lines with a word becomes empty. Rows that repeat both
    ``doc_id`` and text are one document and lose the same lines. A null text
    stays null, a null ``doc_id`` comes after all others. Other columns pass through; columns named ``n_lines``,
    ``n_removed`` or ``_fl_text`` are replaced. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed", "_fl_text")
    removed = repeated_lines(docs.select(F.col("doc_id"), "text"), percent)
    removed = cut(removed.select(F.col("doc_id").alias("_fl_id"), F.col("_fl_text").alias("_fl_of"), "removed"), "removed")
    keyed = docs.withColumn("_fl_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    met = keyed.join(removed, keyed["doc_id"].eqNullSafe(removed["_fl_id"]) & (keyed["_fl_text"] == removed["_fl_of"]), "left")
    split = F.split("text", "\n")
    stay = F.filter(F.transform(split, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("removed", s["i"]))
    kept = F.transform(stay, lambda s: s["x"])
    worded = F.exists(kept, lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
    text = F.when(F.col("removed").isNull(), F.col("text")).when(worded, F.array_join(kept, "\n")).otherwise(F.lit(""))
    counts = {"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long")}
    return met.withColumns(counts).withColumn("text", text).drop("removed", "_fl_text", "_fl_id", "_fl_of")
