"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct five-word shingles. Texts with equal sets
form a class first. Of each class one HyperMinHash sketch is kept: a shingle's
hash names one of ``BUCKETS`` registers, and the register holds, for the
smallest hash that fell into it, the count of leading zeros plus ``MANTISSA``
further bits (16 bits in all). Bands of ``ROWS`` compressed registers are the
keys of candidate buckets; the collision-corrected Jaccard estimate of the
registers discards what is far from the threshold; what remains is confirmed on
the full sets. Confirmed links are joined to components.

Buckets are searched as :func:`graph.search` says. Its complete search takes the sets of all
classes in open buckets, orders their shingles from rare to frequent and lets those meet that share
a shingle of their first ones (:func:`prefix_pairs`): a passage that many texts
have brings no pairs. The condition reads places and four bits of each register, so only pairs that may be links become rows.

Candidate recall: two sets of similarity J share a band with probability
1 - (1 - J**8)**32, that is 0.99996 at 0.85 and more above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, map_arrow
from .graph import met_in_cells, mixed_keys, only_listed, search
from .textarrays import mix, pieces, shingle_sets

BUCKETS, ROWS, MANTISSA = 256, 8, 10
SHINGLE = 5
#: Estimates below the threshold by more than this many standard errors are discarded.
SIGMAS = 4.0
#: Partners left to a member on average from which it meets newly drawn ones before the complete search.
CROSSING_WORK = 64
#: Compared pairs a link beyond which newly drawn partners are not worth their cost.
WORTH = 8


def registers(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One row of ``BUCKETS`` registers per set; ``values`` ascend within each set. 0: empty."""
    out = np.zeros((n, BUCKETS), np.uint16)
    if not len(values):
        return out
    bucket = (values >> np.uint64(56)).astype(np.int64)
    slot = owner * BUCKETS + bucket
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    rest = values[first] << np.uint64(8)
    top = rest >> np.uint64(16)
    width = np.frexp(top.astype(np.float64))[1].astype(np.int64)
    zeros = (48 - width).astype(np.uint64)
    mantissa = np.where(zeros < 48, (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA), np.uint64(0))
    out.reshape(-1)[slot[first]] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key per band of each sketch, and whether the band holds anything."""
    bands = BUCKETS // ROWS
    parts = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), bands, ROWS // 4)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(regs), bands)).copy()
    for i in range(ROWS // 4):
        key = mix(key ^ mix(parts[:, :, i] + np.uint64(i)))
    return key, parts.any(axis=2)


def _collision_table() -> np.ndarray:
    """Probability that two unrelated registers agree, by log2 of the two set sizes (0 to 40).

    A register that got m hashes is the smallest of m uniform values; the sum runs
    over its leading-zero count and the cells that the mantissa makes of each.
    """
    size = 2.0 ** np.arange(41) / BUCKETS
    zeros = np.arange(49)
    table = np.zeros((41, 41))
    cells = np.arange(2**MANTISSA)
    cdf = lambda m, x: -np.expm1(-m * x)
    lo = (2.0 ** -(zeros + 1))[:, None] * (1 + cells / 2**MANTISSA)
    width = (2.0 ** -(zeros + 1))[:, None] / 2**MANTISSA
    mass = np.array([cdf(m, lo + width) - cdf(m, lo) for m in size]).reshape(41, -1)
    table = mass @ mass.T
    return table


_table: list[np.ndarray] = []


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates and their standard errors, row by row."""
    if not _table:
        _table.append(_collision_table())
    used = (a != 0) | (b != 0)
    total = np.maximum(1, used.sum(axis=1))
    same = ((a == b) & used).sum(axis=1)
    i, j = (np.clip(np.round(np.log2(np.maximum(1, x))).astype(np.int64), 0, 40) for x in (na, nb))
    by_chance = BUCKETS * _table[0][i, j]
    j_hat = np.clip((same - by_chance) / total, 0, 1)
    return j_hat, np.sqrt(np.maximum(j_hat * (1 - j_hat), 0.02) / total)


SKETCH_DDL = "doc_id long, of_text long, n_shingles long, f1 long, f2 long, regs binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Hash of the text, set size, 128-bit set fingerprint and registers of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, texts in pieces(batch.column(2)):
                values, limits = shingle_sets(texts, SHINGLE)
                size = np.diff(limits)
                owner = np.repeat(np.arange(texts.n), size)
                prints = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)))])
                    prints.append((sums[limits[1:]] - sums[limits[:-1]]).view(np.int64))
                regs = registers(values, owner, texts.n)
                blob = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer(np.arange(texts.n + 1, dtype=np.int32) * (2 * BUCKETS)), pa.py_buffer(regs.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], batch.column(1)[row:stop], pa.array(size), pa.array(prints[0]), pa.array(prints[1]), blob], ["doc_id", "of_text", "n_shingles", "f1", "f2", "regs"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("of_text"), "text"), run, SKETCH_DDL)


def _regs(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def banded(classes: DataFrame) -> DataFrame:
    """``key, id``: the band keys of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, full = band_keys(_regs(batch.column(1)))
                ids = np.broadcast_to(batch.column(0).to_numpy()[:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[full].view(np.int64)), pa.array(ids[full])], ["key", "id"])

    return map_arrow(classes.select("id", "regs"), run, "key long, id long")


WORDS = BUCKETS // 16


def differ_limit(n: np.ndarray, percent: int) -> np.ndarray:
    """Differing registers that a pair at the threshold hardly exceeds, by set size.

    Of the registers in use, those that differ are a sample without replacement
    of the elements that differ; the limit lies SIGMAS standard errors above.
    """
    q = 1 - percent / 100
    union = 2 * np.maximum(1, n) / (1 + percent / 100)
    used = BUCKETS * (1 - (1 - 1 / BUCKETS) ** union)
    error = np.sqrt(used * q * (1 - q) * np.maximum(0, union - used) / np.maximum(1, union - 1))
    return np.ceil(q * used + SIGMAS * error + 2).astype(np.int64)


def compact(classes: DataFrame, percent: int) -> DataFrame:
    """``id, n_shingles, most, x0..``: :func:`differ_limit` and four bits of each register, 16 to a long."""
    names = ["id", "n_shingles", "most", *(f"x{i}" for i in range(WORDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = _regs(batch.column(2))
                four = np.where(regs > 0, 1 + regs % 15, 0).astype(np.uint8)
                packed = (four[:, 0::2] | four[:, 1::2] << 4).view(np.int64)
                most = pa.array(differ_limit(batch.column(1).to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), most, *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(WORDS))], names)

    made = map_arrow(classes.select("id", "n_shingles", "regs"), run, ", ".join(f"{n} long" for n in names))
    return made.where(" and ".join(f"{n} is not null" for n in names))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and estimate allow the similarity."""
    a, b = (classes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("regs").alias(f"r{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                guess, error = estimate(_regs(batch.column(4)), _regs(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.filter(pa.array(guess + SIGMAS * error >= percent / 100)).select(["a", "b"])

    return map_arrow(both, run, "a long, b long")


def _full_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, shingles``: the whole sorted set of each class in ``ids`` (``id``, distinct)."""
    asked = cut(ids.join(classes.select("id", "owner", "of_text"), "id"), "asked")
    candidates = only_listed(docs.select(F.col("doc_id").cast("long").alias("owner"), "text"), asked, "owner")
    texts = candidates.withColumn("of_text", F.xxhash64("text")).join(asked.hint("merge"), ["owner", "of_text"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, texts in pieces(batch.column(1)):
                values, limits = shingle_sets(texts, SHINGLE)
                raw = [values[limits[i] : limits[i + 1]].tobytes() for i in range(texts.n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], pa.array(raw, pa.binary())], ["id", "shingles"])

    return map_arrow(texts, run, "id long, shingles binary")


#: Shingles that :func:`_shingle_rows` gives in one batch (more only if one set alone has more).
BATCH = 1 << 18


def _shingle_rows(sets: DataFrame) -> DataFrame:
    """``key, id, n``: a row for each shingle of each set of :func:`_full_sets`, with the size of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1)
            n = np.array([len(x.as_buffer()) // 8 for x in raw], np.int64)
            at = 0
            while at < len(n):
                end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), BATCH, "right")))
                values = np.frombuffer(b"".join(x.as_py() for x in raw[at:end]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(ids[at:end], n[at:end])), pa.array(np.repeat(n[at:end], n[at:end]))], ["key", "id", "n"])
                at = end

    return map_arrow(sets, run, "key long, id long, n long")


#: Longs of the bitmap that :func:`parities` makes of a set.
PARITIES = 16


def parities(sets: DataFrame) -> DataFrame:
    """``id, p0..``: a bitmap whose bits tell whether an odd number of the shingles of a set of :func:`_full_sets` fall on them.

    A bit in which two sets differ needs a shingle that only one has.
    """
    names = ["id", *(f"p{i}" for i in range(PARITIES))]
    bits = 64 * PARITIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                odd = [np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1 for x in batch.column(1)]
                words = np.packbits(np.array(odd, np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(PARITIES))], names)

    return map_arrow(sets, run, ", ".join(f"{n} long" for n in names))


#: First shingles of a set that are remembered, so that a pair which shares several of them is made once.
KNOWN = 64


def prefix_pairs(docs: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes in ``members`` (``id, component``) of different components that may be linked, without a miss but for
    what the registers' limit discards.

    Shingles are ordered by the number of sets that have them, then by hash. Linked sets have at least ``percent`` of
    the larger one in common, so their first common shingle is among the first ``n - ceil(percent * n / 100) + 1`` of both;
    what follows its places bounds what they have in common. Shingles of one set alone only count as places. Sets whose
    bitmaps (:func:`parities`) differ in more bits than the similarity leaves to differ are no pair; that loses no link.
    """
    known = cut(members.select("id", "component").distinct(), "open-classes")
    sets = cut(_full_sets(docs, classes, known.select("id")), "open-sets")
    rows, facts = cut(_shingle_rows(sets), "open-shingles"), cut(parities(sets), "open-facts")
    drop(sets)
    shared = rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1")
    whole = Window.partitionBy("id")
    place = F.col("n") - F.count("*").over(whole) + F.row_number().over(whole.orderBy("often", "key"))
    first = rows.join(shared, "key").withColumn("place", place).where(f"place <= n - (({percent} * n + 99) div 100) + 1")
    first = cut(first.join(known, "id").select("key", "id", "component", "place"), "prefixes")
    drop(rows)
    full = cut(first.join(mixed_keys(first), "key"), "prefixes-open")
    drop(first)
    listed = full.where(f"place <= {KNOWN}").groupBy("id").agg(F.collect_list(F.struct("place", "key")).alias("listed"))
    before = F.transform(F.filter("listed", lambda s: s["place"] < F.col("place")), lambda s: s["key"])
    full = full.join(listed, "id", "left").withColumn("earlier", F.coalesce(before, F.array().cast("array<long>"))).drop("listed")
    full = full.join(compact(classes, percent), "id").join(facts, "id")

    def possible(l: str, r: str):
        nl, nr = F.col(f"{l}.n_shingles"), F.col(f"{r}.n_shingles")
        common = F.least(nl - F.col(f"{l}.place"), nr - F.col(f"{r}.place")) + 1
        differ = sum(F.bit_count(F.col(f"{l}.p{i}").bitwiseXOR(F.col(f"{r}.p{i}"))) for i in range(PARITIES))
        return ((100 + percent) * common >= percent * (nl + nr)) & ((100 + percent) * differ <= (100 - percent) * (nl + nr)) & _possible(l, r, percent)

    return met_in_cells(full, possible).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("id").alias(s), F.col("shingles").alias(f"s{s}")) for s in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                merged = np.concatenate([x, y])
                merged.sort()
                common = int((merged[1:] == merged[:-1]).sum())
                linked.append(100 * common >= percent * (len(merged) - common))
            yield batch.filter(pa.array(linked, pa.bool_())).select(["a", "b"])

    return map_arrow(both, run, "a long, b long").distinct()


def near_groups(docs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, of_text (hash of the text), n_shingles, component_id, first`` for every row.

    ``first`` is true for one text of each component, of the smallest ``doc_id``.
    A class of texts with equal sets is named by the first half of its fingerprint;
    classes that share it take a name of their own.
    """
    sketch = cut(sketches(docs), "sketch")
    named = sketch.where("doc_id is not null and n_shingles > 0")
    owners = cut(named.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("owner")), "owners")
    first = owners.groupBy("f1").agg(F.min("f2").alias("_fl_f2"), F.count("*").alias("_fl_n")).where("_fl_n > 1")
    name = F.when(F.col("_fl_f2").isNull() | (F.col("_fl_f2") == F.col("f2")), F.col("f1")).otherwise(F.xxhash64("f1", "f2", "n_shingles"))
    owners = cut(owners.join(first, "f1", "left").withColumn("id", name).drop("_fl_f2", "_fl_n"), "classes-named")
    met = named.withColumnRenamed("doc_id", "owner").join(owners, ["f1", "f2", "n_shingles", "owner"])
    classes = cut(met.select("id", "owner", "of_text", "n_shingles", "regs").dropDuplicates(["id"]), "classes")
    buckets = banded(classes)
    shared = buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    buckets = cut(buckets.join(shared, "key"), "bands")

    def links(pairs: DataFrame, estimated: bool) -> DataFrame:
        likely = pairs if estimated else cut(_likely(pairs, classes, percent), "likely")
        ids = likely.select(F.col("a").alias("id")).unionAll(likely.select(F.col("b").alias("id"))).distinct()
        sets = cut(_full_sets(docs, classes, ids), "sets")
        confirmed = cut(_confirmed(likely, sets, percent), "links")
        drop(sets)
        return confirmed

    def complete(members: DataFrame) -> DataFrame:
        return prefix_pairs(docs, classes, members, percent)

    groups = search(buckets, links, complete, CROSSING_WORK, "near", WORTH)
    drop(buckets)
    placed = owners.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = cut(placed, "placed")
    least = placed.groupBy("component").agg(F.min("owner").alias("component_id"))
    heads = placed.join(least, "component").where("owner = component_id").groupBy("component", "component_id").agg(F.min("id").alias("head"))
    by_class = placed.join(heads, "component").select("f1", "f2", "n_shingles", "component_id", (F.col("id") == F.col("head")).alias("is_head"))
    result = sketch.drop("regs").join(cut(by_class, "by-class"), ["f1", "f2", "n_shingles"], "left")
    found = F.col("component_id").isNotNull() & F.col("doc_id").isNotNull()
    component = F.when(found, F.col("component_id")).otherwise(F.col("doc_id"))
    first = F.when(found, F.col("is_head") & (F.col("doc_id") == F.col("component_id"))).otherwise(True)
    return result.select("doc_id", "of_text", "n_shingles", component.alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union| of
    their shingle sets. A null or wordless text has no shingles and is linked with
    nothing. ``component_id`` is the smallest ``doc_id`` reachable by links (there are no ties between ids), and
    ``kept`` marks the document that has it. Rows that repeat a ``doc_id`` and text
    get equal results; different texts of one ``doc_id`` are looked at each for itself. A null ``doc_id`` is a component
    of its own and kept. Other columns are not read, whatever their names; an empty table gives no rows.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return near_groups(docs, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that have a near-duplicate of a smaller ``doc_id``.

    A row is told by ``doc_id`` and text. Of near-duplicates with one ``doc_id``, one text stays;
    rows that repeat both all stay, as do rows without ``doc_id`` or words.
    """
    gone = near_groups(docs, percent).where("not first").select(F.col("doc_id").alias("_fl_gone"), F.col("of_text").alias("_fl_of")).distinct()
    gone = cut(gone, "near-gone")
    return docs.join(gone, (docs["doc_id"] == gone["_fl_gone"]) & (F.xxhash64(docs["text"]) == gone["_fl_of"]), "left_anti")


def _lanes(x):
    """How many of the 16 four-bit lanes of a long are not 0."""
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def _possible(l: str, r: str, percent: int):
    """What sizes and compact registers allow for a link, as a join condition."""
    na, nb = F.col(f"{l}.n_shingles"), F.col(f"{r}.n_shingles")
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    differ = sum(_lanes(F.col(f"{l}.x{i}").bitwiseXOR(F.col(f"{r}.x{i}"))) for i in range(WORDS))
    return near & (differ <= F.greatest(F.col(f"{l}.most"), F.col(f"{r}.most")))
