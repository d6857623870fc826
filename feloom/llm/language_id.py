"""Language identification by Bayesian fusion of evidence.

For each row the posterior of a language is proportional to

* the likelihood of its text under byte-trigram models, tempered so that the
  dependent trigrams of a long text do not count as independent evidence;
* the likelihood of the language that the row declares (markup or metadata),
  with a reliability learned from all rows;
* a prior of its host, smoothed towards the prior of the host's address suffix,
  which is smoothed towards that of all rows. A row's own share is taken out of
  the counts that make its prior.

All counts are sums of text posteriors, made by grouped aggregation over every
row. One more class, ``und``, has the same likelihood for all trigrams; it wins
for text that no model knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .textarrays import LOWER, Texts, pieces

#: Labelled rows that the text models may be fitted on, at most.
SAMPLE_ROWS = 3000
#: Languages that the models may tell apart, at most (a quarter of a MB each in every task); the most frequent of all rows are taken.
MOST_LANGUAGES = 1000
BUCKETS = 1 << 16
UNKNOWN = "und"
#: Trigrams count fully up to about this many.
FULL_WEIGHT = 64.0
#: Rows' worth of the coarser prior in each finer one, and of even chances in the declaration's reliability.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 5.0
LEAST_POSTERIOR = 0.5


#: Bytes of ASCII that say nothing of a language: digits, punctuation, control codes.
_SILENT = np.zeros(256, bool)
_SILENT[[b for b in range(128) if not chr(b).isalpha() and chr(b) not in " \n"]] = True


def trigrams(texts: Texts) -> np.ndarray:
    """A bucket for the trigram that starts at each byte; BUCKETS if the text ends before, a byte is silent or all are spaces."""
    d = LOWER[texts.data].astype(np.uint32)
    codes = np.full(len(d), BUCKETS, np.int64)
    if len(d) > 2:
        silent = _SILENT[texts.data]
        made = (((d[:-2] << 16) | (d[1:-1] << 8) | d[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        space = texts.data <= 32
        useless = silent[:-2] | silent[1:-1] | silent[2:] | (space[:-2] & space[1:-1] & space[2:])
        codes[:-2] = np.where(useless, BUCKETS, made)
    for back in (1, 2):
        ends = texts.limits[1:] - back
        codes[ends[ends >= 0]] = BUCKETS
    return codes


class TextModel:
    """Log probabilities of trigram buckets, one row per language and one for UNKNOWN."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        smooth = 0.5
        self.table = np.zeros((len(languages) + 1, BUCKETS + 1), np.float32)
        if languages:
            self.table[:-1, :BUCKETS] = np.log((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS))
        self.table[-1, :BUCKETS] = -np.log(BUCKETS)

    def likelihoods(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods (text x language) and trigram counts."""
        codes = trigrams(texts)
        size = np.diff(texts.limits)
        sums = np.zeros((texts.n, len(self.languages)))
        full = np.flatnonzero(size)
        if len(full):
            starts = texts.limits[full]
            for column, logs in enumerate(self.table):
                sums[full, column] = np.add.reduceat(logs[codes], starts, dtype=np.float64)
        n = np.zeros(texts.n, np.int64)
        if len(full):
            n[full] = np.add.reduceat((codes < BUCKETS).astype(np.int64), starts)
        return sums / (1 + n / FULL_WEIGHT)[:, None], n


def fit_text_model(sample: DataFrame) -> TextModel:
    """From rows of a language and a text; languages in the order of their codes.

    Trigrams are counted where the texts are: a language reaches the driver as its ``BUCKETS`` counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, language in enumerate(batch.column(0).to_pylist()):
                mine = sums.setdefault(language, np.zeros(BUCKETS, np.int64))
                for _, _, texts in pieces(batch.column(1).slice(at, 1)):
                    codes = trigrams(texts)
                    mine += np.bincount(codes[codes < BUCKETS], minlength=BUCKETS)
        for language, mine in sums.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(mine[used])], ["language", "bucket", "n"])

    def whole(language: pa.Table) -> pa.Table:
        counts = np.bincount(language["bucket"].to_numpy(), weights=language["n"].to_numpy(), minlength=BUCKETS).astype(np.int64)
        return pa.table({"language": language["language"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    counted = map_arrow(sample.select("_fl_declared", "_fl_text"), count, "language string, bucket int, n long")
    summed = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    rows = sorted(summed.groupBy("language").applyInArrow(whole, "language string, counts binary").collect(), key=lambda r: r.language)
    counts = [np.frombuffer(r.counts, np.int64) for r in rows]
    return TextModel([r.language for r in rows], np.stack(counts) if counts else np.zeros((0, BUCKETS)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def code_of(column):
    """The primary part of a language tag, lower-cased; null if there is none."""
    part = F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^\s*([A-Za-z]{2,8})", 1))
    return F.nullif(part, F.lit(""))


def evidence(docs: DataFrame, text, declared, host, suffix) -> DataFrame:
    """``docs`` reduced to ``_fl_text, _fl_declared, _fl_host, _fl_suffix`` beside its other narrow columns."""
    return docs.select(
        "*",
        F.coalesce(text, F.lit("")).alias("_fl_text"),
        code_of(declared).alias("_fl_declared"),
        F.coalesce(host, F.lit("")).alias("_fl_host"),
        F.coalesce(suffix, F.lit("")).alias("_fl_suffix"),
    )


def rows_of_each(counts: list[int], most: int) -> int:
    """The largest k for which ``most`` has room for up to k rows of each language; 1 at least."""
    k, free, left = 1, most, len(counts)
    for n in sorted(counts):
        k = max(1, free // left)
        if n > k:
            break
        k, free, left = n, free - n, left - 1
    return k


def declared_sample(rows: DataFrame, keys: list[str], sample_rows: int) -> DataFrame:
    """``_fl_declared, _fl_text``: up to the same number of rows of each declared language, counted over all rows.

    As in ``bounded_sample`` a threshold on the hash comes before the ranks, so
    the rows of a language that are ranked are bounded whatever its count.
    """
    drawn = rows.where("_fl_declared is not null and length(_fl_text) > 2").select(*keys, "_fl_declared", "_fl_text")
    counts = drawn.groupBy("_fl_declared").count().orderBy(F.desc("count"), "_fl_declared").limit(MOST_LANGUAGES).collect()
    if not counts:
        return drawn.select("_fl_declared", "_fl_text").limit(0)
    k = rows_of_each([r["count"] for r in counts], sample_rows)
    scale = 1 << 40
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["_fl_declared"], int(min(1.0, (1.5 * k + 100) / r["count"]) * scale))])
    place = F.pmod(F.xxhash64(*keys, "_fl_declared"), F.lit(scale))
    few = drawn.withColumn("_fl_place", place).where(F.col("_fl_place") <= shares[F.col("_fl_declared")])
    rank = F.row_number().over(Window.partitionBy("_fl_declared").orderBy("_fl_place", *keys))
    return few.withColumn("_fl_rank", rank).where(F.col("_fl_rank") <= k).select("_fl_declared", "_fl_text")


def identify(rows: DataFrame, keys: list[str], sample_rows: int = SAMPLE_ROWS, least_posterior: float = LEAST_POSTERIOR) -> DataFrame:
    """``keys``, ``language``, ``posterior`` and ``kept`` for every row of :func:`evidence`.

    The text models are fitted on at most ``sample_rows`` rows that declare a
    language (one of each language at least), drawn per language by a hash of their keys. A row is kept if a language other
    than UNKNOWN has the highest posterior, at least ``least_posterior``, and its
    text has a trigram of letters at all; so null, empty and one-letter texts are rejected.
    Nulls in the other evidence count as no evidence; a null host is the host "".
    Equal posteriors go to the smaller code. Columns of ``rows`` named ``language``, ``posterior`` or
    ``kept`` are not read unless they are keys, and keys must not have these names or begin with ``_fl_``. Repeated rows get equal results, an
    empty table gives no rows. If nothing declares a language, all is rejected.
    """
    sample = declared_sample(rows, keys, sample_rows)
    model = fit_text_model(sample)
    languages, width = model.languages, len(model.languages)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = batch.schema.get_all_field_indices("_fl_text")[0]
            for row, stop, texts in pieces(batch.column(others)):
                logs, n = model.likelihoods(texts)
                part = [batch.column(i)[row:stop] for i in range(batch.num_columns) if i != others]
                names = [f for i, f in enumerate(batch.schema.names) if i != others]
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), width).cast(pa.list_(pa.float64())) for x in (logs, softmax(logs))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(n), *lists], [*names, "_fl_n", "_fl_logs", "_fl_soft"])

    narrow = rows.select(*keys, "_fl_text", "_fl_declared", "_fl_host", "_fl_suffix")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.select(*keys).schema)
    evidence_ddl = f"{key_ddl}, _fl_declared string, _fl_host string, _fl_suffix string, _fl_n long"
    measured = cut(map_arrow(narrow, measure, evidence_ddl + ", _fl_logs array<double>, _fl_soft array<double>"), "language-evidence")

    useful = measured.where("_fl_n > 0")
    soft = [F.sum(F.col("_fl_soft")[i]).alias(f"s{i}") for i in range(width)]
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    vector = F.array(*[f"s{i}" for i in range(width)])
    # hosts of rows that say nothing are there too, for the sake of their suffix
    mine = [F.sum(F.when(F.col("_fl_n") > 0, F.col("_fl_soft")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(width)]
    by_host = cut(measured.groupBy("_fl_suffix", "_fl_host").agg(*mine), "hosts")
    by_suffix = by_host.groupBy("_fl_suffix").agg(*again)
    whole = by_suffix.agg(*again).first()
    everywhere = np.array([whole[i] or 0.0 for i in range(width)]) + 1.0
    everywhere /= everywhere.sum()

    # one row per declared code that the models know, so bounded by the number of languages
    known = useful.where(F.col("_fl_declared").isin(*languages[:-1]) if width > 1 else F.lit(False))
    reliability = np.full((width, width), DECLARED_WEIGHT / width)
    for r in known.groupBy("_fl_declared").agg(*soft).collect():
        reliability[languages.index(r[0])] += np.array(list(r)[1:], float)
    reliability /= reliability.sum(axis=0, keepdims=True)
    declared_log = {code: np.log(reliability[i]) for i, code in enumerate(languages)}

    suffixes = by_suffix.select(F.col("_fl_suffix").alias("_fl_s"), vector.alias("_fl_suffix_sum"))
    hosts = by_host.select("_fl_suffix", "_fl_host", vector.alias("_fl_host_sum")).join(suffixes, F.col("_fl_suffix") == F.col("_fl_s")).drop("_fl_s")
    hosts = cut(hosts, "host-counts")
    placed = measured.join(hosts, ["_fl_suffix", "_fl_host"], "left").select(*keys, "_fl_declared", "_fl_n", "_fl_logs", "_fl_soft", "_fl_host_sum", "_fl_suffix_sum")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = len(keys)

            def matrix(name: str) -> np.ndarray:
                column = batch.column(name)
                if not column.null_count:
                    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                return np.array([x if x is not None else [0.0] * width for x in column.to_pylist()])

            n = batch.column("_fl_n").to_numpy()
            own = matrix("_fl_soft") * (n > 0)[:, None]
            host, suffix = (np.maximum(0, matrix(x) - own) for x in ("_fl_host_sum", "_fl_suffix_sum"))
            prior = (suffix + SUFFIX_WEIGHT * everywhere) / (suffix.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
            prior = (host + HOST_WEIGHT * prior) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            none = np.zeros(width)
            said = np.array([declared_log.get(d, none) for d in batch.column("_fl_declared").to_pylist()])
            posterior = softmax(matrix("_fl_logs") + said + np.log(prior))
            best = posterior.argmax(axis=1)
            top = posterior[np.arange(len(best)), best]
            kept = (best < width - 1) & (top >= least_posterior) & (n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(k)] + [pa.array([languages[b] for b in best]), pa.array(top), pa.array(kept)],
                [*keys, "language", "posterior", "kept"],
            )

    return map_arrow(placed, fuse, key_ddl + ", language string, posterior double, kept boolean")


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: ``lang`` is what they declare, ``source`` their host; the suffix is what follows its last dot, if it has one."""
    return evidence(docs, F.col("text"), F.col("lang"), F.col("source"), F.lower(F.regexp_extract(F.coalesce("source", F.lit("")), r"\.([A-Za-z]{2,})\s*$", 1)))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Web pages: text without markup, the html element's ``lang``, host and top-level domain of the url."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return evidence(pages, plain, declared, host, F.regexp_extract(host, r"([^.]*)$", 1))


def reject_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is identified; columns as they come.

    Rejected rows are few, so the rows that stay are found by an anti-join against
    them on everything the decision depends on; the planner broadcasts the
    rejected keys only if their table is small enough.
    """
    keyed = document_evidence(docs).withColumn("_fl_hash", F.xxhash64("_fl_text"))
    judged = identify(keyed, ["doc_id", "_fl_hash", "lang", "source"])
    gone = cut(judged.where("not kept").select(*[F.col(c).alias(f"_fl_x_{i}") for i, c in enumerate(["doc_id", "_fl_hash", "lang", "source"])]).distinct(), "rejected")
    hashed = docs.withColumn("_fl_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = [hashed[c].eqNullSafe(gone[f"_fl_x_{i}"]) for i, c in enumerate(["doc_id", "_fl_hash", "lang", "source"])]
    return hashed.join(gone, same, "left_anti").drop("_fl_hash")
