"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Statistics come from whole texts, a batch at a time, as numpy arrays. The trees
are fitted on the driver from a bounded sample of labelled rows, flattened into
arrays of nodes, and score all rows level by level without branching. Chosen
statistics (symbol, repeated-word and repeated-line shares) can only lower the
score: every split on them keeps the mean of its upper side at or below that of
its lower side, within the bounds that splits above have set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, map_arrow
from .textarrays import IS_SPACE, Texts, mix, pieces, windows

#: Labelled rows that the trees may be fitted on, at most.
SAMPLE_ROWS = 20_000
REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_stops", "n_distinct", "max_word"]
#: Name of each feature and how the score may follow it: -1 never up, 0 freely.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "words_per_line": 0,
    "upper_share": 0,
    "digit_share": -1,
    "stop_share": 0,
    "distinct_share": 0,
    "max_word": 0,
}


def statistics(texts: Texts) -> dict[str, np.ndarray]:
    """The counts named in BASE and MORE, one value per text."""
    n, data, limits = texts.n, texts.data, texts.limits

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[limits[1:]] - sums[limits[:-1]]

    starts, ends, doc = texts.words()
    count = np.bincount(doc, minlength=n)
    hashed = texts.hashes(starts, ends)
    out = {
        "n_words": count,
        "word_chars": inside(~IS_SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": inside(_SYMBOL[data]),
        "n_upper": inside(_UPPER[data]),
        "n_digits": inside(_DIGIT[data]),
        "n_stops": inside(_STOP[data]),
    }

    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([limits[:-1], breaks + 1]), kind="stable")
    line_doc = np.concatenate([np.arange(n), np.searchsorted(limits, breaks, "right") - 1])
    line_doc.sort(kind="stable")
    next_start = np.concatenate([line_start[1:], limits[-1:]])
    last_of_doc = np.concatenate([line_doc[1:] != line_doc[:-1], [True]]) if n else np.zeros(0, bool)
    line_end = np.where(last_of_doc, limits[1:][line_doc], next_start - 1)
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    lines = texts.hashes(line_start, line_end)
    order = np.lexsort((lines, line_doc))
    a, b = lines[order], line_doc[order]
    again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(b[1:][again], minlength=n)

    values, at = windows(hashed, doc, REPEAT_WINDOW)
    of_doc = mix(values ^ mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(of_doc)
    ranked = of_doc[order]
    same = ranked[1:] == ranked[:-1]
    twice = at[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(at) else at
    change = np.bincount(twice, minlength=len(doc) + REPEAT_WINDOW)[: len(doc) + REPEAT_WINDOW]
    change = change - np.concatenate([np.zeros(REPEAT_WINDOW, np.int64), change[:-REPEAT_WINDOW]])
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(change)[: len(doc)] > 0], minlength=n)

    own = np.sort(mix(hashed ^ mix(doc.astype(np.uint64) + np.uint64(1))))
    own_order = np.lexsort((hashed, doc))
    h, d = hashed[own_order], doc[own_order]
    new = np.ones(len(own), bool)
    if len(own) > 1:
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    out["n_distinct"] = np.bincount(d[new], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, ends - starts)
    out["max_word"] = longest
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The matrix that the trees read; columns as in FEATURES."""
    words = np.maximum(1, s["n_words"]).astype(float)
    chars = np.maximum(1, s["word_chars"]).astype(float)
    lines = np.maximum(1, s["n_lines"]).astype(float)
    columns = [
        np.log(words),
        chars / words,
        s["n_symbols"] / chars,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words,
        words / lines,
        s["n_upper"] / chars,
        s["n_digits"] / chars,
        s["n_stops"] / words,
        s["n_distinct"] / words,
        np.log1p(s["max_word"]),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Boosted trees as arrays over all nodes; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of a good document for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                go_left = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(go_left, self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 5.0) -> Trees:
    """Gradient boosting on log loss with second-order leaf values and histogram splits."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    p0 = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p0 / (1 - p0)))
    raw = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + smooth), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        """A node over ``rows`` whose leaf values stay within [low, high]."""
        at = len(nodes)
        gs, hs = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, at, at, rate * leaf(gs, hs, low, high)])
        if level == depth or len(rows) < 20:
            return at
        best = None
        for j, e in enumerate(edges):
            if not len(e):
                continue
            g = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(e) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(e) + 1))[:-1]
            gain = g**2 / (h + smooth) + (gs - g) ** 2 / (hs - h + smooth)
            lv, rv = np.clip(g / (h + smooth), low, high), np.clip((gs - g) / (hs - h + smooth), low, high)
            allowed = (h > 1e-3) & (hs - h > 1e-3) & (monotone[j] * (rv - lv) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(gain.argmax())
            if np.isfinite(gain[k]) and gain[k] > gs**2 / (hs + smooth) + 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, lv[k], rv[k])
        if best is None:
            return at
        _, j, k, lv, rv = best
        middle = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}[monotone[j]]
        side = binned[rows, j] <= k
        left = grow(rows[side], level + 1, *bounds[0])
        right = grow(rows[~side], level + 1, *bounds[1])
        nodes[at][:4] = [j, edges[j][k], left, right]
        return at

    def flat(first_root: int) -> Trees:
        a = np.array(nodes, float).reshape(-1, 5)
        return Trees(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], np.array(roots[first_root:], int), depth, 0.0 if first_root else start)

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        raw += flat(len(roots) - 1).score(x) - (start if len(roots) == 1 else 0)
    return flat(0)


STATISTICS_DDL = "doc_id long, " + ", ".join(f"{k} long" for k in BASE + MORE)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of BASE and MORE for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, texts in pieces(batch.column(1)):
                s = statistics(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row:stop], *(pa.array(s[k]) for k in BASE + MORE)], ["doc_id", *BASE, *MORE])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, STATISTICS_DDL)


def train(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents, drawn by a hash of ``doc_id``.

    Labels without ``quality`` or ``doc_id`` are not used. Without any labelled
    document the trees are empty and every score is 0.
    """
    known = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    drawn = bounded_sample(known.where("doc_id is not null"), known.count(), ["doc_id", "quality"], sample_rows)
    sample = stats.join(drawn, "doc_id").orderBy(F.xxhash64("doc_id"), *BASE).limit(sample_rows).toPandas()
    x = features({k: sample[k].to_numpy() for k in BASE + MORE})
    return fit(x, sample["quality"].to_numpy(float), list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, least_probability: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): counts, ``base_failed``, ``score`` and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words lie in
    eight-word windows that occur twice or more in the text. ``kept`` is false
    then, else whether ``score``, the trees' probability of a good document,
    reaches ``least_probability``. A null text counts as empty, a null
    ``doc_id`` stays null, rows that repeat an id are judged row by row, other
    columns are not read and an empty table gives no rows.
    """
    stats = cut(document_statistics(docs), "statistics")
    model = train(stats, labels, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy() for k in BASE + MORE}
            failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            p = 1 / (1 + np.exp(-model.score(features(s))))
            kept = ~failed & (p >= least_probability)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in ["doc_id", *BASE]] + [pa.array(failed), pa.array(p), pa.array(kept)], ["doc_id", *BASE, "base_failed", "score", "kept"])

    ddl = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, score double, kept boolean"
    return map_arrow(stats, run, ddl)
