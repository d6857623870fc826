"""Edit-aware token counts: segment trees of pre-token runs, re-encoded only where edited.

A text is split into leaves at places where the vocabulary's own pattern always
starts a new pre-token: a single space between two characters that are no white
space. So the ids of a text are those of its leaves, one after the other. A
segment tree holds the token count of each leaf and of each subtree. An edit
re-encodes the leaves it touches, plus a neighbour where the edit destroys the
boundary between them, and updates the sums on the way to the root.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Characters of a leaf, at least (the last one may be shorter), and a leaf that is split again.
LEAF_CHARS, SPLIT_CHARS = 256, 1024
_CUT = re.compile(r"(?<=\S) (?=\S)")

_encodings: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """A byte-level BPE of a rank file, kept by the worker between tasks."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@dataclass(frozen=True)
class Edit:
    """Replace ``removed`` characters at ``at`` by ``inserted``."""

    at: int
    removed: int
    inserted: str


def split_leaves(text: str, least: int = LEAF_CHARS) -> list[str]:
    """Runs of at least ``least`` characters that end before a safe space."""
    leaves, start = [], 0
    while len(text) - start > least:
        found = _CUT.search(text, start + least)
        if not found:
            break
        leaves.append(text[start : found.start()])
        start = found.start()
    leaves.append(text[start:])
    return leaves


def _safe(left: str, right: str) -> bool:
    """Whether a pre-token always starts between these two texts."""
    return len(right) > 1 and right[0] == " " and not right[1].isspace() and bool(left) and not left[-1].isspace()


class CountedText:
    """A text with a segment tree of character and token counts."""

    def __init__(self, text: str, encode, leaf_chars: int = LEAF_CHARS, split_chars: int = SPLIT_CHARS):
        self.encode, self.leaf_chars, self.split_chars = encode, leaf_chars, split_chars
        #: Characters that edits have encoded anew so far.
        self.encoded_again = 0
        self._build(split_leaves(text, leaf_chars))

    def _build(self, leaves: list[str], counts: list[int] | None = None) -> None:
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.size - len(leaves))
        counts = counts if counts is not None else [len(self.encode(x)) for x in leaves]
        self.tokens = [0] * self.size + counts + [0] * (self.size - len(counts))
        self.chars = [0] * self.size + [len(x) for x in self.leaves]
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and the leaf's start."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _neighbour(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self.size:
            if self.leaves[leaf]:
                return leaf
            leaf += step
        return None

    def apply(self, edit: Edit) -> None:
        """One edit; positions beyond the text count as its end."""
        at = min(max(0, edit.at), self.length)
        end = min(at + max(0, edit.removed), self.length)
        first, start = self._find(at)
        last = self._find(end)[0] if end > at else first
        region = "".join(self.leaves[first : last + 1])
        region = region[: at - start] + edit.inserted + region[end - start :]
        before, after = self._neighbour(first, -1), self._neighbour(last, 1)
        while before is not None and not _safe(self.leaves[before], region):
            region, first = self.leaves[before] + region, before
            before = self._neighbour(first, -1)
        while after is not None and not _safe(region, self.leaves[after]):
            region, last = region + self.leaves[after], after
            after = self._neighbour(last, 1)
        self.encoded_again += len(region)
        parts = split_leaves(region, self.leaf_chars) if len(region) > self.split_chars else [region]
        counts = [len(self.encode(p)) for p in parts]
        room = last - first + 1
        if len(parts) > room:
            kept = [(x, self.tokens[self.size + i]) for i, x in enumerate(self.leaves) if x and not first <= i <= last]
            where = sum(1 for x in self.leaves[:first] if x)
            kept[where:where] = list(zip(parts, counts))
            self._build([x for x, _ in kept], [n for _, n in kept])
            return
        for i in range(room):
            self.leaves[first + i] = parts[i] if i < len(parts) else ""
            self.tokens[self.size + first + i] = counts[i] if i < len(parts) else 0
            self.chars[self.size + first + i] = len(self.leaves[first + i])
        lo, hi = self.size + first, self.size + last
        while lo > 1:
            lo, hi = lo // 2, hi // 2
            for i in range(lo, hi + 1):
                self._sum(i)


def sample_edits(text: str) -> list[Edit]:
    """An insertion, a replacement and a removal whose places follow from the text alone."""
    n, h = len(text), zlib.crc32(text.encode("utf-8", "surrogatepass"))
    place = lambda k: (h * (2 * k + 1) >> 3) % (n + 1)
    return [Edit(place(0), 0, " an inserted note"), Edit(place(1), 7, "swap"), Edit(place(2), 40, "")]


def count_edited(docs: DataFrame, edits=sample_edits, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after, chars_encoded_again`` for every row of ``docs``.

    ``edits`` is a function from a text to its edits; ``ranks`` names a rank file
    of the installed public vocabularies. A null text counts as empty, a null
    ``doc_id`` stays null, repeated rows are counted each, other columns are not
    read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoding(public_tokenizers.path(ranks), public_tokenizers.PATTERN).encode_ordinary
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                counted = CountedText(text, encode)
                before, todo = counted.count, edits(text)
                for edit in todo:
                    counted.apply(edit)
                rows.append((before, len(todo), counted.count, counted.length, counted.encoded_again))
            columns = list(zip(*rows)) or [()] * 5
            names = ["n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "chars_encoded_again"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    ddl = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, chars_encoded_again long"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, ddl)
