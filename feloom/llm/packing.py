"""Hierarchical multi-length packing of tokenised documents.

Every task packs its own documents, so nothing is shuffled. A task

1. tokenises documents and gathers them until ``pool_tokens`` ids wait;
2. routes each to the tier (context size) that fits its length;
3. packs the tiers from the longest down: whole documents first, the gap that
   remains in a window is filled with whole documents of shorter tiers, and only
   what no whole document fits is closed with the head of the next one (its rest
   waits for the next window);
4. at its end cuts what is left into windows whose lengths are powers of two, so
   no window is padded.

Sequences of one tier form step groups of ``step_tokens`` ids each: a step holds
more short sequences or fewer long ones, but the same number of ids.

Each id of a document lies in exactly one piece. A document without text is the
end id alone. Rows that repeat a ``doc_id`` are packed as documents of their own.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_arrow
from .textarrays import pieces

TIERS = (4096, 2048, 1024, 512)
END_ID = 2
#: Ids that wait in a task before they are packed, and ids of a step group.
POOL_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
#: Words whose ids a worker remembers.
CACHE_WORDS = 400_000

#: Texts of these characters only are split here, by the vocabulary's own rule.
_PLAIN = re.compile(r"[\t-\r -~\xdf-\xf6\xf8-\xff]*\Z")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")


class WordEncoder:
    """Ids by a ``tokenizers`` file that lower-cases and drops white space.

    Its words are encoded independently of each other, so their ids are kept. A
    text with other characters than ASCII and Latin-1 letters, or with the
    string of a special token, goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        if word.isascii():
            tokens = self.model.tokenize(word)
        else:
            tokens = self.model.tokenize("".join(map(self.byte_char.__getitem__, word.encode())))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        lowered = text.lower()
        if not _PLAIN.match(lowered) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array([*ids, END_ID], "<u4")
        words = _SPLIT.findall(lowered)
        known = self.known
        try:
            out = b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.word(w)
            out = b"".join(map(known.__getitem__, words))
        return np.frombuffer(out + END_ID.to_bytes(4, "little"), "<u4")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Document:
    __slots__ = ("doc_id", "ids", "at")

    def __init__(self, doc_id, ids: np.ndarray):
        self.doc_id, self.ids, self.at = doc_id, ids, 0

    def left(self) -> int:
        return len(self.ids) - self.at


class Packer:
    """Packs the documents of one task; ``rows`` gathers the pieces."""

    def __init__(self, first_sequence: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.wait: dict[int, deque[Document]] = {t: deque() for t in self.tiers}
        self.tokens = 0
        self.next_sequence, self.step_tokens = first_sequence, step_tokens
        self.first_sequence = first_sequence
        self.made = dict.fromkeys(self.tiers, 0)
        self.steps: dict[tuple[int, int], int] = {}
        self.rows: list[tuple] = []

    def add(self, doc: Document) -> None:
        self.tokens += doc.left()
        self.wait[self.route(doc.left())].append(doc)

    def route(self, length: int) -> int:
        """The shortest tier that holds the length, the longest one beyond that."""
        return next((t for t in reversed(self.tiers) if length <= t), self.tiers[0])

    def _next(self, tier: int, room: int) -> Document | None:
        """A whole document for a gap: from this tier, else from the longest shorter tier that has one that fits."""
        for t in self.tiers:
            if t > tier and tier in self.wait:
                continue
            queue = self.wait[t]
            for i in range(min(len(queue), 8)):
                if queue[i].left() <= room:
                    doc = queue[i]
                    del queue[i]
                    return doc
        return None

    def _any(self) -> Document | None:
        for t in reversed(self.tiers):
            if self.wait[t]:
                return self.wait[t].popleft()
        return None

    def window(self, size: int, tier: int) -> None:
        """One sequence of exactly ``size`` ids; enough ids must wait."""
        sequence, offset = self.next_sequence, 0
        self.next_sequence += 1
        step = self._step(tier)
        while offset < size:
            room = size - offset
            long = self.wait[self.tiers[0]]
            if tier == self.tiers[0] and long and offset == 0 and long[0].left() > room:
                doc = long.popleft()
            else:
                doc = self._next(tier, room) or self._longer(tier) or self._any()
            take = min(room, doc.left())
            ids = doc.ids[doc.at : doc.at + take]
            self.rows.append((doc.doc_id, doc.at, take, crc32(ids.tobytes()), len(doc.ids), sequence, offset, size, step))
            doc.at += take
            offset += take
            self.tokens -= take
            if doc.left():
                self.wait[self.route(doc.left())].appendleft(doc)

    def _longer(self, tier: int) -> Document | None:
        """The head of this tier's queue, cut to close a gap."""
        return self.wait[tier].popleft() if self.wait.get(tier) else None

    def _step(self, tier: int) -> int:
        per_step = max(1, self.step_tokens // tier)
        key = (tier, self.made.setdefault(tier, 0) // per_step)
        self.made[tier] += 1
        return self.steps.setdefault(key, self.first_sequence + len(self.steps))

    def pack(self, reserve: int) -> None:
        """Fill windows while more than ``reserve`` ids wait."""
        for tier in self.tiers:
            while self.wait[tier] and sum(d.left() for d in self.wait[tier]) >= tier and self.tokens - tier >= reserve:
                self.window(tier, tier)
        while self.tokens - self.tiers[0] >= reserve:
            self.window(self.tiers[0], self.tiers[0])

    def finish(self) -> None:
        """Windows for all that is left, their lengths powers of two."""
        self.pack(0)
        while self.tokens:
            size = min(self.tiers[0], 1 << (self.tokens.bit_length() - 1))
            self.window(size, size)

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("tier", pa.int64()),
        ("step_id", pa.int64()),
    ]
)
PIECES_DDL = ", ".join(f"{f.name} long" for f in PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in PIECES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", tiers=TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of each document of ``docs`` (``doc_id``, ``text``).

    ``tokenizer`` names a file of the installed public vocabularies, or is a
    path. Ids per sequence never exceed the longest tier; no sequence needs
    padding beyond a power of two. A null text is empty, a null ``doc_id`` stays
    null, an empty table gives no rows, other columns are not read.
    """
    tiers = tuple(tiers)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        encode = encoder(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer)).encode
        packer = Packer(TaskContext.get().partitionId() << 33, tiers, step_tokens)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, stop, _ in pieces(batch.column(1)):
                for doc_id, text in zip(ids[row:stop], batch.column(1)[row:stop].to_pylist()):
                    packer.add(Document(doc_id, encode(text or "")))
                    if packer.tokens > pool_tokens:
                        packer.pack(pool_tokens // 2)
                        yield _batch(packer.taken())
        packer.finish()
        yield _batch(packer.taken())

    return map_arrow(docs.select("doc_id", "text"), packed, PIECES_DDL)
