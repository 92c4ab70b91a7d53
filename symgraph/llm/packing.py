"""Operator 1: harmonic packing of token sequences.

The class of a piece of n tokens is k = floor(capacity / n): its bins take exactly k pieces, all of
that class.  Each task fills the bins of its own rows and talks to no other, so nothing is shuffled,
and at most ``capacity`` tokens wait in a class.  Of a document the whole capacities are pieces of
class 1 that fill their bins; what is left is one whole piece of its class.

k pieces of class k leave a slack below capacity / (k + 1) tokens on average.  It is filled by
cutting: a task keeps a stock of a little over ``capacity`` tokens, made of the next pieces whenever
it runs low, and a bin that has its k pieces takes its slack from the stock's front.  Only pieces that
went to the stock are cut.  At the end of a task what waits in its classes and the stock are laid end
to end; so each task pads one sequence, its last.

Defined results: null text counts as empty; an empty document is the end id alone; repeated rows
are packed once each; an empty table gives an empty result; other columns of the input are ignored,
so their names cannot clash; a null id stays null, ids of any type keep it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, table

CAPACITY = 1024
END_ID = 0
#: Tokens that a task collects before it hands rows on, and characters of words whose ids a worker remembers.
HELD, REMEMBERED = 500_000, 3_000_000
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
#: Characters for which Python's classes, with the corrections below, are those of the public split pattern.
_OTHER = re.compile(r"[^\x00-\x1b\x20-ɏ]")
_FRACTIONS = "²³¹¼-¾"
_SIMPLE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_{_FRACTIONS}]+| ?[\d{_FRACTIONS}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_encoders: dict = {}


class ByteBPE:
    """text -> ids (unsigned 32-bit little-endian) of a byte-level vocabulary file of the tokenizers library.

    The library's own model encodes every distinct word once; what the library does for a whole text
    beyond that (splitting into words, byte characters, special tokens) is done here, many times faster.
    """

    def __init__(self, file: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(file)
        self.model, self.known, self.size = whole.model, {}, 0
        self.full = regex.compile(public_tokenizers.PATTERN)
        special = {t.content: np.array([i], "<u4").tobytes() for i, t in whole.get_added_tokens_decoder().items()}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        self.chars = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}

    def __call__(self, text: str) -> bytes:
        if self.split is not None and any(t in text for t in self.special):  # recognised inside texts, as the library does
            return b"".join(self.special.get(part) or self._plain(part) for part in self.split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = (self.full if _OTHER.search(text) else _SIMPLE).findall(text)
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if self.size > REMEMBERED:
                self.known.clear()
                self.size = 0
            for w in set(words).difference(self.known):
                self.size += len(w)
                mapped = w.encode("utf-8", "replace").decode("latin-1").translate(self.chars)
                self.known[w] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            return b"".join(map(self.known.__getitem__, words))


def _byte_bpe(file: str) -> ByteBPE:
    """One per worker process."""
    if file not in _encoders:
        _encoders[file] = ByteBPE(file)
    return _encoders[file]


class Bins:
    """The open bins of one task.  Pieces are (id, start, length, document's length, ids)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.waiting: dict[int, list[tuple]] = {}
        self.stock: deque[tuple] = deque()
        self.stocked = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        """Takes a document; gives the rows of the bins that it closes."""
        total, out = len(ids) // 4, []
        for start in range(0, total, self.capacity):
            piece = (doc_id, start, min(self.capacity, total - start), total, ids[4 * start : 4 * (start + self.capacity)])
            if self.stocked < self.capacity:
                self.stock.append(piece)
                self.stocked += piece[2]
                continue
            k = self.capacity // piece[2]
            waiting = self.waiting.setdefault(k, [])
            waiting.append(piece)
            if len(waiting) == k:
                out += self._sequence(waiting)
                waiting.clear()
        return out

    def _sequence(self, pieces: list[tuple]) -> list[tuple]:
        """The pieces in a new sequence, then as much of the stock as has room."""
        out, at = [], 0
        for piece in pieces:
            out.append((*piece, self.next_id, at))
            at += piece[2]
        while at < self.capacity and self.stock:
            doc_id, start, length, total, ids = self.stock.popleft()
            n = min(length, self.capacity - at)
            out.append((doc_id, start, n, total, ids[: 4 * n], self.next_id, at))
            if n < length:
                self.stock.appendleft((doc_id, start + n, length - n, total, ids[4 * n :]))
            at += n
            self.stocked -= n
        self.next_id += 1
        return out

    def rest(self) -> Iterator[tuple]:
        """What waits, largest pieces first, behind the stock."""
        for k in sorted(self.waiting):
            for piece in self.waiting[k]:
                self.stock.append(piece)
                self.stocked += piece[2]
        while self.stock:
            yield from self._sequence([])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise and pack ``docs``; one row per piece with its place and its ids.

    ``vocabulary`` is a byte-level file of the tokenizers library.  Columns: doc_id, start, length,
    doc_tokens, sequence_id, offset, ids (unsigned 32-bit little-endian).  sequence_id is unique over
    the table.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _byte_bpe(vocabulary)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        held = 0  # tokens of the rows that were not handed on yet
        for batch in batches:
            for doc_id, text in zip(batch["i"], batch["t"]):
                ids = encode(text or "") + end
                rows += bins.add(doc_id, ids)
                held += len(ids) // 4
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=COLUMNS)
        yield pd.DataFrame(list(bins.rest()), columns=COLUMNS)

    return docs.select(exact_col(id_col).cast("string").alias("i"), exact_col(text_col).alias("t")).mapInPandas(
        run, "doc_id string, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 byte-level tokens."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
