"""Operator 3: encoding and decoding with a word-level BPE vocabulary, speculate and verify.

A text is normalised and split into words.  For every word that a task has not met yet, greedy
longest match *proposes* tokens.  A proposal is right exactly when every token in it is the
encoding of its own string and every adjacent pair of tokens is compatible, that is: undoing the
merges on both sides of the border, latest first, never shows a merge across the border that would
have come earlier.  These pair tests run on arrays, for all new pairs of a batch of words at once.
Only words with a failing pair are merged exactly, one merge after the other.

Defined results: null text counts as empty (no ids, empty decoded text); repeated rows give
repeated results; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact_col, table

_LETTERS, _NUMBERS, _SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t\n\x0b\x0c\r "
#: Contractions, letters, single numbers, the rest: the split rule for lower-cased text of Latin-1 letters.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
#: Characters for which the tokenizers library's own normaliser and splitter are asked.
_RARE = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-\xff]")
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CHUNKS = re.compile(f"[^{_WHITE}]+")
_SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_END = "</w>"
#: Marks the end of a word inside this module: one character instead of four.
_STOP = chr(0xE000)
#: Words that one worker process remembers (about 250 bytes each), and characters split at a time.
REMEMBERED, CHUNK = 400_000, 1_000_000


def byte_letters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


_LETTER = byte_letters()


def as_letters(word: str) -> str:
    return word if word.isascii() and word.isprintable() else "".join([_LETTER[b] for b in word.encode()])


def words_of(text: str) -> list[str]:
    """Words of a text; chunks that need the library's rules come whole, behind a leading blank."""
    if not _RARE.search(text) and "<|" not in text:
        return _WORDS.findall(text.lower())
    out: list[str] = []
    for chunk in _CHUNKS.findall(text):
        if _RARE.search(chunk) or "<|" in chunk:
            out.append(" " + chunk)
        else:
            out += _WORDS.findall(chunk.lower())
    return out


class Vocabulary:
    """Merges of a word-level BPE file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = model["vocab"]
        self.tokens = [""] * self.library.get_vocab_size()
        for name, i in names.items():
            self.tokens[i] = name
        self.specials = {}
        for name in _SPECIALS:
            if (i := self.library.token_to_id(name)) is not None:
                self.tokens[i] = name
                self.specials[name] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = len(self.tokens)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        pairs = np.zeros((len(merges), 3), np.int64)
        for k, (a, b) in enumerate(merges):
            t = names[a + b]
            pairs[k] = names[a], names[b], t
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = names[a], names[b], k
        key = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(key, kind="stable")
        self.keys, self.made, self.key_rank = key[order], pairs[order, 2], order
        self.merge = {(int(a), int(b)): (k, int(t)) for k, (a, b, t) in reversed(list(enumerate(pairs)))}
        self._find_own()
        inner = {(n[: -len(_END)] + _STOP if n.endswith(_END) and len(n) > len(_END) else n): i for n, i in names.items()}
        self.base = {s: i for s, i in inner.items() if self.rank[i] < 0}
        self.spelled = {s: i for s, i in inner.items() if self.own[i]}
        self.longest = max(map(len, self.spelled))
        self.checked = np.zeros(0, np.int64)  # keys of pairs that were tested, sorted, and what came out
        self.passed = np.zeros(0, bool)

    def _find_own(self) -> None:
        """own[t]: the encoding of t's string is t itself."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(len(self.tokens), bool)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            good[t] &= good[self.left[t]] and good[self.right[t]]
        self.own = good

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge earlier than ``before`` crosses the border between the tokens a and b.

        Walks back in time: ``before`` is the first merge not done yet, (a, b) are the tokens at
        the border just then.  Of equal merges the left one is done first.
        """
        a, b = a.copy(), b.copy()
        before = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            crosses = self._rank_of(x, y) < before[live]
            good[live[crosses]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crosses & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            before[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def pairs_pass(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(a, b), testing only pairs that no earlier batch has tested."""
        key, at = np.unique(a << 32 | b, return_inverse=True)
        known = np.isin(key, self.checked, assume_unique=True)
        if not known.all():
            new = key[~known]
            passed = self.compatible(new >> 32, new & 0xFFFFFFFF)
            if len(self.checked) > 4_000_000:
                self.checked, self.passed = self.checked[:0], self.passed[:0]
                return self.compatible(key >> 32, key & 0xFFFFFFFF)[at]
            both = np.concatenate([self.checked, new])
            order = np.argsort(both, kind="stable")
            self.checked, self.passed = both[order], np.concatenate([self.passed, passed])[order]
        return self.passed[np.searchsorted(self.checked, key)][at]

    def propose(self, spelled: str) -> list[int]:
        """Greedy longest match over the tokens that encode to themselves."""
        out, i, n, known = [], 0, len(spelled), self.spelled
        while i < n:
            j = min(n, i + self.longest)
            while j == n - 1 or (t := known.get(spelled[i:j])) is None:  # the end mark never stands alone
                j -= 1
            out.append(t)
            i = j
        return out

    def merge_exactly(self, spelled: str) -> list[int]:
        """All merges in order of rank, leftmost first (a heap over a linked list)."""
        ids = [self.base[s] for s in ([*spelled[:-2], spelled[-2:]] if spelled.endswith(_STOP) else spelled)]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := self.merge.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (*m, p, ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def encode_words(self, spelled: list[str]) -> list[list[int]]:
        """Ids of words given as byte letters: proposed, verified, and merged where that fails."""
        proposed = [self.propose(s + _STOP) for s in spelled]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(sizes)), sizes)
            same = np.flatnonzero(word[1:] == word[:-1])
            failed = same[~self.pairs_pass(flat[same], flat[same + 1])]
            for k in np.unique(word[failed]).tolist():
                proposed[k] = self.merge_exactly(spelled[k] + _STOP)
        return proposed

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Ids of white-space-free chunks of any characters, with special tokens recognised."""
        out = []
        for chunk in chunks:
            ids: list[int] = []
            for part in re.split("(" + "|".join(map(re.escape, self.specials)) + ")", chunk) if self.specials else [chunk]:
                if part in self.specials:
                    ids.append(self.specials[part])
                elif part:
                    words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                    ids += [t for word in self.encode_words(words) for t in word]
            out.append(ids)
        return out


class WordEncoder:
    """Texts -> ids as bytes, remembering the words of earlier batches up to a bound."""

    def __init__(self, words: Callable[[list[str]], list[list[int]]], chunks: Callable[[list[str]], list[list[int]]], width: str = "<u4"):
        self.words, self.chunks, self.width, self.known = words, chunks, width, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        split = [words_of(t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*split)
        for encode, group in ((self.words, [w for w in new if w[0] != " "]), (self.chunks, [w for w in new if w[0] == " "])):
            keys = [as_letters(w) if w[0] != " " else w[1:] for w in group]
            for i in range(0, len(group), 50_000):
                found = encode(keys[i : i + 50_000])
                sizes = [len(ids) for ids in found]
                data = np.fromiter((t for ids in found for t in ids), self.width, sum(sizes)).tobytes()
                at, wide = 0, np.dtype(self.width).itemsize
                for word, n in zip(group[i : i + 50_000], sizes):
                    self.known[word] = data[at : at + n * wide]
                    at += n * wide
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def vocabulary_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


def slices(batch: pd.DataFrame, text_col: str) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about CHUNK characters each (one row at least)."""
    sizes = batch[text_col].str.len().fillna(0).to_numpy(np.int64)
    part = np.cumsum(sizes) // CHUNK
    starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(batch))
    for a, b in zip(starts[:-1], starts[1:]):
        yield batch.iloc[a:b]


@lru_cache
def token_strings(path: str) -> list[str]:
    """The string of each id, special tokens included."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    out = [""] * (max(found.values()) + 1)
    for name, i in found.items():
        out[i] = name
    return out


def decoded(ids: bytes, strings: list[str]) -> str:
    return " ".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (unsigned 32-bit little-endian) of every whole text."""
    path = vocabulary_path(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = vocabulary(path)
        texts = WordEncoder(own.encode_words, own.encode_chunks)
        for batch in batches:
            for part in slices(batch, "t"):
                yield pd.DataFrame({"doc_id": part["i"], "ids": texts(part["t"].tolist())})

    return docs.select(exact_col(id_col).cast("string").alias("i"), exact_col(text_col).alias("t")).mapInPandas(run, "doc_id string, ids binary").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def decode(ids: F.Column, path: str | None = None) -> F.Column:
    """The text of a column of ids: the tokens' strings with blanks between, special tokens kept."""
    path = vocabulary_path(path)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings = token_strings(path)
        for batch in batches:
            yield pd.Series([decoded(b, strings) for b in batch], dtype=object)

    return run(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids and their decoded text, in one pass through one Python process a task."""
    path = vocabulary_path(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, strings = vocabulary(path), token_strings(path)
        texts = WordEncoder(own.encode_words, own.encode_chunks)
        for batch in batches:
            for part in slices(batch, "t"):
                ids = texts(part["t"].tolist())
                yield pd.DataFrame({"doc_id": part["i"], "ids": ids, "decoded": pd.Series([decoded(b, strings) for b in ids], dtype=object, index=part.index)})

    return docs.select(exact_col(id_col).cast("string").alias("i"), exact_col(text_col).alias("t")).mapInPandas(run, "doc_id string, ids binary, decoded string").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op3_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
