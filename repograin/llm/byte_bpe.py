"""Byte-level BPE as a tree reduction.

Encoding a text is a monoid: halves are encoded on their own and neighbours are
joined by encoding a window around the seam again, which grows until the tokens
outside it provably stay. This is done twice. A text is cut into words by the
vocabulary's pattern: matches that end at least two code points before a seam
cannot change, and once a new match begins where an old one of the right half
began, all later ones are equal. A word is cut into tokens by merges: a run of
tokens is the encoding of its bytes if and only if every two neighbours are the
encoding of theirs, so only the two pairs at the window's ends need a look.
Decoding joins the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from repograin.llm.store import made_columns

LEAF_TEXT = 4_096  # code points that are matched at once
LEAF_WORD = 16  # bytes that are merged at once
LEAF_IDS = 4_096  # tokens that are decoded at once
LEAF_WINDOW = 64  # bytes from which on merges are looked up in a heap
KNOWN_WORDS = 150_000  # encodings a worker remembers before it lets go of the older ones
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value: the split of this vocabulary

_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Known(dict):
    """Encodings by word; one that is not there is made by ``make``."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> tuple[int, ...]:
        return self.make(word)


class Vocabulary:
    """Ranks of a byte-level vocabulary, and the encodings of words met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pair_ranks = [[ranks.get(bytes((a, b)), _NEVER) for b in range(256)] for a in range(256)]
        self.pattern = regex.compile(pattern)
        self.known, self.older = _Known(self.word), _Known(self.word)
        self.most: int | None = None  # words to remember, where others need the memory; else KNOWN_WORDS
        self.stays = lru_cache(50_000)(self._stays)

    # words ------------------------------------------------------------------

    def _leaf(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, the first of equals, until none can merge."""
        if len(data) > LEAF_WINDOW:
            return self._heap(data)
        get, pairs = self.ranks.get, [self.pair_ranks[a][b] for a, b in pairwise(data)]
        ends = list(range(len(data) + 1))  # where tokens begin and end
        while pairs and (best := min(pairs)) != _NEVER:
            i = pairs.index(best)
            del pairs[i], ends[i + 1]
            if i < len(pairs):
                pairs[i] = get(data[ends[i] : ends[i + 2]], _NEVER)
            if i:
                pairs[i - 1] = get(data[ends[i - 1] : ends[i + 1]], _NEVER)
        return [self.ranks[data[a:b]] for a, b in pairwise(ends)]

    def _heap(self, data: bytes) -> list[int]:
        """The same for long windows, with a heap of pairs and linked parts."""
        get, n = self.ranks.get, len(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or get(parts[i] + parts[j]) != rank:
                continue  # one of the two has changed since
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (new := get(parts[i] + parts[after[j]])) is not None:
                    heappush(heap, (new, i))
            if before[i] >= 0 and (new := get(parts[before[i]] + parts[i])) is not None:
                heappush(heap, (new, before[i]))
        return [self.ranks[p] for p in parts if p is not None]

    def _stays(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self._leaf(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def _merge(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes."""
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of the window at either side of the seam
        while True:
            inner = self._leaf(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            left_stays = i == len(left) or self.stays(left[len(left) - i - 1], inner[0])
            right_stays = j == len(right) or self.stays(inner[-1], right[j])
            if left_stays and right_stays:
                return left[: len(left) - i] + inner + right[j:]
            i = i if left_stays else min(len(left), 2 * i)
            j = j if right_stays else min(len(right), 2 * j)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_WORD:
            return self._leaf(data)
        half = len(data) // 2
        return self._merge(self._tree(data[:half]), self._tree(data[half:]))

    def word(self, word: str) -> tuple[int, ...]:
        """Tokens of one match of the pattern; a match that is a token is that token."""
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            data = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else tuple(self._tree(data))
        if len(self.known) >= (self.most or KNOWN_WORDS):
            self.known, self.older = _Known(self.word), self.known
        if len(word) <= 64:
            self.known[word] = found
        return found

    # texts ------------------------------------------------------------------

    def _join_words(self, left: list[str], right: list[str]) -> list[str]:
        """Matches of the joined text: match anew from the last safe place of the left until a match of the right begins at the same place."""
        if not left or not right:
            return left + right
        tail = []
        while left and (len(tail) < 2 or sum(map(len, tail)) < 2):
            tail.append(left.pop())
        window, taken = "".join(reversed(tail)), 0
        seam, start, found = len(window), 0, []
        ends = {seam: 0}  # beginnings of the right half's matches inside the window -> how many lie before
        while True:
            grown = 2 if not taken else taken
            for word in right[taken : taken + grown]:
                window += word
                taken += 1
                ends[len(window)] = taken
            last = taken == len(right)
            for match in self.pattern.finditer(window, start):
                if not last and match.end() > len(window) - 2:
                    break  # what follows may change this match
                found.append(match.group())
                start = match.end()
                if start >= seam and start in ends:
                    return left + found + right[ends[start] :]
            if last:
                return left + found

    def words(self, text: str) -> list[str]:
        """All matches of the pattern, in order; together they are the text."""
        if len(text) <= LEAF_TEXT:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self._join_words(self.words(text[:half]), self.words(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.known.__getitem__, self.words(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def _vocabulary(path: str, changed: float) -> Vocabulary:
    return Vocabulary(read_ranks(path))


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    return _vocabulary(path, os.path.getmtime(path))


def _ids(own: Vocabulary, texts: list) -> pa.Array:
    parts = [own.encode(t if t is not None else "") for t in texts]
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)])))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``: token ids as ``array<int>``; a null text has none. ``path``: a rank file that every machine has."""
    return made_columns(df, text, {out: "array<int>"}, lambda texts: [_ids(vocabulary(path), texts)])


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes of the token ids; null ids give none. An id outside the vocabulary is an error."""

    def run(lists: list) -> list[pa.Array]:
        own = vocabulary(path)
        return [pa.array([own.decode(np.asarray(i or [], np.int32)) for i in lists], pa.binary())]

    return made_columns(df, ids, {out: "binary"}, run)


def recode(df: DataFrame, path: str, text: str = "text", known: int | None = None) -> DataFrame:
    """``df`` without its text, with ``ids`` and ``decoded``, both from one pass over the texts.

    A null text counts as empty. Columns of ``df`` named ``ids`` or ``decoded`` are replaced. ``known``: words a worker remembers, which bears on memory and speed only.
    """

    def run(texts: list) -> list[pa.Array]:
        own = vocabulary(path)
        own.most = known
        ids = _ids(own, texts)
        return [ids, pa.array([own.decode(i.values.to_numpy()) for i in ids], pa.binary())]

    return made_columns(df, text, {"ids": "array<int>", "decoded": "binary"}, run, keep_source=False)
