"""Cost-balanced packing of documents into token sequences of one length.

A document's ids are cut into pieces of at most one sequence. Pieces are dealt
to groups of about ``GROUP_TOKENS`` tokens by a hash of their number, and each
group is packed by itself: a piece costs ``n + n * n / RATIO`` (the linear part
of a layer, and attention), and the pieces, longest first, go to the sequence
of the lowest cost that still has room for them. A piece that fits nowhere is
cut where the most room is left, and its rest waits for its turn.

A group's sequences have exactly as much room as its pieces have tokens: full
sequences, and for what is over one sequence for each binary digit of the rest,
as a sequence is not padded at a power of two. So nothing is padded at all if
``room`` is a power of two.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from repograin.llm.store import saved

ROOM = 4096  # tokens of a sequence
END = 2  # the id after each document
RATIO = 6 * 1024  # tokens at which attention costs as much as the linear part, for layers 1,024 wide
GROUP_TOKENS = 1 << 20  # packed in one task; small enough for a worker, and 256 sequences leave much choice
GROUP_PIECES = 1 << 16  # the same for very short pieces
STRIDE = 1 << 20  # sequence numbers of a group
SLICE_BYTES = 8 << 20  # text that lies unpacked in a worker, unless a single one is longer
CACHED_PIECES = 1 << 18  # word pieces whose ids a worker keeps, and those of one slice more

# How the vocabulary file's own pattern divides words of these characters, in lower case.
PLAIN_WORD = "^[!-~À-ÖØ-öø-ÿ]+$"
PLAIN_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
BETWEEN = "\x01"  # stands between other words that are encoded together; it is a token of its own


class WordCoder:
    """Ids of whole texts, by way of their distinct words.

    For tokenizers that lower-case and drop white space, so that a text's ids
    are those of its words one after the other; others are refused. Words of
    plain characters are divided here and their pieces given to the library's
    model, other words go through the whole library. The texts of special
    tokens are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}
        self.pieces: dict[str, bytes] = {}
        (self.between,) = self._whole(BETWEEN)
        probe = "Don't we'LL  x1\t2\n<|endoftext|> naïve ÄÖ,...ß × İstanbul 汉字 (a'b''s) \x01z é"
        if self.encode(pa.array([probe]))[0].tolist() != self._whole(probe):
            raise ValueError(f"{path}: a text's ids are not those of its words")

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of the words one after the other, and how many each has."""
        found = PLAIN_PIECES.findall("\n".join(words).lower())
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        known, tokenize, code = self.pieces, self.model.tokenize, self.code
        known["\n"] = b""
        for piece in set(found).difference(known):
            known[piece] = array(code, [t.id for t in tokenize(piece if piece.isascii() else piece.translate(self.letters))]).tobytes()
        runs = list(map(known.__getitem__, found))
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // self.kind.itemsize
        last = np.append(np.flatnonzero(sizes == 0), len(sizes))[: len(words)]  # only the separator has no id
        return b"".join(runs), np.diff(np.append(0, np.cumsum(sizes))[last], prepend=0)

    def _other(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The same for words of any characters."""
        runs = []
        for at in range(0, len(words), 4096):
            part = [w for w in words[at : at + 4096] if BETWEEN not in w]
            ids = np.array(self._whole(f" {BETWEEN} ".join(part)), self.kind)
            split = iter(np.split(ids, np.flatnonzero(ids == self.between)))
            for word in words[at : at + 4096]:
                run = np.array(self._whole(word), self.kind) if BETWEEN in word else next(split)
                runs.append((run if BETWEEN in word else run[run != self.between]).tobytes())
        return b"".join(runs), np.fromiter(map(len, runs), np.int64, len(runs)) // self.kind.itemsize

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more than there are texts); null has none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, places = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(words, PLAIN_WORD)
        ids, sizes = self._plain(words.filter(plain).to_pylist())
        other_ids, other_sizes = self._other(words.filter(pc.invert(plain)).to_pylist())
        flat = np.frombuffer(ids + other_ids, self.kind)
        is_plain = plain.to_numpy(zero_copy_only=False)
        size, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        size[is_plain], size[~is_plain] = sizes, other_sizes
        first[is_plain], first[~is_plain] = np.cumsum(sizes) - sizes, sizes.sum() + np.cumsum(other_sizes) - other_sizes
        n = size[places]
        ends = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(first[places] - ends[:-1], n) + np.arange(ends[-1])], ends[split.offsets.to_numpy()]


@functools.lru_cache(maxsize=4)
def coder(path: str) -> WordCoder:
    """One per worker, so that its words stay known from task to task."""
    return WordCoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``SLICE_BYTES`` of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    low, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > SLICE_BYTES:
            yield low, i
            low, held = i, 0
        held += size + 64
    if len(sizes) > low:
        yield low, len(sizes)


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = ROOM, end: int = END) -> DataFrame:
    """``key, start, length, doc_tokens, ids, piece``: each document's ids and ``end``, cut every ``room`` ids; saved.

    ``ids`` are little-endian, of two bytes each (four for vocabularies over 65,536).
    """
    schema = StructType([StructField("key", docs.schema[key].dataType)] + [StructField(n, LongType()) for n in ("start", "length", "doc_tokens")])
    schema = schema.add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path)
        for batch in batches:
            texts = batch.column(1)
            for low, high in _slices(texts):
                ids, begin = words.encode(texts.slice(low, high - low))
                count = high - low
                full = np.insert(ids, begin[1:], end)
                tokens = np.diff(begin) + 1
                cut = -(-tokens // room)
                doc = np.repeat(np.arange(count), cut)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cut) - cut, cut)) * room
                length = np.minimum(tokens[doc] - start, room)
                offsets = np.concatenate([[0], np.cumsum(length)]) * words.kind.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(full.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, count).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]), held], schema.names)

    cut = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return saved(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def capacities(total: int, room: int) -> list[int]:
    """Sequences with room for exactly ``total`` tokens: full ones, then powers of two (or one more, if ``room`` is none)."""
    full, rest = divmod(total, room)
    if room & (room - 1):
        return [room] * full + [rest] * (rest > 0)
    return [room] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def lay_out(lengths: list[int], room: int = ROOM, ratio: float = RATIO) -> list[tuple[int, int, int, int, int]]:
    """``(piece, start, length, sequence, offset)`` for pieces in a fixed order: longest first, to the lowest cost that has room."""
    caps = np.array(capacities(sum(lengths), room), np.int64)
    left, cost = caps.copy(), np.zeros(len(caps))
    waiting = [(-n, i, 0) for i, n in enumerate(lengths)]
    heapq.heapify(waiting)
    out = []
    while waiting:
        n, i, start = heapq.heappop(waiting)
        n = -n
        fits = left >= n
        if not fits.any():  # cut where most room is left
            fits = left == left.max()
        at = int(np.where(fits, cost, np.inf).argmin())
        taken = min(n, int(left[at]))
        out.append((i, start, taken, at, int(caps[at] - left[at])))
        left[at] -= taken
        cost[at] += taken + taken * taken / ratio
        if taken < n:
            heapq.heappush(waiting, (taken - n, i, start + taken))
    return out


def placements(pieces: DataFrame, room: int = ROOM, ratio: float = RATIO, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """``piece, skip, taken, sequence_id, offset``: where the tokens of each piece from ``skip`` on lie; only lengths travel."""
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, math.ceil(tokens / group_tokens), math.ceil(n / GROUP_PIECES))

    def pack(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece")
        rows = np.array(lay_out(part["length"].tolist(), room, ratio), np.int64).reshape(-1, 5)
        return pd.DataFrame({
            "piece": part["piece"].to_numpy()[rows[:, 0]], "skip": rows[:, 1], "taken": rows[:, 2], "sequence_id": int(group[0]) * STRIDE + rows[:, 3], "offset": rows[:, 4]})

    dealt = pieces.select("piece", "length", F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group"))
    return dealt.groupBy("group").applyInPandas(pack, "piece long, skip long, taken long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", room: int = ROOM, end: int = END, ratio: float = RATIO, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: ``key, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian, two bytes an id, or four).

    The ids of a sequence are those of its rows by ``offset``. Each row of
    ``docs`` is a document of its own, repeated and null keys included; a null
    or empty text has only the id ``end``; a text of any length is cut into as
    many pieces as it needs; an empty table gives no rows. No other column is
    read, so none can clash.
    """
    pieces = token_pieces(docs, path, key, text, room, end)
    placed = placements(pieces, room, ratio, group_tokens)
    width = coder(path).kind.itemsize
    return pieces.join(placed, "piece").select(
        F.col("key").alias(key), (F.col("start") + F.col("skip")).alias("start"), F.col("taken").alias("length"), "doc_tokens", "sequence_id", "offset",
        F.substring("ids", (F.col("skip") * width + 1).cast("int"), (F.col("taken") * width).cast("int")).alias("ids"))


def with_crc32(packed: DataFrame, path: str) -> DataFrame:
    """``ids_crc32`` in place of ``ids``: the CRC-32 of the ids as unsigned little-endian 32-bit numbers."""
    from zlib import crc32

    kind = coder(path).kind
    names = [c for c in packed.columns if c != "ids"]
    schema = StructType([packed.schema[c] for c in names]).add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(crcs, pa.int64())], schema.names)

    return packed.select(*names, "ids").mapInArrow(run, schema)
