"""Near duplicates by SimHash fingerprints, searched in BK-trees.

Fingerprints are dealt to shards by some of their bits, so that those near each
other meet in a shard. A shard is a BK-tree: a node's children are keyed by
their Hamming distance to it, and a search follows only the edges within the
radius of the distance it met. A shard over ``TREE`` fingerprints is cut into
several trees; each tree is sent to every slice of the shard's searches, so no
shard meets in one task and no pair is left out.

Fingerprints are dealt by the values of each two of four 16-bit blocks: for a
radius up to 2 of 64 bits, two of them must agree, so every pair is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograin.llm import near_copies
from repograin.llm.components import components
from repograin.llm.store import hinted, made_columns, saved

RADIUS = 2
SHINGLE = 3  # words
TREE = 4_096  # nodes of a tree, and searches of a slice
BROADCAST_ROWS = 200_000
_SEARCHES = 64  # searches that go down a tree together
_HASHES = 255 << 8  # shingle hashes whose bits are counted together


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest first. Eight one-byte counters share a long, for up to 255 rows."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES):
        bits = np.unpackbits(hashes[at : at + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def _other_hash(h: np.ndarray, number: int) -> np.ndarray:
    """Another hash of the same shingles; number 0 is the hash itself."""
    if not number:
        return h
    z = h + np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(text: str | None, shingle: int = SHINGLE, longs: int = 1, repeats: bool = True) -> bytes:
    """``longs`` times 64 bits, the highest first; a bit is set if more than half of the shingles' hashes have it. Without words: all zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return bytes(8 * longs)
    size = min(shingle, len(words))
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(run, 42) for run in runs), np.uint64, len(words) - size + 1)
    if not repeats:
        hashes = np.unique(hashes)
    return b"".join(np.packbits(_bit_counts(_other_hash(hashes, i)) * 2 > len(hashes)).tobytes() for i in range(longs))


def set_print(hashes: np.ndarray) -> bytes:
    """The fingerprint of a set of shingle hashes."""
    return np.packbits(_bit_counts(hashes) * 2 > len(hashes)).tobytes()


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, longs: int = 1, repeats: bool = True) -> DataFrame:
    """``df`` without its text, with ``out``: the fingerprint as bytes."""

    def prints(texts: list) -> list[pa.Array]:
        return [pa.array([simhash(t, shingle, longs, repeats) for t in texts], pa.binary())]

    return made_columns(df, text, {out: "binary"}, prints, keep_source=False)


class BKTree:
    """Nodes in arrays; the children of a node are a run of edges sorted by distance."""

    def __init__(self, values: np.ndarray):
        """``values``: (nodes, longs)."""
        self.values = values
        children: list[dict[int, int]] = [{} for _ in values]
        numbers = [int.from_bytes(v.tobytes(), "big") for v in values]
        for i in range(1, len(numbers)):
            at, own = 0, numbers[i]
            while True:
                d = (own ^ numbers[at]).bit_count()
                child = children[at].get(d)
                if child is None:
                    children[at][d] = i
                    break
                at = child
        self.start = np.concatenate([[0], np.cumsum([len(c) for c in children])])
        self.edge = np.array([d for c in children for d in sorted(c)], np.int64)
        self.child = np.array([c[d] for c in children for d in sorted(c)], np.int64)

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query place, node place) of all pairs within the radius; many searches go down level by level."""
        for first in range(0, len(queries), _SEARCHES):
            q = np.arange(first, min(first + _SEARCHES, len(queries)))
            n = np.zeros(len(q), np.int64)
            while len(q):
                d = np.bitwise_count(queries[q] ^ self.values[n]).sum(axis=1, dtype=np.int64)
                yield q[d <= radius], n[d <= radius]
                lo = self.start[n]
                many = self.start[n + 1] - lo
                q, d = np.repeat(q, many), np.repeat(d, many)
                edges = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(q))
                near = np.abs(self.edge[edges] - d) <= radius  # the triangle inequality leaves the other edges out
                q, n = q[near], self.child[edges[near]]


def _join(a: np.ndarray, b: np.ndarray, parent: np.ndarray) -> None:
    """Join the places ``a`` and ``b`` in the forest ``parent``."""
    apart = parent[a] != parent[b]
    for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        parent[max(x, y)] = min(x, y)


def tree_links(nodes: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs within the radius connect, fewer than there are fingerprints. No queries: all nodes search."""
    every = nodes if queries is None else np.concatenate([nodes, queries])
    parent = np.arange(len(every))
    offset = 0 if queries is None else len(nodes)
    for q, n in BKTree(nodes).search(every[offset:], radius):
        _join(q + offset, n, parent)
    tied = np.flatnonzero(parent != np.arange(len(every)))
    return every[tied], every[parent[tied]]


def block_tables() -> list[np.ndarray]:
    """Bit places of each two of four 16-bit blocks."""
    return [np.concatenate([np.arange(16 * x, 16 * x + 16), np.arange(16 * y, 16 * y + 16)]) for x, y in combinations(range(4), 2)]


def _bytes_of(values: np.ndarray) -> pa.Array:
    """(n, longs) -> binary column."""
    width = values.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _longs_of(column: pa.Array, longs: int) -> np.ndarray:
    """Binary column of one width -> (n, longs); bytes keep their order in memory."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, longs)


def links(prints: DataFrame, tables: list[np.ndarray], radius: int, longs: int = 1) -> DataFrame:
    """``a, b``: edges between distinct fingerprints ``fp`` that connect all pairs within the radius that share a shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                column = batch.column(0).slice(at, 4_096)
                bits = np.unpackbits(_longs_of(column, longs).view(np.uint8), axis=1)
                for number, places in enumerate(tables):
                    shard = bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(column), number, np.int32)), pa.array(shard), column], ["tab", "shard", "fp"])

    shards = prints.select("fp").mapInArrow(deal, "tab int, shard bigint, fp binary")
    hot = saved(shards.groupBy("tab", "shard").agg(F.count("*").alias("n")).where(F.col("n") > TREE).withColumn("slices", F.ceil(F.col("n") / TREE).cast("int")).drop("n"), "shards")
    members = shards.join(hinted(hot, hot.count(), BROADCAST_ROWS), ["tab", "shard"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int"))
    # trees and searches of a shard meet in pairs (tree, slice) with tree <= slice
    meets = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda i: F.struct(F.least("own", i).alias("tree"), F.greatest("own", i).alias("slice"), (i >= F.col("own")).cast("int").alias("node")))
    keys = ["tab", "shard", "tree", "slice"]
    dealt = members.select("tab", "shard", "fp", F.explode(meets).alias("m")).select("tab", "shard", "m.tree", "m.slice", "m.node", "fp").repartition(*keys).sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[np.ndarray] = []  # of the group that is still open
        body: list[np.ndarray] = []

        def found(rows: np.ndarray, values: np.ndarray):
            node = rows[:, 4] == 1
            return tree_links(values[node], None if rows[0, 2] == rows[0, 3] else values[~node], radius)

        def edges(pairs: list) -> pa.RecordBatch:
            a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros((0, longs), np.uint64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([_bytes_of(a), _bytes_of(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            values = _longs_of(batch.column(5), longs)
            if head:
                rows, values = np.concatenate([*head, rows]), np.concatenate([*body, values])
            cuts = np.concatenate([[0], np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1, [len(rows)]])
            pairs = [found(rows[i:j], values[i:j]) for i, j in zip(cuts[:-2], cuts[1:-1], strict=True) if j - i > 1]
            head, body = [rows[cuts[-2] :]], [values[cuts[-2] :]]
            yield edges(pairs)
        if head:
            yield edges([found(head[0], body[0])])

    return dealt.mapInArrow(search, "a binary, b binary").distinct()


def _classes(rows: DataFrame, tables, radius: int, longs: int) -> DataFrame:
    """``rows`` (key, fp, more) with ``component_id``."""
    prints = saved(rows.groupBy("fp").agg(F.min("key").alias("low")), "prints")
    roots = saved(components(links(prints, tables, radius, longs)), "roots")
    linked = prints.join(roots, prints.fp == roots.node)
    lows = linked.groupBy("root").agg(F.min("low").alias("id"))
    tied = roots.join(lows, "root").select(F.col("node").alias("fp"), "id", F.lit(True).alias("tied"))
    named = saved(prints.join(tied, "fp", "left").select("fp", F.when(F.col("tied"), F.col("id")).otherwise(F.col("low")).alias("component_id")), "classes")
    return rows.join(named, "fp")


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: ``key, fingerprint, component_id``, the least key reachable over links of at most two bits.

    Texts without words, null included, have fingerprint 0, which links like
    any other. Null keys count in no minimum; a class of null keys alone has a
    null id. Repeated rows each get their row; other columns are not read.
    """
    rows = saved(with_fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("body")), "body", "fp", shingle), "prints")
    return _classes(rows, block_tables(), RADIUS, 1).select(F.col("key").alias(key), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows that stand for their class of near copies: found by fingerprint, and by shingle where those differ more; decided by exact similarity; see ``near_copies``."""
    return near_copies.keep_one(df, set_print, lambda prints: links(prints, block_tables(), RADIUS), key, text, similarity, shingle)
