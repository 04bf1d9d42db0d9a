"""Centroid clustering in whole numbers by bit planes.

Each of a vector's 64 components becomes the integer ``floor(64 * x)``. Bit
``i`` of all 64 components is one 64-bit word, the ``i``-th plane; the last
plane is the sign (two's complement). The dot product of two vectors is then
the sum over pairs of planes of ``weight * weight * popcount(plane AND plane)``,
exact for any magnitude, and squared distances follow from dot products. Sums
of components are counts of ones by plane, so new centroids are exact as well.

Planes are written once; every round reads them, meets the few centroids in the
tasks, and shuffles one row of counts per task, cluster and plane.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from repograin.llm.store import saved

WIDTH = 64  # components, as a plane is one word
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
ROWS = 2048  # vectors that lie unpacked in a worker
SMALL = 28  # planes up to which all products fit 64-bit numbers; beyond it they are Python's
LONGEST = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Exactly ``WIDTH`` components, none null, infinite or not a number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == WIDTH) & finite, F.lit(False))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``; beyond 64 bits as Python's integers."""
    if np.abs(x).max(initial=0) < 1 << 50:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 1 << 52 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], object)


def to_planes(v: np.ndarray) -> np.ndarray:
    """Vectors by planes, as many as the largest number needs."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    count = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    bits = np.stack([((v >> i) & 1).astype(np.uint8) for i in range(count)], axis=1)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(count: int, exact: bool) -> np.ndarray:
    w = [1 << i for i in range(count - 1)] + [-(1 << (count - 1))]
    return np.array(w, object if exact else np.int64)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All dot products of the rows of ``a`` and of ``b``, both given by planes."""
    exact = max(a.shape[1], b.shape[1]) > SMALL
    out = np.zeros((len(a), len(b)), object if exact else np.int64)
    for i, wa in enumerate(weights(a.shape[1], exact)):
        for j, wb in enumerate(weights(b.shape[1], exact)):
            ones = np.bitwise_count(a[:, i, None] & b[None, :, j])
            out += ones.astype(out.dtype) * (wa * wb)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    exact = a.shape[1] > SMALL
    out = np.zeros(len(a), object if exact else np.int64)
    for i, wa in enumerate(weights(a.shape[1], exact)):
        for j, wb in enumerate(weights(a.shape[1], exact)):
            out += np.bitwise_count(a[:, i] & a[:, j]).astype(out.dtype) * (wa * wb)
    return out


def distances(a: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of vectors to centroids, from dot products alone."""
    return squares(a)[:, None] + squares(centroids)[None, :] - 2 * dots(a, centroids)


def _unpacked(column: pa.Array) -> np.ndarray:
    """Planes of some rows; those with fewer planes repeat their sign."""
    held = [np.frombuffer(b, "<u8") for b in column.to_pylist()]
    most = max(map(len, held))
    return np.stack([h if len(h) == most else np.concatenate([h, np.repeat(h[-1:], most - len(h))]) for h in held])


def plane_table(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, planes`` of the usable rows, saved."""
    schema = StructType([StructField("key", df.schema[key].dataType)]).add("planes", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
                planes = to_planes(whole_numbers(values))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row.tobytes() for row in planes], pa.binary())], schema.names)

    kept = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    return saved(kept.mapInArrow(run, schema), "planes")


def first_centroids(planes: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of seed and key; among equal keys, of the smallest planes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    rows = planes.orderBy(hashed, "planes").limit(clusters).select("planes").collect()
    return _unpacked(pa.array([bytes(r[0]) for r in rows], pa.binary()))


def _counts(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``cluster, weight, n, ones``: how many vectors have their nearest centroid there, and their ones by plane and component."""
    schema = "cluster int, bit int, is_sign boolean, n long, ones array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], np.ndarray] = {}
        n = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                a = _unpacked(batch.column(0).slice(at, ROWS))
                nearest = distances(a, centroids).argmin(axis=1)
                n += np.bincount(nearest, minlength=len(centroids))
                bits = np.unpackbits(np.ascontiguousarray(a).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                member = (nearest[None, :] == np.arange(len(centroids))[:, None]).astype(np.float32)
                ones = (member @ bits).astype(np.int64).reshape(len(centroids), a.shape[1], WIDTH)
                for i in range(a.shape[1]):
                    place = (i, i == a.shape[1] - 1)
                    held[place] = held.get(place, 0) + ones[:, i]
        rows = [(c, i, sign, int(n[c]) if k == 0 else 0, ones[c].tolist()) for k, ((i, sign), ones) in enumerate(held.items()) for c in np.flatnonzero(n).tolist()]
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["cluster", "bit", "is_sign", "n", "ones"])

    partial = planes.select("planes").mapInArrow(run, schema)
    return partial.groupBy("cluster", "bit", "is_sign").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("ones")[i]) for i in range(WIDTH)]).alias("ones"))


def moved(planes: DataFrame, centroids: np.ndarray, numbers: list[list[int]]) -> tuple[np.ndarray, list[list[int]]]:
    """The next centroids, by planes and as numbers; only sums by cluster and plane come to the driver."""
    count = [0] * len(numbers)
    total = [[0] * WIDTH for _ in numbers]
    for r in _counts(planes, centroids).collect():
        count[r.cluster] += r.n
        weight = -(1 << r.bit) if r.is_sign else 1 << r.bit
        total[r.cluster] = [t + weight * o for t, o in zip(total[r.cluster], r.ones)]
    numbers = [[t // n for t in totals] if n else old for n, totals, old in zip(count, total, numbers)]
    return to_planes(np.array(numbers, object)), numbers


def numbers_of(planes: np.ndarray) -> list[list[int]]:
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little").reshape(len(planes), -1, WIDTH)
    return [[int(x) for x in row] for row in (bits.astype(object) * weights(planes.shape[1], True)[None, :, None]).sum(axis=1)]


def assigned(planes: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``key, cluster, distance`` of all vectors; a distance beyond 64 bits is null."""
    schema = StructType([planes.schema["key"]]).add("cluster", "integer").add(StructField("distance", LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                away = distances(_unpacked(part.column(1)), centroids)
                nearest = away.argmin(axis=1)
                least = away[np.arange(len(nearest)), nearest].tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nearest, pa.int32()), pa.array([d if d <= LONGEST else None for d in least], pa.int64())], schema.names)

    return saved(planes.select("key", "planes").mapInArrow(run, schema), "assigned")


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row per usable vector.

    Rows whose vector is null, has not exactly 64 components, or has a null,
    infinite or undefined one are left out. Each other row is a vector of its
    own, repeated and null keys included (a null key hashes as empty text);
    with fewer vectors than ``clusters`` each starts a cluster; equal distances
    go to the smaller number; an empty table gives no rows. Distances and sums
    that exceed a long are null, but decide exactly. Other columns are not read.
    """
    planes = plane_table(df, key, vector)
    centroids = None if planes.isEmpty() else first_centroids(planes, clusters, seed)
    if centroids is None:
        kind = df.schema[key].dataType.simpleString()
        return planes.select(F.col("key").cast(kind).alias(key), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    numbers = numbers_of(centroids)
    for _ in range(rounds):
        centroids, numbers = moved(planes, centroids, numbers)
    placed = assigned(planes, centroids)
    sums = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))).collect()}
    all_of = None if None in sums.values() else int(sum(sums.values()))
    by_cluster = [None if sums.get(c, 0) is None or sums.get(c, 0) > LONGEST else int(sums.get(c, 0)) for c in range(len(numbers))]
    digests = [sha256(",".join(map(str, row)).encode()).hexdigest() for row in numbers]
    return placed.select(
        F.col("key").alias(key), "cluster", "distance",
        F.get(F.array(*[F.lit(n).cast("long") for n in by_cluster]), F.col("cluster")).alias("cluster_inertia"),
        F.lit(None if all_of is None or all_of > LONGEST else all_of).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"))
