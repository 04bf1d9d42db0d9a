"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. The
vector of an n-gram binds the vectors of its letters, each permuted by its
place; a text bundles (sums) the vectors of its n-grams, and a language those
of its labelled texts. A text has the language whose prototype is nearest by
cosine. All sums are of whole numbers, so results do not depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograin.llm.store import ROWS, made_columns

DIMENSIONS = 512
GRAM = 3  # letters
SEED = 20_240_501
UNKNOWN = "und"
SAMPLE = 2_000  # labelled texts from which the least score is learned
VARIED = 100  # different grams; texts of fewer say too little to be called unlike every language
REACHED, LEAST = 0.999, 0.5  # the least score is this part of the one that so many of them reach
_BLOCK = 1 << 19  # code points that are looked at together; longer texts are read in pieces


def _letter_vectors(codes: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1, each from the code point alone."""
    return np.stack([np.random.Generator(np.random.PCG64([SEED, int(c)])).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1 for c in codes]).astype(np.int8)


class Grams:
    """Vectors of n-grams over the letters met so far."""

    def __init__(self) -> None:
        self.codes = np.array([0], np.int64)  # 0 stands for the gap between words
        self.vectors = _letter_vectors(self.codes)

    def learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes)
        if new.size:
            merged = np.concatenate([self.codes, new])
            order = np.argsort(merged)
            self.codes, self.vectors = merged[order], np.concatenate([self.vectors, _letter_vectors(new)])[order]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """(n, DIMENSIONS) vectors of rows of ``GRAM`` code points."""
        out = None
        for place in range(GRAM):
            v = np.roll(self.vectors, GRAM - 1 - place, axis=1)[np.searchsorted(self.codes, grams[:, place])]
            out = v if out is None else out * v
        return out


def letters(text: str) -> np.ndarray:
    """Lower-case letters as code points, anything between them as one gap, with a gap at either end; empty without letters."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, place = np.unique(low, return_inverse=True)
    keep = np.array([chr(c).isalpha() for c in kinds], bool)
    codes = np.where(keep, kinds, 0).astype(np.int64)[place]
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], codes, [0]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as packed integers of 21 bits per letter, and how often each occurs."""
    codes = letters(text)
    if codes.size < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def unpack(grams: np.ndarray) -> np.ndarray:
    return np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1)


def _chunks(texts: list, most: int = _BLOCK) -> Iterator[list[tuple[int, str]]]:
    """Runs of (place, text) of about ``most`` characters, nulls left out; a longer text is a run of its own."""
    run, size = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append((i, t))
        size += len(t)
    if run:
        yield run


def prototypes(labelled: DataFrame, text: str, lang: str) -> dict[str, np.ndarray]:
    """Language -> bundled vector over all labelled rows. To the driver come one vector per language, no rows."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Grams(), {}
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for run in _chunks(texts):
                by_lang: dict[str, list] = {}
                for i, t in run:
                    by_lang.setdefault(langs[i], []).append(gram_counts(t))
                for name, parts in by_lang.items():
                    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                    if not grams.size:
                        continue
                    counts = np.bincount(place, np.concatenate([c for _, c in parts])).astype(np.float64)
                    rows = unpack(grams)
                    known.learn(np.unique(rows))
                    total = sums.setdefault(name, np.zeros(DIMENSIONS))
                    for at in range(0, len(rows), 20_000):
                        total += counts[at : at + 20_000] @ known.bind(rows[at : at + 20_000]).astype(np.float64)
        if sums:
            names = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([sums[n].astype(np.int64).tolist() for n in names], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = labelled.select(text, lang).mapInArrow(bundle, "lang string, bundle array<bigint>")
    summed = parts.select("lang", F.posexplode("bundle").alias("at", "part")).groupBy("lang", "at").agg(F.sum("part").alias("total"))
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # DIMENSIONS numbers per language
        found.setdefault(r.lang, np.zeros(DIMENSIONS))[r.at] = r.total
    return found


def identify(df: DataFrame, model: dict[str, np.ndarray], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` (its text only if asked for) with ``lang_pred``, ``score`` and ``grams``, the number of different grams.

    ``score`` is the cosine with the nearest prototype, 0 at least. Columns of ``df`` with these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text if nothing was learned. Of equally near languages the first by
    name wins. Texts are read whole, of any length.
    """
    names = sorted(model)
    unit = np.stack([model[n] / max(np.linalg.norm(model[n]), 1.0) for n in names]).astype(np.float64) if names else np.zeros((0, DIMENSIONS))

    state: dict[str, Grams] = {}  # filled in the worker

    def nearest(texts: list) -> list[pa.Array]:
        known = state.setdefault("grams", Grams())
        pred, score, varied = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
        for run in _chunks(texts) if names else ():
            parts = [gram_counts(t) for _, t in run]
            grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            if not grams.size:
                continue
            rows = unpack(grams)
            known.learn(np.unique(rows))
            vectors, at = known.bind(rows).astype(np.float32), 0
            for (i, _), (own, counts) in zip(run, parts, strict=True):
                if own.size:
                    bundle = (counts.astype(np.float32) @ vectors[place[at : at + own.size]]).astype(np.float64)
                    at += own.size
                    varied[i] = own.size
                    near = unit @ bundle / max(np.linalg.norm(bundle), 1e-9)
                    best = int(np.argmax(near))
                    pred[i], score[i] = names[best], min(max(float(near[best]), 0.0), 1.0)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(varied, pa.int32())]

    return made_columns(df, text, {"lang_pred": "string", "score": "double", "grams": "int"}, nearest, keep_text)


def held_out(key: Column) -> Column:
    """A quarter of the rows, by the CRC-32 of the key as text, is kept for testing; null keys are not in it."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the labelled rows that are not held out and have a key."""
    return prototypes(_labelled(df, key, text, lang), text, lang)


def _labelled(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return df.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())


def least_score(df: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score below which a text of ``VARIED`` grams counts as unlike all languages: ``LEAST`` of what nearly all labelled ones reach.

    Learned from ``SAMPLE`` labelled rows that are not held out, those with the smallest hashes of key and text; 0 without such rows.
    """
    rows = _labelled(df, key, text, lang).select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("u"))
    low = rows.select("u").orderBy("u").limit(SAMPLE).agg(F.max("u")).first()[0]
    if low is None:
        return 0.0
    scores = identify(rows.where(F.col("u") <= low).select("text"), model, "text", False).where(F.col("grams") >= VARIED)
    reached = scores.agg(F.percentile_approx("score", 1 - REACHED, 10_000)).first()[0]
    return LEAST * (reached or 0.0)


def learn_and_identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """``df`` with ``held_out, lang_pred, score``; learns from the labelled rows that are not held out and have a key."""
    return identify(df.withColumn("held_out", held_out(F.col(key))), learn(df, key, text, lang), text, keep_text)
