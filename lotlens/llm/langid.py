"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

Features: counts of character 1-, 2- and 3-grams of the lower-cased letters (any run of other characters is one
space), hashed to ``DIM`` places; weight
(1 + ln count) * idf, vectors normalised. Inverse document frequencies come from all training documents. Each language
has ``CLUSTERS`` centroids, clustered by cosine on a sample of about ``SAMPLE`` of its training documents (a documented bound:
a fixed share of a hash of id and text, repeated rows once, so more rows make no larger fit, whatever their ids). A text gets the language of the nearest centroid;
its score is the cosine. A text is rejected if it has no letter, or if its distance (1 - cosine) exceeds the bound of its
length class: texts with as many different n-grams, by powers of two, those of ``LONG`` powers or more in one class. The bound is the largest
distance that a sampled training text of this class, or of a class of longer texts, has from its nearest centroid, all languages taken together, plus
``MORE`` / sqrt(number of training texts in the class) for what so many don't show. The last class is mostly of far longer texts
than its shortest; so up to twice the least number of n-grams its bound comes down from that of the class before, if larger. A class without training texts goes by the next shorter
one; texts shorter than all training texts are kept, as nothing tells what is far for them.

Defined results: null text or text without letters is ``und`` with score 0 and rejected; ties go to the
first language in order; without training documents all is ``und``; a null id trains if its crc32 rule says so (null: never held
out, trains); repeated rows count as often; an empty table gives an empty result; other columns are ignored, or kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 4096
CLUSTERS = 4
SAMPLE = 1500
LONG = 7
MORE = 0.5
UNKNOWN = "und"
_MIX = [(np.uint32(0x9E3779B1),), (np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)), (np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0x9E3779B1))]
PIECE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the letters, other runs as one space; None if the text has no letter."""
    if not text:
        return None
    total, some, carried = np.zeros(DIM, dtype=np.int64), False, np.full(1, 32, dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[points]
        some = some or bool(letter.any())
        points = np.concatenate([carried, np.where(letter, points, np.uint32(32)), np.full(1 if at + PIECE >= len(text) else 0, 32, dtype=np.uint32)])
        old = len(carried) if at else 0
        keep = np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])
        old -= int((~keep[:old]).sum())
        points = points[keep]
        for n, factors in enumerate(_MIX, 1):
            # n-grams that end in this piece
            own = points[max(0, old - n + 1) :]
            size = len(own) - n + 1
            if size > 0:
                mixed = np.zeros(size, dtype=np.uint32)
                for i, factor in enumerate(factors):
                    mixed ^= own[i : i + size] * factor
                total += np.bincount((mixed * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIM)
        carried = points[-2:]
    return total if some else None


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised vectors of the texts that have letters, which these are, and their numbers of different n-grams as powers of two."""
    rows = [(i, c) for i, t in enumerate(texts) if (c := counts(t)) is not None]
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    for k, (_, c) in enumerate(rows):
        at = np.flatnonzero(c)
        x[k, at] = (1 + np.log(c[at])) * idf[at]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x, np.array([i for i, _ in rows], dtype=np.int64), np.array([np.log2((c > 0).sum()) for _, c in rows])


def length_classes(powers: np.ndarray) -> np.ndarray:
    return np.minimum(LONG, powers.astype(np.int64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, total = np.zeros(DIM + 1, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            c = counts(text)
            if c is not None:
                seen[:DIM] += c > 0
                total += 1
    seen[DIM] = total
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(seen)], names=["place", "docs"])


def cluster(x: np.ndarray, k: int = CLUSTERS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, begun from groups of equal size by likeness to the mean; centroids, and the distance of each vector from the nearest."""
    by_likeness = np.argsort(x @ x.mean(0), kind="stable")
    centroids = np.stack([x[part].mean(0) for part in np.array_split(by_likeness, min(k, len(x)))])
    for _ in range(rounds):
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        own = np.argmax(x @ centroids.T, 1)
        centroids = np.stack([x[own == j].mean(0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32), 1 - (x @ centroids.T).max(1)


def limits(far: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The distance bound of each length class from the largest distance and the number of its training texts."""
    out, last = np.full(LONG + 1, np.inf), np.inf
    for k in range(LONG + 1):
        if texts[k]:
            last = far[k:].max() + MORE / np.sqrt(texts[k])
        out[k] = last
    return out


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, bounds: np.ndarray):
        self.idf, self.langs, self.centroids = idf, langs, centroids
        self.bounds = bounds

    def limit(self, powers: np.ndarray) -> np.ndarray:
        """The distance bound of texts with 2^``powers`` different n-grams."""
        before, last = self.bounds[LONG - 1 :]
        out = self.bounds[length_classes(powers)]
        if last < before < np.inf:
            first = (powers >= LONG) & (powers < LONG + 1)
            out[first] = before + (last - before) * (powers[first] - LONG)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        if not self.langs:
            return out
        x, rows, powers = vectors(texts, self.idf)
        bounds = self.limit(powers)
        cosine = x @ self.centroids.T
        best = np.argmax(cosine, 1) if len(rows) else []
        for i, (row, j, bound) in enumerate(zip(rows, best, bounds, strict=True)):
            score = float(min(1.0, max(0.0, cosine[i, j])))
            out[row] = self.langs[j], score, bool(1 - score > bound)
        return out


def training_sample(training: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text of about ``sample`` rows per language, of training rows with lang, text and h (hash of id and text)."""
    # one row per language
    sizes = training.groupBy("lang").agg(F.count("*").alias("n")).withColumn("share", F.least(F.lit(1.0), sample / F.col("n")))
    picked = training.join(F.broadcast(sizes.select(F.col("lang").alias("l"), "share")), F.col("lang") == F.col("l"))
    picked = picked.filter(F.pmod("h", F.lit(2**30)) < F.col("share") * float(2**30))
    # repeated rows share a hash and are one row of the sample
    return picked.groupBy("lang", "h").agg(F.any_value("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learns from text and lang of the documents that are not held out; collects DIM sums and one row per centroid."""
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("text").cast("string"), F.col("lang").cast("string"), F.xxhash64("doc_id", "text").alias("h"))
    rows = training.select("text").mapInArrow(_document_frequency, "place long, docs long").groupBy("place").agg(F.sum("docs").alias("docs")).collect()
    seen = np.zeros(DIM + 1)
    for place, n in rows:
        seen[place] = n
    idf = np.log((1 + seen[DIM]) / (1 + seen[:DIM])) + 1
    picked = training_sample(training, sample)

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, _, powers = vectors(part["text"].sort_values().tolist(), idf)
        if not len(x):
            return pd.DataFrame({"lang": [], "far": [], "texts": [], "centroid": []})
        classes = length_classes(powers)
        centroids, distances = cluster(x, clusters)
        far = [float(distances[classes == k].max(initial=0)) for k in range(LONG + 1)]
        texts = [int((classes == k).sum()) for k in range(LONG + 1)]
        n = len(centroids)
        return pd.DataFrame({"lang": [key[0]] * n, "far": [far] * n, "texts": [texts] * n, "centroid": list(centroids.astype(float))})

    found = picked.groupBy("lang").applyInPandas(learn, "lang string, far array<double>, texts array<long>, centroid array<double>").collect()
    found = sorted(found, key=lambda r: (r.lang, r.centroid))
    centroids = np.array([r.centroid for r in found], dtype=np.float32).reshape(-1, DIM)
    by_lang = {r.lang: r for r in found}.values()
    far = np.array([r.far for r in by_lang]).reshape(-1, LONG + 1).max(0, initial=0)
    texts = np.array([r.texts for r in by_lang]).reshape(-1, LONG + 1).sum(0)
    return Model(idf, [r.lang for r in found], centroids, limits(far, texts))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each document."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id")).alias("held_out"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                found = known.value.predict(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_()),
                ], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns kept."""
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                found = known.value.predict(batch.column(at).to_pylist())
                yield batch.filter(pa.array([not f[2] for f in found], pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def _slices(batch: pa.RecordBatch, rows: int = 250) -> Iterator[pa.RecordBatch]:
    """Vectors of so many rows are in memory at once."""
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)
