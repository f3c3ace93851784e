"""Language identification by nearest centroids of normalised TF-IDF n-grams.

Each language has several centroids, found by spherical k-means on a bounded
sample of its texts; document frequencies cover all training rows.  A text gets
the language of the centroid with the largest cosine, and is rejected if that
cosine is under half of the least that training texts of its length have shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholion.llm.common import as_bytes, map_arrow

UND = "und"
BUCKETS = 1 << 13
GRAM = 3
CENTROIDS = 4
#: Sampled texts of each language that centroids are fitted to; all texts if there are fewer.
PER_LANGUAGE = 1500
#: Texts drawn beyond one and a half times that, so that chance never leaves too few.
SPARE = 64
ROUNDS = 8
#: Bytes whose n-grams are counted at once.
BLOCK = 1 << 20
#: A text is rejected below this share of the least cosine of training texts of its length.
SLACK = 0.5

#: Letters stay, as do bytes of characters beyond ASCII; all else becomes a space.
_KEEP = np.array([c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)], np.uint8)


def counts_of(text: bytes | None) -> np.ndarray | None:
    """Occurrences of each hashed n-gram of the lower-cased text; None if it has no letter."""
    low = (text or b"").decode("utf-8", "replace").lower()
    if not any(map(str.isalpha, low)):
        return None
    data = _KEEP[np.frombuffer(f" {low} ".encode(), np.uint8)]
    blank = data == 0x20
    data = data[~(blank & np.roll(blank, 1)) | (np.arange(len(data)) == 0)]
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(data) - GRAM + 1, BLOCK):
        part = data[i : i + BLOCK + GRAM - 1].astype(np.uint32)
        code = sum(part[k : len(part) - GRAM + 1 + k] << np.uint32(8 * k) for k in range(GRAM))
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    return counts


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit vector."""
    at = np.flatnonzero(counts)
    value = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((value**2).sum())
    return at, (value / norm if norm else value).astype(np.float32)


def _band(counts: np.ndarray) -> int:
    return int(counts.sum()).bit_length()


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # by the bits of the number of n-grams

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        counts = counts_of(text)
        if counts is None or not self.langs:
            return UND, 0.0, True
        at, value = _vector(counts, self.idf)
        cosine = self.centroids[:, at] @ value
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.langs[best], score, score <= 0 or score < self.least[min(_band(counts), len(self.least) - 1)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if (counts := counts_of(text)) is not None:
                total += counts > 0
                n += 1
    place = np.append(np.flatnonzero(total), BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.append(total[place[:-1]], n), pa.int64())], ["place", "n"])


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far apart starts; unit rows."""
    mean = x.mean(axis=0)
    start = [int(np.argmax(x @ mean))]
    near = x @ x[start[0]]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    centre = x[start].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (own == j).any():
                total = x[own == j].sum(axis=0)
                centre[j] = total / max(np.linalg.norm(total), 1e-12)
    return centre


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from all rows of ``docs`` whose language isn't null and whose text has a letter."""
    known = docs.select(as_bytes(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    freq = known.select("text").mapInArrow(_frequencies, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(BUCKETS + 1), 0
    df[freq["place"]] = freq["n"]
    n, df = df[BUCKETS], df[:BUCKETS]
    idf = np.log((n + 1) / (df + 1)) + 1
    # texts, not rows: copies must not thin out the sample
    keyed = known.withColumn("key", F.xxhash64("text"))
    sizes = {r["lang"]: r["count"] for r in keyed.select("lang", "key").distinct().groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.float32), idf, np.zeros(1))
    share = F.element_at(F.create_map(*(x for lang, size in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, (1.5 * per_language + SPARE) / size))))), F.col("lang"))
    sample = keyed.where(F.pmod("key", F.lit(1 << 30)) < share * (1 << 30))
    sample = sample.groupBy("lang", "key").agg(F.min("text").alias("text"))
    sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= per_language)

    def centres(part: pd.DataFrame) -> pd.DataFrame:
        rows, bands = [], []
        for text in part.sort_values("key")["text"]:
            if (counts := counts_of(bytes(text))) is not None:
                row = np.zeros(BUCKETS, np.float32)
                at, value = _vector(counts, idf)
                row[at] = value
                rows.append(row), bands.append(_band(counts))
        if not rows:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in ("lang", "centre", "band", "least")})
        x = np.array(rows)
        centre = _kmeans(x, centroids)
        cosine = (x @ centre.T).max(axis=1)
        least = pd.Series(cosine).groupby(bands).min()
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": list(centre), "band": [list(least.index)] * len(centre), "least": [list(least)] * len(centre)})

    found = sample.select("lang", "key", "text").groupBy("lang").applyInPandas(centres, "lang string, centre array<float>, band array<int>, least array<double>").toPandas().sort_values("lang", kind="stable")
    top = max((b for bands in found["band"] for b in bands), default=0)
    least = np.full(top + 1, np.inf)
    for bands, values in zip(found["band"], found["least"], strict=True):
        np.minimum.at(least, np.asarray(bands, int), np.asarray(values))
    least = np.minimum.accumulate(least[::-1])[::-1]  # a length is never held to more than those above it
    least = np.where(np.isinf(least), 0.0, least) * SLACK
    least[: max(1, top // 3)] = 0.0
    centre = np.array([np.asarray(c, np.float32) for c in found["centre"]], np.float32).reshape(-1, BUCKETS)
    return Model(list(found["lang"]), centre, idf, least)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, *extra, lang_pred, score, rejected) for every row, from its whole text alone.

    ``und``, score 0 and rejected for texts that are null or have no letter, and
    for all if nothing was learned.  Equal cosines go to the language that sorts
    first.  Repeated rows repeat; other columns are not read.
    """
    extra = extra or {}
    source = docs.select(F.col(id_col).alias("doc_id"), *(c.alias(k) for k, c in extra.items()), as_bytes(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
        lang, score, rejected = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(r) for r in rejected])], [*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return map_arrow(source, rows, f"{kinds}, lang_pred string, score double, rejected boolean")
