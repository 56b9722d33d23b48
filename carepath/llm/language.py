"""Language identification by the nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte 2- and 3-grams. Each language has
several centroids, found by spherical k-means among its labelled rows; a text gets the language
of the centroid with the largest cosine, and is rejected where its distance is beyond that of
nearly all labelled texts of its length that a clustering has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import valid

#: Cells of a vector, centroids of a language, steps of the clustering.
CELLS, CENTROIDS, STEPS = 1 << 13, 16, 8
#: Labelled rows of a language and of all languages that the fit uses, about, by hash of the id.
ROWS_PER_LANG, ROWS = 600, 3000
#: Which rows of the sample set the cut (one of so many), the share of them that may fall under it, and the deviations from their mean that it is below at least.
EVERY, QUANTILE, DEVIATIONS = 4, 0.002, 4
#: Bytes worked on at once; longer texts are counted slice by slice.
SLICE = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def gram_counts(text: str) -> np.ndarray:
    """How often each cell's 2- and 3-grams occur in the whole lower-cased text, blanks put around it."""
    data, out = b" " + text.lower().encode() + b" ", np.zeros(CELLS, np.int64)
    for k in range(0, len(data) - 1, SLICE):
        b = np.frombuffer(data[k : k + SLICE + 2], np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(256) + b[1:]
        three = two[:-1] * np.uint32(256) + b[2:]
        two = two[:SLICE]
        three = three[:SLICE]
        for g, salt in ((two, 0x01000000), (three, 0)):
            cell = ((g + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
            out += np.bincount(cell, minlength=CELLS)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


@dataclass(frozen=True)
class Model:
    """idf of the cells, unit centroids with their languages, the usual cosine by length (log2 of the grams), and the share of it under which a text is rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: tuple[str, ...]
    usual: np.ndarray
    cut: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of counts: its centroid, the cosine, and whether it is rejected."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        size = np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), len(self.usual) - 1)
        return best, top, top < self.cut * self.usual[size]


def _clusters(unit: np.ndarray, k: int) -> np.ndarray:
    """k centroids: the first is the mean, each next the row farthest from those before."""
    centers = _unit(unit.mean(axis=0, keepdims=True))
    while len(centers) < k:
        centers = np.vstack([centers, unit[(unit @ centers.T).max(axis=1).argmin()]])
    for _ in range(STEPS):
        near = (unit @ centers.T).argmax(axis=1)
        centers = _unit(np.vstack([unit[near == j].mean(axis=0) if (near == j).any() else centers[j] for j in range(len(centers))]))
    return centers


def fit(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of the rows that `train` marks and that have a lang and a letter.

    The sample is drawn by a hash of the id, ROWS_PER_LANG of each language in expectation but not
    more than ROWS in all, and at least one row of each language is expected: of more than ROWS
    languages the most frequent are learned. Only the sample's counts come to the driver. None
    without any labelled row.
    """
    rows = docs.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), valid(F.col(text_col)).alias("text"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(ROWS).collect()
    if not found:
        return None
    each = min(ROWS_PER_LANG, ROWS / len(found))
    share = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in found], "lang string, share double"))  # at most ROWS rows
    u = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    sample = rows.join(share, "lang").where(u < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(lang, gram_counts(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            cells = [np.flatnonzero(c).astype("<i4") for _, c in kept]
            pack = lambda xs: pa.array([x.astype("<i4").tobytes() for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pack(cells), pack(c[i] for (_, c), i in zip(kept, cells, strict=True))], ["lang", "cells", "n"])

    got = sorted((r["lang"], bytes(r["cells"]), bytes(r["n"])) for r in sample.mapInArrow(count, "lang string, cells binary, n binary").collect())
    if not got:
        return None
    unit = np.zeros((len(got), CELLS), np.float32)
    for row, (_, cells, n) in zip(unit, got, strict=True):
        row[np.frombuffer(cells, "<i4")] = np.frombuffer(n, "<i4")
    size = np.log2(np.maximum(unit.sum(axis=1), 1)).astype(int)
    idf = (np.log((1 + len(got)) / (1 + np.count_nonzero(unit, axis=0))) + 1).astype(np.float32)
    np.log1p(unit, out=unit)  # in place: the matrix is what the driver's memory holds
    unit *= idf
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)
    langs = np.array([g[0] for g in got])
    names, centers, seen = [], [], []
    tells = np.arange(len(got)) % EVERY == EVERY - 1  # the rows are sorted by language
    for lang in sorted(set(langs)):
        own = unit[langs == lang]
        centers.append(_clusters(own, min(CENTROIDS, 1 + len(own) // 20)))
        names += [lang] * len(centers[-1])
        own = unit[(langs == lang) & ~tells]
        if len(own):
            seen.append(_clusters(own, min(CENTROIDS, 1 + len(own) // 20)))
    centroids = np.vstack(centers)
    cosine = (unit @ centroids.T).max(axis=1)
    known = np.array([np.median(cosine[size == s]) if (size == s).sum() >= 5 else np.nan for s in range(32)])
    known[0] = 0.0 if np.isnan(known[0]) else known[0]
    at = np.flatnonzero(~np.isnan(known))
    usual = np.interp(np.arange(32), at, known[at])
    cut = 0.0
    if tells.any():
        share = (unit[tells] @ np.vstack(seen).T).max(axis=1) / np.maximum(usual[size[tells]], 1e-9)
        # few rows say little about a quantile, so the cut is below it and below what their spread makes likely
        cut = max(0.0, min(np.quantile(share, QUANTILE), share.mean() - DEVIATIONS * share.std()))
    return Model(idf, centroids.astype(np.float32), tuple(names), usual, float(cut))


def detect(model: Model | None) -> F.udf:
    """A column function of a text: struct of lang, score and rejected."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        rows = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            best, top, far = model.nearest(np.array([gram_counts(texts.iloc[r]) for r in part], np.float32))
            lang[part], score[part], rejected[part] = [model.langs[b] for b in best], top, far
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})

    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row, from whole texts.

    Learns from rows that are not held out; predictions see the text alone. A null text and one
    without a letter is `und` with score 0 and rejected, and so is every text when nothing is
    labelled. Of equally near centroids the first counts (languages in code point order). Texts of
    any length are counted whole, slice by slice, and what is no UTF-8 as U+FFFD. Repeated rows
    agree, a null doc_id is not held out, an empty table gives no row, and other columns may have
    any names. No shuffle but the count of languages.
    """
    model = fit(docs, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), detect(model)(valid(F.col(text_col))).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.rejected")
