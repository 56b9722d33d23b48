"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to a fixed number of cells. One pass over every document counts
the cells of the raw corpus and, among them, of the trusted target; the two smoothed multinomials
give each cell a log ratio. A second pass scores every document by the mean ratio of its n-grams
(so length does not matter) and keeps those at or above a fixed threshold, unless the plain
repetition and length rules failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import valid

#: Cells of the two multinomials, added count for each, and the score from which a document is kept.
CELLS, SMOOTH, THRESHOLD = 1 << 15, 1.0, -0.15
#: Documents with a trusted label that make the target at most, by least hash of the id.
TARGET_ROWS = 50_000
#: Base rules: fewest words, window of repeated words, and the percentage of words in such windows from which a text fails.
FEWEST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
KEPT_WORDS = 50_000


class WordHashes(dict):
    """64-bit hashes of the words a task met (bounded)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def flat(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts in a row, and how many each text has."""
    parts = [np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws)) for ws in (t.split() for t in texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(p) for p in parts], np.int64)


def cells(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the owner of every word and of every pair of neighbours with one owner."""
    with np.errstate(over="ignore"):
        pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ ids[1:]
        pairs ^= pairs >> np.uint64(29)
        pairs *= np.uint64(0xBF58476D1CE4E5B9)
    same = owner[:-1] == owner[1:]
    all_ = np.concatenate([ids >> np.uint64(32), (pairs >> np.uint64(32))[same]])
    return (all_ % np.uint64(CELLS)).astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def target_ids(labels: DataFrame, *, id_col: str = "doc_id", quality_col: str = "quality", bound: int = TARGET_ROWS) -> frozenset[str]:
    """The ids, as text, of at most `bound` rows labelled as good."""
    rows = labels.where(F.col(quality_col) == 1).select(F.col(id_col).cast("string").alias("i")).dropna().distinct()
    return frozenset(r["i"] for r in rows.orderBy(F.xxhash64("i"), "i").limit(bound).collect())


def log_ratios(docs: DataFrame, trusted: frozenset[str], *, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """ln(p_target / p_raw) of each cell, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = WordHashes(), np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for b in batches:
            good = np.array([i in trusted for i in b.column(0).to_pylist()], bool)
            ids, lengths = flat([(t or "").encode() for t in b.column(1).to_pylist()], hashes)
            if len(ids):
                cell, owner = cells(ids, np.repeat(np.arange(len(lengths)), lengths))
                raw += np.bincount(cell, minlength=CELLS)
                target += np.bincount(cell[good[owner]], minlength=CELLS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["cell", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("string").alias("i"), valid(F.col(text_col)).alias("t")).mapInArrow(count, "cell long, raw long, target long")
    counts = np.zeros((2, CELLS))
    for r in rows.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most CELLS rows
        counts[:, r["cell"]] = r["target"], r["raw"]
    if not counts[0].sum():
        return np.zeros(CELLS)
    p = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * CELLS)
    return np.log(p[0] / p[1])


def repeated(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners: its words in windows that occur twice or more in it."""
    if len(ids) < WINDOW:
        return np.zeros(n, np.int64)
    m = len(ids) - WINDOW + 1
    with np.errstate(over="ignore"):
        h = owner[:m].astype(np.uint64)
        for k in range(WINDOW):
            h = (h ^ ids[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    starts = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
    h = h[starts]
    order = np.argsort(h)
    h = h[order]
    twin = np.zeros(len(h), bool)
    twin[1:] |= h[1:] == h[:-1]
    twin[:-1] |= h[1:] == h[:-1]
    edge = np.zeros(len(ids) + 1, np.int64)
    at = starts[order[twin]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=n)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row, from whole texts.

    A null text has no words and fails the base rules; without any trusted label every score is 0.
    doc_id is of any type that has a text form, and meets the labels' by that.
    Repeated rows are scored alike, a score of exactly the threshold is kept, and a null doc_id is
    never in the target. Whole texts of any length are read (what is no UTF-8 as U+FFFD), an empty
    table gives no row, and other columns are not looked at. The target is a bounded set of
    labelled rows (TARGET_ROWS); the raw counts are of all rows. The two passes need one shuffle of
    at most CELLS rows a task.
    """
    ratios = log_ratios(docs, target_ids(labels), id_col=id_col, text_col=text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            data = [t.encode() for t in texts]
            ids, n_words = flat(data, hashes)
            owner, n = np.repeat(np.arange(len(data)), n_words), len(data)
            again = repeated(ids, owner, n)
            total, grams = np.zeros(n), np.maximum(1, np.where(n_words, 2 * n_words - 1, 0))
            if len(ids):
                cell, of = cells(ids, owner)
                total = np.bincount(of, weights=ratios[cell], minlength=n)
            mean = total / grams
            lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
            failed = (n_words < FEWEST_WORDS) | (100 * again > REPEATED_PERCENT * n_words)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n_words),
                    pa.array([len(t) - len(d) + len(d.translate(None, b" \t\n\x0b\x0c\r")) for t, d in zip(texts, data, strict=True)], pa.int64()),
                    pa.array([len(d) - len(d.translate(None, b"#*$%&|<>")) for d in data], pa.int64()),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(again),
                    pa.array(failed),
                    pa.array(~failed & (mean >= threshold)),
                    pa.array(mean),
                ],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), valid(F.col(text_col)).alias("t"))
    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds}")
