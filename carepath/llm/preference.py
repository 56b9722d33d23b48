"""A quality score by Bradley-Terry ranking of document pairs.

Every pair of a row labelled good and a row labelled bad is a comparison that the good one wins,
with probability logistic(w . (x_good - x_bad)). w maximises the likelihood of a fixed number of
comparisons of every labelled row, by Newton's steps with a ridge; w . x then ranks any document.
The cut is a quantile of the labelled rows' scores, the one at which the labels agree best, and
scores are moved so that it lies at THRESHOLD.

Features are shares of a whole text, so that its length matters only where a feature says so.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import valid

#: Labelled rows of each label that are learned from at most, by least hash of the id, and comparisons of each of them.
LABELLED_ROWS, COMPARISONS = 4_000, 12
#: The score from which a document counts as good, the ridge on w and Newton's steps at most.
THRESHOLD, RIDGE, STEPS = 0.3, 1e-3, 30
#: The symbols whose shares of a text are features, apart from letters, digits and blanks.
SYMBOLS = "#*$%&|<>!?.,;:-_=+/\\@~^()[]{}\"'`"
NAMES = (
    *SYMBOLS, "symbols", "words with a symbol", "upper case", "digits", "blanks", "lines", "not ASCII", "log words", "word length", "longest word",
    "distinct words", "word as before", "words of repeated threes", "repeated lines", "no words",
)


def features(text: str) -> list[float]:
    """The features of one text, in the order of NAMES; shares as square roots, so that little of a mark tells already."""
    n, words = max(1, len(text)), text.split()
    m = max(1, len(words))
    marks = [text.count(c) / n for c in SYMBOLS]
    odd = frozenset("#*$%&|<>!=~^@{}[]\\_")
    threes: dict[tuple[str, ...], int] = {}
    for k in range(len(words) - 2):
        three = (words[k], words[k + 1], words[k + 2])
        threes[three] = threes.get(three, 0) + 1
    again = sum(x for x in threes.values() if x > 1)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = [
        *marks, sum(marks), sum(not odd.isdisjoint(w) for w in words) / m, sum(map(str.isupper, text)) / n, sum(map(str.isdigit, text)) / n, sum(map(str.isspace, text)) / n,
        text.count("\n") / n, 1.0 - len(text.encode("ascii", "ignore")) / n,
    ]
    return [
        *[x**0.5 for x in shares], np.log1p(len(words)), np.log1p(len(text) / m), np.log1p(max(map(len, words), default=0)), len(set(words)) / m,
        (sum(map(str.__eq__, words, words[1:])) / m) ** 0.5, (again / m) ** 0.5, ((len(lines) - len(set(lines))) / max(1, len(lines))) ** 0.5, float(not words),
    ]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is kept from the fit: crc32 of the id as text is divisible by 5; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Model(NamedTuple):
    """Features are centred, divided by `scale` and kept within 6; the score is logistic(w . x - cut), moved to THRESHOLD at the cut."""

    centre: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    cut: float
    quantile: float

    def ranks(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -6.0, 6.0) @ self.w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.ranks(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def comparisons(good: int, bad: int, each: int = COMPARISONS) -> tuple[np.ndarray, np.ndarray]:
    """(place of a good row, place of a bad row): every row is in at least `each` different comparisons, or in all there are."""
    pairs = set()
    for n, m, turn in ((good, bad, False), (bad, good, True)):
        for k in range(min(each, m)):
            at = np.arange(n)
            other = (at + k * max(1, m // each)) % m
            pairs.update(zip(other.tolist(), at.tolist(), strict=True) if turn else zip(at.tolist(), other.tolist(), strict=True))
    found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def learned(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> Model | None:
    """The model of labelled rows; None without both labels. `weight` is how many rows of the table a row stands for."""
    if good.all() or not good.any():
        return None
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = np.inf  # what never differs tells nothing
    z = np.clip((x - centre) / scale, -6.0, 6.0)
    a, b = comparisons(int(good.sum()), int((~good).sum()))
    d = z[good][a] - z[~good][b]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -700, 700)))  # that the bad one wins
        slope = d.T @ p / len(d) - RIDGE * w
        bend = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    rank = z @ w
    order = np.argsort(rank, kind="stable")
    rank, good, weight = rank[order], good[order], weight[order]
    right = np.concatenate([[0.0], np.cumsum(np.where(good, 0.0, weight))]) + np.concatenate([np.cumsum(np.where(good, weight, 0.0)[::-1])[::-1], [0.0]])
    between = np.concatenate([[True], rank[1:] > rank[:-1], [True]])  # no cut among equal ranks
    ends = np.concatenate([[rank[0] - 1.0], rank, [rank[-1] + 1.0]])
    wide = np.where(between & (right >= right[between].max() - 1e-9), ends[1:] - ends[:-1], -1.0)
    k = int(np.argmax(wide))  # of the cuts that agree best, the one in the widest gap
    return Model(centre, scale, w, float(ends[k] + ends[k + 1]) / 2, float(weight[:k].sum() / weight.sum()))


def _featured(rows: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and x of every row of `rows`, which has a column t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "t").mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = LABELLED_ROWS) -> Model | None:
    """Learns from at most `most` rows of each label among those for which `train` (of the labels) holds."""
    key = F.col(id_col).cast("string")
    told = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(key.alias("i")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    told = told.where("low = high").select("i", (F.col("low") == 1).alias("good"), F.xxhash64("i").alias("h"))  # contradictory labels tell nothing
    counts = {r["good"]: r["n"] for r in told.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    some = [told.where(F.col("good") == g).orderBy("h", "i").limit(most) for g in (True, False)]
    rows = docs.select(key.alias("i"), valid(F.col(text_col)).alias("t")).join(F.broadcast(some[0].unionByName(some[1])), "i")
    held = _featured(rows, "i", "good", "h")
    found = [r for g in (True, False) for r in held.where(F.col("good") == g).orderBy("h", "i", "x").limit(most).collect()]  # repeated ids could make more
    if not found:
        return None
    good = np.array([r["good"] for r in found])
    weight = np.where(good, counts[True] / max(1, good.sum()), counts[False] / max(1, (~good).sum()))
    return learned(np.array([r["x"] for r in found]), good, weight)


def scored(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns of `keep` and the score of every row; 0.5 where nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            score = np.full(len(texts), 0.5) if model is None or not texts else model.scores(np.array([features(t or "") for t in texts]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], ["doc_id", *keep, "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, valid(F.col(text_col)).alias("t"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return rows.mapInArrow(run, f"{kinds}, score double")


def quality_ranks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Learned is only from labels of 0 and 1 whose id is not held out; ids with both labels, null
    labels and null ids teach nothing, and without both labels every score is 0.5. A null text is
    the empty text, which is scored like any other. Repeated rows and equal texts score alike, a
    score of exactly THRESHOLD counts as good. Ids may have any type. Whole texts of any length
    are read (what is no UTF-8 as U+FFFD), an empty table gives no row, and columns besides the
    id and the text are not looked at. The fit reads at most LABELLED_ROWS rows of each label.
    """
    model = fit(docs, labels, ~held_out(id_col), id_col=id_col, text_col=text_col, label_col=label_col)
    rows = docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("held_out"))
    return scored(rows, model, id_col=id_col, text_col=text_col, keep=["held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
