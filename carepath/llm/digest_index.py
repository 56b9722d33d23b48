"""Exact deduplication against a minimal perfect hash of the digests already seen.

The texts without blanks are digested with SHA-256. A history's distinct digests are dealt to
buckets by their leading bits, and each bucket gets a minimal perfect hash: bit arrays, level
by level, in which a digest that meets no other sets its bit; its slot is the rank of that bit.
A slot holds the full digest, the locator of its winner (doc_id and code points) and its count.
New rows are first grouped by digest (combined before the shuffle, so a group of copies of any
size is one row for each task), then looked up bucket by bucket: a slot whose 32 bytes agree
makes them repeats of a known text, the rest are groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import BLANKS, discard, stored

#: Distinct digests of the history, and of the new rows, in a bucket, about; a bucket is what one call of the index works on.
BUCKET_KEYS = 1024
#: Bits of a level for each digest left.
SPARSE = 2.0


def digests(docs: DataFrame, seen: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seen, points (code points of the text) and digest (32 bytes) of every row; null is the empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(seen, F.lit(False)).alias("seen"), F.length(text).cast("long").alias("points"), F.unhex(F.sha2(bare, 256)).alias("digest"))


def grouped(rows: DataFrame) -> DataFrame:
    """digest, its winner's points and doc_id, and its number of rows."""
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("size")).select("digest", (-F.col("best.less")).alias("points"), F.col("best.doc_id").alias("doc_id"), "size")


def _positions(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    odd = np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) % 2**64)
    with np.errstate(over="ignore"):
        h = (keys[:, 1] ^ (keys[:, 2] * odd)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of bits for distinct digests (n x 4 words)."""
    left, levels = keys, []
    while len(left):
        size = max(64, int(SPARSE * len(left)))
        at = _positions(left, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[at]]
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each digest, or -1; for a digest that was not in the set any slot may come out."""
    out, base = np.full(len(keys), -1, np.int64), 0
    for level, bits in enumerate(levels):
        rest = np.flatnonzero(out < 0)
        if not len(rest):
            break
        at = _positions(keys[rest], level, len(bits))
        hit = bits[at]
        out[rest[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
    return out


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype="<u8").reshape(-1, 4)


def _bucketed(groups: DataFrame, bits: int) -> DataFrame:
    lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return groups.withColumn("bucket", F.shiftright(lead, 32 - bits).cast("int"))


def build_index(history: DataFrame, bits: int) -> DataFrame:
    """One row for each bucket: its levels and its slots (digests, points, doc_ids, sizes) in slot order."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        keys = _words(part["digest"])
        levels = perfect_hash(keys)
        part = part.iloc[np.argsort(slots(levels, keys))]
        ids = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
        return pd.DataFrame({
            "bucket": [part["bucket"].iloc[0]], "level_bits": [[len(x) for x in levels]], "levels": [b"".join(np.packbits(x).tobytes() for x in levels)],
            "digests": [b"".join(map(bytes, part["digest"]))], "points": [part["points"].tolist()], "doc_ids": [ids], "sizes": [part["size"].tolist()],
        })

    schema = "bucket int, level_bits array<long>, levels binary, digests binary, points array<long>, doc_ids array<long>, sizes array<long>"
    return _bucketed(history, bits).groupBy("bucket").applyInPandas(build, schema)


def look_up(index: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """digest, keep_id, keep_points and group_size over the history and the new groups together."""

    def probe(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        rows: list[pd.DataFrame] = []
        if len(index):
            x, at, levels = index.iloc[0], 0, []
            for n in x["level_bits"]:
                end = at + (int(n) + 7) // 8
                levels.append(np.unpackbits(np.frombuffer(x["levels"][at:end], np.uint8))[: int(n)].astype(bool))
                at = end
            held = [x["digests"][k : k + 32] for k in range(0, len(x["digests"]), 32)]
            known = pd.DataFrame({"digest": held, "points": np.array(x["points"], np.int64), "doc_id": pd.array(list(x["doc_ids"]), "Int64"), "size": np.array(x["sizes"], np.int64)})
            if len(new):
                words = _words(new["digest"])
                where = slots(levels, words)
                member = (where >= 0) & (np.frombuffer(x["digests"], "<u8").reshape(-1, 4)[where] == words).all(axis=1)  # all 32 bytes
                again, at = new[member], where[member]  # digests differ, so slots do
                rank = lambda ids: pd.array(ids, "Int64").to_numpy("int64", na_value=np.iinfo("int64").min)  # noqa: E731  as Spark sorts: null first
                points, ids = again["points"].to_numpy(), pd.array(again["doc_id"].tolist(), "Int64")
                old = known["points"].to_numpy()[at]
                better = (points > old) | ((points == old) & (rank(ids) < rank(known["doc_id"].iloc[at])))
                known.loc[at[better], "points"] = points[better]
                known.loc[at[better], "doc_id"] = ids[better]
                known.loc[at, "size"] += again["size"].to_numpy()
                new = new[~member]
            rows.append(known)
        if len(new):
            rows.append(pd.DataFrame({"digest": [bytes(d) for d in new["digest"]], "points": new["points"].to_numpy(), "doc_id": pd.array(new["doc_id"].tolist(), "Int64"), "size": new["size"].to_numpy()}))
        return pd.concat(rows, ignore_index=True)

    schema = "digest binary, points long, doc_id long, size long"
    found = _bucketed(new, bits).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, schema)
    return found.select("digest", F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, seen: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; `seen` marks the rows of the history.

    Of equal texts the row with the most code points stays, then the smallest doc_id. Null counts
    as empty, so null, empty and blank texts are one group. Rows that repeat doc_id and text are
    all marked as kept. doc_id is an integer or its digits. Whole texts of any length are digested
    in the JVM, an empty table gives no row, and other columns are not looked at.
    """
    rows = stored(digests(docs, seen, id_col=id_col, text_col=text_col), "digests")
    history, new = (stored(grouped(rows.where(which)), name) for which, name in (("seen", "history"), ("not seen", "new-groups")))
    # a bucket holds BUCKET_KEYS digests of either side at most, about
    bits = (max(history.count(), new.count()) // BUCKET_KEYS).bit_length()
    index = stored(build_index(history, bits), "digest-index")
    discard(history)
    groups = look_up(index, new, bits)
    # a large group of copies makes one skewed key here; the adaptive join splits its rows
    joined = rows.drop("seen").join(groups.hint("merge"), "digest", "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))



SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT doc_id, points, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
      first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
