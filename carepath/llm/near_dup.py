"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact check.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of that set and a MinHash
   signature. Texts with equal sets are one class, so copies cost nothing from here on.
2. Classes that agree in a band of the signature meet in a bucket. Pairs in small buckets are
   compared at once. A large bucket is dealt to blocks: first each block with itself and with one
   pivot block, keeping each class's likest partners, so the work grows with the bucket's size;
   later classes outside the bucket's main component are compared with all of it, or, where they
   are many, with those of it that agree in one more band.
3. A comparison looks at the signatures in batches and stops as soon as the posterior probability
   that the similarity reaches the threshold falls under MISS.
4. Survivors are verified on full sets: first each class's likest partner, then, between different
   components only, all others. A link between two classes already connected changes nothing.

Linked pairs of similarity s share no band with probability (1 - s**ROWS)**BANDS: 2e-8 at 0.85
and 4e-6 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import discard, stored, valid
from carepath.llm.components import components

#: Bands and their rows, hashes of a batch, and the posterior under which a pair is dropped.
BANDS, ROWS, BATCH, MISS = 24, 4, 16, 1e-5
HASHES = BANDS * ROWS
#: Classes in a bucket that is compared at once; classes in a block of a larger one; likest partners kept for each class of a block.
SMALL, BLOCK, LIKEST = 32, 128, 2
#: Classes outside a bucket's main component up to which all of the bucket meets them (in up to 8 blocks); more must agree in a second band first.
OUTSIDERS = 8 * BLOCK
#: Ids or rows up to which a list of them is broadcast (8 or 16 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
KEPT_WORDS = 50_000
SEED = 71


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], width: int, words: dict) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle, one of none has none."""
    out = []
    for t in texts:
        ws = (t or "").encode().lower().split()  # bytes: lowers A-Z and splits at [\x20\x09-\x0D] only
        ids = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
        n = len(ids) - width + 1 if len(ids) >= width else min(1, len(ids))
        h = np.full(n, min(len(ids), width), np.uint64)
        for k in range(min(width, len(ids))):
            h = _mix(h, ids[k : k + n])
        out.append(np.unique(h))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes (one row for each set; sets are not empty)."""
    draw = np.random.default_rng(SEED)
    odd = (draw.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), "<u4")
    if sets:
        flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *(len(s) for s in sets[:-1])])
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(flat * odd[k], at)
    return out


def sketches(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, key (digest of the set; null for none) and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            sets = shingle_sets(b.column(2).to_pylist(), width, words)
            sig = iter(signatures([s for s in sets if len(s)]))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [next(sig).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_key", "n_shingles", "key", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), valid(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, key binary, sig binary")


def _full_sets(docs: DataFrame, *, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            sets = [s for s in shingle_sets(b.column(0).to_pylist(), width, words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "shingles"])

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>")


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    sig = sig.astype(np.uint64).reshape(-1, BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
    for k in range(ROWS):
        h = _mix(h, sig[:, :, k])
    return h


def _bands(classes: DataFrame) -> DataFrame:
    """band, bucket and key: BANDS rows for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _band_keys(_matrix(b.column(1).to_pylist()))
            n = len(h)
            keys = b.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(h.reshape(-1).view(np.int64)), keys], ["band", "bucket", "key"])

    return classes.select("key", "sig").mapInArrow(run, "band int, bucket long, key binary")


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u4").reshape(-1, HASHES)


@lru_cache
def least_matches(percent: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch: the fewest matches with which P(similarity >= percent/100 | matches) is still `miss` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its tail is that of a binomial.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = lambda m, n=n: sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def likely(sig: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) of rows that survive every batch, and their share of matches."""
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(percent)):
        a = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (sig[i, a] == sig[j, a]).sum(axis=1)
        stay = matches >= least
        i, j, matches = i[stay], j[stay], matches[stay]
    return i, j, matches / HASHES


_PAIR = "a binary, b binary, share double"


def _ordered(keys: list[bytes], i: np.ndarray, j: np.ndarray, share: np.ndarray) -> pd.DataFrame:
    pairs = [(keys[x], keys[y]) if keys[x] < keys[y] else (keys[y], keys[x]) for x, y in zip(i, j, strict=True)]
    return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "share": share.astype(float)})


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs of buckets of at most SMALL classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sigs, left, right = [], [], [], []
            for got in b.column(0).to_pylist():
                x, y = np.triu_indices(len(got), 1)
                left.append(x + len(keys))
                right.append(y + len(keys))
                keys += [g["key"] for g in got]
                sigs += [g["sig"] for g in got]
            if keys:
                yield pa.RecordBatch.from_pandas(_ordered(keys, *likely(_matrix(sigs), np.concatenate(left), np.concatenate(right), percent)), schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("share", pa.float64())]), preserve_index=False)

    return members.groupBy("bucket").agg(F.collect_list(F.struct("key", "sig")).alias("got")).select("got").mapInArrow(run, _PAIR)


def _likest(i: np.ndarray, j: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the `most` likest of either of their two ends."""
    stay = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((-share, end))
        starts = np.r_[True, end[order][1:] != end[order][:-1]] if len(order) else np.zeros(0, bool)
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
        stay[order[rank < most]] = True
    return stay


def _grid(part: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """keys, signatures and labels of a group's rows, and all (left, right) places with different labels."""
    keys, sig, labels = [bytes(k) for k in part["key"]], _matrix([bytes(s) for s in part["sig"]]), [bytes(k) for k in part["label"]]
    _, label = np.unique(np.array(labels, object), return_inverse=True)
    side = part["side"].to_numpy()
    i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    other = label[i] != label[j]
    return keys, sig, labels, i[other], j[other]


def _two_sided(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _dealt(n: Column) -> Column:
    return F.pmod(F.xxhash64("key", "bucket"), n).cast("int")


def _first_look(large: DataFrame, percent: int) -> DataFrame:
    """Each block of a large bucket with itself and with the bucket's pivot block."""
    rows = large.withColumn("x", _dealt(_blocks("n"))).withColumn("label", F.col("key"))
    left = rows.select("bucket", "x", F.lit(0).alias("y"), "band", "key", "sig", "label")
    pivots = rows.where("x = 0").withColumn("x", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)))
    right = left.unionByName(pivots.where("x > 0").select("bucket", "x", F.lit(0).alias("y"), "band", "key", "sig", "label"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys, sig, _, i, j = _grid(part)
        i, j, share = likely(sig, i, j, percent)
        stay = _likest(i, j, share, LIKEST)
        return _ordered(keys, i[stay], j[stay], share[stay])

    return _two_sided(left, right).groupBy("bucket", "x", "y").applyInPandas(run, _PAIR)


def _outsiders(large: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, x, n, outs, band, key, sig, label and out of the classes of large buckets with several components; out: not in the bucket's main one.

    A bucket's rows meet its main component by (bucket, block x), so no task gets a hot bucket whole.
    """
    named = large.join(labels.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left").withColumn("label", F.coalesce("root", "key")).drop("root")
    named = stored(named.withColumn("x", _dealt(_blocks("n"))), "named")
    sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("n_labels"), F.max("n").alias("n")).where("n_labels > 1")
    to = main.select("bucket", F.col("top.label").alias("main"), (F.col("n") - F.col("top.m")).alias("outs"), F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("x"))
    out = named.join(to.hint("merge"), ["bucket", "x"]).select("bucket", "x", "n", "outs", "band", "key", "sig", "label", (F.col("label") != F.col("main")).alias("out"))
    out = stored(out, "outsiders")
    discard(named)
    return out


def _two_bands(live: DataFrame) -> DataFrame:
    """sub, bucket, key, label and out: each class of a bucket once for each other band that it has; sub stands for the bucket and that band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            bucket, band = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            sub = _band_keys(_matrix(b.column(3).to_pylist()))
            sub = _mix(_mix(np.uint64(1), np.repeat(bucket, BANDS)), sub.reshape(-1))
            other = np.flatnonzero(np.tile(np.arange(BANDS), n) != np.repeat(band, BANDS))
            rows = pa.array(other // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(sub[other].view(np.int64)), *(b.column(k).take(rows) for k in (0, 2, 4, 5))], ["sub", "bucket", "key", "label", "out"])

    return live.select("bucket", "band", "key", "sig", "label", "out").mapInArrow(run, "sub long, bucket long, key binary, label binary, out boolean")


def _meeting_again(live: DataFrame) -> DataFrame:
    """sub, n, bucket, key, label and out where an outsider and a class of another component agree in a second band."""
    subs = _two_bands(live)
    shared = subs.groupBy("sub").agg(F.count(F.lit(1)).alias("n"), F.max("out").alias("any"), F.min("label").alias("least"), F.max("label").alias("most"))
    shared = stored(shared.where("any and least <> most").select("sub", "n"), "two-bands")
    out = stored(subs.join(shared.hint("merge"), "sub"), "two-band-members")
    discard(shared)
    return out


def _few_pairs(again: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs of different components, one an outsider, of two bands with at most BLOCK classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for got in b.column(0).to_pylist():
                _, label = np.unique(np.array([g["label"] for g in got], object), return_inverse=True)
                out = np.array([g["out"] for g in got])
                i, j = np.triu_indices(len(got), 1)
                ask = (label[i] != label[j]) & (out[i] | out[j])
                found = _ordered([g["key"] for g in got], *likely(_matrix([g["sig"] for g in got]), i[ask], j[ask], percent))
                yield pa.RecordBatch.from_pandas(found, schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("share", pa.float64())]), preserve_index=False)

    few = again.where(F.col("n") <= BLOCK).join(classes.select("key", "sig").hint("merge"), "key")
    return _one(few.groupBy("sub").agg(F.collect_list(F.struct("key", "sig", "label", "out")).alias("got")).select("got").mapInArrow(run, _PAIR))


def _crowd_links(crowd: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (u, v) between the outsiders of a bucket and all its others.

    A group is one block of outsiders with one block of the others. Every pair in it of different
    components is compared, in the first band that it shares, likest first, and verified on full
    sets unless a link found before it has connected the two components.
    """
    sizes = crowd.groupBy("bucket").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("out").cast("long")).alias("outs"), F.max("n").alias("n")).where("outs > 0")
    to = sizes.select("bucket", "all", "outs", F.explode(F.sequence(F.lit(0), _blocks("n") - 1)).alias("x"))
    crowd = crowd.drop("outs").join(to.hint("merge"), ["bucket", "x"]).drop("x").join(sets.hint("merge"), "key")
    columns = ["bucket", "x", "y", "band", "key", "sig", "label", "shingles"]
    left = crowd.where("out").withColumn("x", _dealt(_blocks("outs"))).withColumn("y", F.explode(F.sequence(F.lit(0), _blocks("all") - 1)))
    right = crowd.withColumn("y", _dealt(_blocks("all"))).withColumn("x", F.explode(F.sequence(F.lit(0), _blocks("outs") - 1)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        keys, sig, labels, i, j = _grid(part)
        i, j, share = likely(sig, i, j, percent)
        first = np.ones(len(i), bool)
        for k in range(int(part["band"].iloc[0])):
            a = slice(k * ROWS, (k + 1) * ROWS)
            first &= (sig[i, a] != sig[j, a]).any(axis=1)
        i, j, share = i[first], j[first], share[first]
        whole, joined, out = [np.asarray(s) for s in part["shingles"]], {}, []

        def root(x: bytes) -> bytes:
            while x in joined:
                x = joined[x]
            return x

        for k in np.argsort(-share, kind="stable"):
            x, y = int(i[k]), int(j[k])
            a, b = root(labels[x]), root(labels[y])
            if a != b:
                common = len(np.intersect1d(whole[x], whole[y], assume_unique=True))
                if 100 * common >= percent * (len(whole[x]) + len(whole[y]) - common):
                    joined[a] = b
                    out.append((keys[x], keys[y]))
        return pd.DataFrame(out, columns=["u", "v"])

    return _two_sided(left.select(columns), right.select(columns)).groupBy("bucket", "x", "y").applyInPandas(run, "u binary, v binary")


def _one(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.max("share").alias("share"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold on full sets."""
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _precedence() -> Column:
    """What decides which row of a group stays: the least."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ends = labels.select("node", "root")
    x = pairs.join(ends.select(F.col("node").alias("a"), F.col("root").alias("ra")).hint("merge"), "a", "left")
    x = x.join(ends.select(F.col("node").alias("b"), F.col("root").alias("rb")).hint("merge"), "b", "left")
    return x.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "share")


def _grouped(docs: DataFrame, *, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and stays of every row.

    `stays` marks of each group the row with the smallest id (null ids last, ties by a hash of the
    text), and every row without words.
    """
    rows = stored(sketches(docs, id_col=id_col, text_col=text_col, width=width), "sketches")
    classes = stored(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(_precedence()).alias("best"), F.first("sig").alias("sig")), "classes")
    bands = _bands(classes)
    shared = stored(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = stored(bands.join(shared.hint("merge"), "bucket"), "members")
    with_sig = members.join(classes.select("key", "sig").hint("merge"), "key")

    meeting = members.select("key").distinct().join(classes.select("key", "rep").hint("merge"), "key").select("rep").distinct()
    meeting = meeting_rows = stored(meeting, "meeting")
    if meeting.count() <= BROADCAST_IDS:
        meeting = F.broadcast(meeting)
    some = docs.select(F.col(id_col).cast("long").alias("id"), valid(F.col(text_col)).alias("text")).join(meeting, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = stored(_full_sets(some, width=width).dropDuplicates(["key"]), "shingle-sets")

    large = stored(with_sig.where(F.col("n") > SMALL), "large-buckets")
    pairs = stored(_one(_small_pairs(with_sig.where(F.col("n") <= SMALL), percent).unionByName(_first_look(large, percent))), "pairs")
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "share").unionByName(pairs.select(F.col("b").alias("x"), "a", "b", "share"))
    likest = ends.groupBy("x").agg(F.max(F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    labels = components(_verified(likest, sets, percent))

    # what is connected already comes back as one link to its root, so later rounds are short
    as_links = lambda found: found.select(F.col("node").alias("u"), F.col("root").alias("v"))
    labels = components(as_links(labels).unionByName(_verified(_across(pairs, labels), sets, percent)))
    if not large.isEmpty():
        live = _outsiders(large, labels)
        near, far = live.where(F.col("outs") <= OUTSIDERS), live.where(F.col("outs") > OUTSIDERS)
        found = [_crowd_links(near, sets, percent)]
        if not far.isEmpty():
            # linked pairs of similarity 0.8 share fewer than two bands with probability 6e-5; unlike classes
            # that one common passage brought into a bucket share no other and are not compared
            again = _meeting_again(far)
            crowd = stored(far.join(again.where(F.col("n") > BLOCK).select("bucket", "key").distinct().hint("merge"), ["bucket", "key"]), "crowd")
            found += [_verified(_across(_few_pairs(again, classes, percent), labels), sets, percent), _crowd_links(crowd, sets, percent)]
        links = stored(reduce(DataFrame.unionByName, found), "outsider-links")
        if not links.isEmpty():
            labels = components(as_links(labels).unionByName(links))
        discard(live, links)
    discard(shared, members, meeting_rows, sets, large, pairs)

    rooted = classes.select("key", "rep", "best").join(labels.select(F.col("node").alias("key"), "root").hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.min("best").alias("best"))
    of_class = rooted.drop("best").join(least.hint("merge"), "root").select("key", "component_id", "best")
    # copies of one text share a key; the adaptive join splits the rows of a hot one
    out = rows.select("doc_id", "text_key", "n_shingles", "key").join(of_class.hint("merge"), "key", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_key", "n_shingles", "component_id", (F.col("key").isNull() | (_precedence() == F.col("best"))).alias("stays"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Links have a Jaccard similarity of percent/100 or more between sets of `width`-word shingles.
    component_id is the smallest doc_id reachable. A text without words (null, empty, blank) is
    linked with nothing and its own component. Rows that repeat a doc_id are kept alike.
    doc_id is an integer or its digits. Whole texts of any length are read (what is no UTF-8 as
    U+FFFD), an empty table gives no row, and other columns are not looked at.
    """
    out = _grouped(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: of each group the one with the smallest id; same columns.

    Rows are told apart by id and text, so ids may be null or repeated. A null id comes after all
    others, and a hash of the text decides between equal ids. Of rows that agree in id and text
    one stays; rows with neither an id nor words all stay. A row is one column on the way, so other
    columns may have any names.
    """
    found = stored(_grouped(docs, id_col=id_col, text_col=text_col, width=width, percent=percent), "near-duplicates")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"))

    def these(kept: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """The rows whose id and text are (left_semi) or are not (left_anti) among others."""
        other = other.select(F.col("doc_id").alias("i"), F.col("text_key").alias("t"))
        return kept.join(F.broadcast(other) if few else other, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("t")), how)

    gone = stored(found.where(~F.col("stays")).select("doc_id", "text_key").distinct(), "dropped")
    few = gone.count() <= BROADCAST_IDS
    stay = these(rows, gone, "left_anti")
    some = found.where("stays and (n_shingles > 0 or doc_id is not null)")
    again = stored(some.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if (n := again.count()) == 0:
        return stay.select("row.*")
    few = few and n <= BROADCAST_IDS
    once = these(stay, again, "left_semi").dropDuplicates(["doc_id", "text_key"])
    return these(stay, again, "left_anti").unionByName(once).select("row.*")


def sql(width: int, percent: int) -> str:
    """The same components for DuckDB, by counting the shingles that every two texts share."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: {shingle}) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT u AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(v) AS component_id, u = min(v) AS kept FROM r LEFT JOIN n ON u = n.doc_id GROUP BY u"""
