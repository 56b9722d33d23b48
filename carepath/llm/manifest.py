"""A Merkle manifest of a table: nodes labelled with the interval of leaf ranks that they cover.

Every row is a leaf, every source a tree whose nodes have up to FAN children, and the subroots
are the leaves of one more tree. A node of level L covers the ranks [lo, hi) of its source, where
lo is a multiple of FAN^L, so it and the node above it meet in the bucket lo div FAN^(L+1) and by
containment of their intervals; its siblings are what the interval of the node above holds besides
its own. Paths go down level by level: a run of leaves gets the siblings of all nodes above it once,
and the proofs of its leaves are made beside each other from that one row.

Leaves are ranked by ranges of (source, id): each range is numbered where it lies and the numbers
before it are added, so a source with any share of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carepath.llm.common import discard, lower_ascii, stored

#: Children of a node at most, the columns of a leaf in order, and one in how many rows is tampered with.
FAN, FIELDS, TAMPERED = 16, ("doc_id", "source", "lang", "n_chars", "text"), 5
#: Ranges and sources up to which their starts are broadcast, at about 100 bytes each.
BROADCAST_ROWS = 200_000


def sealed(values: Sequence[Column]) -> Column:
    """SHA-256 of values one after another, each with its number of UTF-8 bytes; null is a dash."""
    text = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*parts), 256)


def _group(source: Column) -> Column:
    """A source as a key that is never null and sorts null first, then by bytes."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """key, doc_id, digest and changed: the digest of the tampered row where tampering changes it, else null."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % TAMPERED == 0, F.lit(False))
    lowered = lower_ascii(F.col(text_col))
    other = sealed([lowered if f == text_col else F.col(f) for f in fields])
    changed = F.when(hit & (lowered != F.col(text_col)), other)
    return docs.select(_group(F.col(source_col)).alias("key"), F.col(id_col).alias("doc_id"), sealed([F.col(f) for f in fields]).alias("digest"), changed.alias("changed"))


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows with their place `lo` within their key, from 0, and the key's number of rows `size`."""
    cut = [F.col("key"), *[F.col(c).asc_nulls_first() for c in order], F.col("__any")]  # rows alike in all else part by __any
    placed = rows.withColumn("__any", F.monotonically_increasing_id()).repartitionByRange(*cut).sortWithinPartitions(*cut)
    placed = stored(placed.drop("__any").withColumn("__at", F.monotonically_increasing_id()), f"{name}-order").withColumn("__part", F.shiftright("__at", 33))
    starts = placed.groupBy("key", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))  # ranges + keys rows at most
    by_key = Window.partitionBy("key")
    before = F.sum("__n").over(by_key.orderBy("__part")) - F.col("__n")
    starts = stored(starts.select("key", "__part", "__first", before.alias("__before"), F.sum("__n").over(by_key).alias("size")), f"{name}-starts")
    few = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return placed.join(few, ["key", "__part"]).withColumn("lo", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__part", "__first", "__before")


def _above(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """The nodes over those of `level`: key, size, lo, hi, digest and the members they cover."""
    member = F.struct("lo", "hi", "digest", *carried)
    runs = nodes.groupBy("key", "size", F.floor(F.col("lo") / FAN ** (level + 1)).alias("bucket")).agg(F.sort_array(F.collect_list(member)).alias("members"))  # FAN at most
    digest = F.sha2(F.array_join(F.transform("members", lambda m: m["digest"]), ""), 256)
    return runs.select("key", "size", F.element_at("members", 1)["lo"].alias("lo"), F.element_at("members", -1)["hi"].alias("hi"), digest.alias("digest"), "members")


def levels(ranks: DataFrame, name: str, *carried: str) -> list[DataFrame]:
    """The stored nodes of levels 1, 2, ... of every key; a key with one leaf has none."""
    most = ranks.agg(F.max("size")).first()[0] or 0
    out: list[DataFrame] = []
    nodes = ranks.withColumn("hi", F.col("lo") + 1)
    while FAN ** len(out) < most:
        level = len(out)
        some = nodes.where(F.col("size") > FAN**level)  # others have ended in one node
        out.append(stored(_above(some, level, *(carried if level == 0 else ())), f"{name}-{level + 1}"))
        nodes = out[-1]
    return out


def tops(ranks: DataFrame, nodes: Sequence[DataFrame]) -> DataFrame:
    """key and digest of the node that covers all of a key."""
    lone = ranks.where("size = 1").select("key", "digest")
    return reduce(DataFrame.unionByName, [n.where("hi - lo = size").select("key", "digest") for n in nodes], lone)


def _sides(members: Column, lo: Column, hi: Column) -> Column:
    """The digests on the left and on the right of [lo, hi) within a node's members."""
    glued = lambda part: F.array_join(F.transform(part, lambda m: m["digest"]), "")
    left, right = F.filter(members, lambda m: m["hi"] <= lo), F.filter(members, lambda m: m["lo"] >= hi)
    return F.struct(glued(left).alias("left"), glued(right).alias("right"))


def paths(ranks: DataFrame, nodes: Sequence[DataFrame], heads: DataFrame, name: str, *carried: str) -> DataFrame:
    """key, digest, the carried columns and path of every leaf, and the columns of `heads`.

    `heads` has key and path, the path of each key's top. A path lists the digests on the left and
    on the right of a node and of each node above it.
    """
    more = [c for c in heads.columns if c not in ("key", "path")]
    above: DataFrame | None = None
    for level in range(len(nodes), 0, -1):
        here = nodes[level - 1]
        found = here.where("hi - lo = size").join(heads, "key")
        if above is not None:
            inner = here.where("hi - lo < size").withColumn("bucket", F.floor(F.col("lo") / FAN ** (level + 1)))
            over = above.select("key", F.floor(F.col("lo") / FAN ** (level + 1)).alias("bucket"), F.struct("lo", "hi", "members", "path").alias("up"), *more)
            met = inner.join(over, ["key", "bucket"]).where("up.lo <= lo and hi <= up.hi")
            path = F.concat(F.array(_sides(F.col("up.members"), F.col("lo"), F.col("hi"))), F.col("up.path"))
            found = found.unionByName(met.withColumn("path", path).drop("bucket", "up"))
        above = stored(found, f"{name}-paths-{level}") if level > 1 else found
    lone = ranks.where("size = 1").join(heads, "key").select("key", "digest", *carried, "path", *more)
    if above is None:
        return lone
    each = above.select("key", "path", "members", *more, F.explode("members").alias("m"))
    path = F.concat(F.array(_sides(F.col("members"), F.col("m.lo"), F.col("m.hi"))), F.col("path"))
    return each.select("key", "m.digest", *[F.col(f"m.{c}") for c in carried], path.alias("path"), *more).unionByName(lone)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def nodes_of(docs: DataFrame, fields: Sequence[str] = FIELDS, **columns: str) -> DataFrame:
    """The manifest of each source: key ('=' and the source, '-' for null), level, lo, hi and digest of every node, leaves at level 0."""
    ranks = stored(ranked(leaves(docs, fields, **columns), ["doc_id", "digest"], "merkle"), "merkle-0")
    cols = ["key", "lo", "hi", "digest"]
    every = [ranks.withColumn("hi", F.col("lo") + 1), *levels(ranks, "merkle")]
    return reduce(DataFrame.unionByName, [n.select(F.lit(k).alias("level"), *cols) for k, n in enumerate(every)])


def verified(docs: DataFrame, fields: Sequence[str] = FIELDS, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Ids ascend as their type sorts, null first; rows that repeat an id within a source go by the
    digest of the leaf, and rows alike in all fields by any order, as it changes nothing. Null is
    not the empty text, and a null source is a source of its own that comes first. Whole texts of
    any length are digested where they are read and never shuffled; their bytes are taken as they
    are, UTF-8 or not. An empty table gives no row, and columns not among `fields` are not looked at.
    """
    found = stored(leaves(docs, fields, id_col=id_col, source_col=source_col, text_col=text_col), "merkle-leaves")  # ranges are sampled first, texts digested once
    carried = ["doc_id", "changed"]
    ranks = stored(ranked(found, ["doc_id", "digest"], "merkle"), "merkle-0")
    nodes = levels(ranks, "merkle", *carried)
    roots = tops(ranks, nodes).select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    ends = stored(ranked(roots, ["group"], "merkle-roots"), "merkle-roots-0")
    over = levels(ends, "merkle-roots", "group")
    root = tops(ends, over).first()
    if root is None:
        return found.limit(0).select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = docs.sparkSession.range(1).select(F.lit("").alias("key"), none.alias("path"))
    heads = stored(paths(ends, over, top, "merkle-roots", "group").select(F.col("group").alias("key"), F.col("digest").alias("subroot"), "path"), "merkle-heads")
    discard(ends, *over)
    rows = paths(ranks, nodes, heads, "merkle", *carried)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"]).alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(deep: int = 5, wide: int = 4) -> str:
    """Levels are written out: up to FAN^deep rows of a source, FAN^wide sources."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = " || ".join(enc(c) for c in FIELDS)
    other = " || ".join(enc(low if c == "text" else c) for c in FIELDS)
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"
    bits = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)"
    parts = [
        f"bytes AS (SELECT list(({bits})::BIGINT ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))",
        f"a AS (SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({plain}) AS leaf, sha256({other}) AS low, coalesce({crc} % {TAMPERED} = 0, false) AS hit FROM documents, bytes)",
        "s0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, leaf AS h, doc_id, CASE WHEN hit THEN low ELSE leaf END AS x FROM a)",
    ]

    def climb(name: str, n: int) -> None:
        for j in range(n):
            w = f"OVER (PARTITION BY g, k // {FAN} ORDER BY k ROWS BETWEEN"
            left, right = f"coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '')", f"coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"
            parts.append(f"{name}p{j} AS (SELECT g, k, h, {left} AS l, {right} AS r, count(*) OVER (PARTITION BY g) AS n FROM {name}{j})")
            parts.append(f"{name}{j + 1} AS (SELECT g, k // {FAN} AS k, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM {name}p{j} GROUP BY g, k // {FAN}, n)")

    climb("s", deep)
    parts.append(f"r0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS k, h, g AS source FROM s{deep})")
    climb("r", wide)

    def fold(rows: str, name: str, at: str, g: str, n: int) -> str:
        for j in range(n):
            parts.append(
                f"{rows}{name}{j + 1} AS (SELECT f.* EXCLUDE (x, proof), CASE WHEN n = 1 THEN x ELSE sha256(l || x || r) END AS x, CASE WHEN n = 1 THEN proof ELSE proof || l || r END AS proof "
                f"FROM {rows}{name}{j} f JOIN {name}p{j} p ON p.g = {g} AND p.k = f.{at} // {FAN**j})"
            )
        return f"{rows}{name}{n}"

    parts.append("fs0 AS (SELECT doc_id, g AS source, k AS at, h AS leaf, x, '' AS proof FROM s0)")
    last = fold("f", "s", "at", "f.source", deep)
    parts.append(f"fr0 AS (SELECT f.doc_id, f.leaf, f.x, f.proof, r0.k AS place, r0.h AS subroot FROM {last} f JOIN r0 ON r0.source = f.source)")
    last = fold("f", "r", "place", "''", wide)
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified FROM {last}, r{wide}"


SQL = _sql()
