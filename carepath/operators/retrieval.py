"""Ranked search: BM25, dense cosine, reciprocal rank fusion, and choice without near-repeats."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carepath.functions.text import words

K1, B, RRF_K = 1.2, 0.75, 60


def _ranked(scored: DataFrame, id_col: str, limit: int) -> DataFrame:
    """The first `limit` rows by score, ties by id, with their rank; the sort keeps `limit` rows a task."""
    top = scored.orderBy(F.desc("score"), id_col).limit(limit)
    return top.select(id_col, "score", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str], *, limit: int = 50) -> DataFrame:
    """id, score and rank of the documents that hold any of the query's distinct terms."""
    terms = sorted(set(terms))
    if not terms:
        return docs.limit(0).select(id_col, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    times = lambda t: F.size(F.filter("w", lambda x: x == F.lit(t)))
    tf = [times(t).alias(f"tf{k}") for k, t in enumerate(terms)]
    counted = docs.select(id_col, words(F.col(text_col)).alias("w")).select(id_col, F.size("w").alias("dl"), *tf)
    s = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]).first()
    parts = []
    for k in range(len(terms)):
        f, df = F.col(f"tf{k}"), s[f"df{k}"]
        idf = F.log(F.lit(1 + (s["n"] - df + 0.5) / (df + 0.5)))
        parts.append(F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.lit(s["avgdl"])))).otherwise(0.0))
    any_ = reduce(lambda a, b: a | b, [F.col(f"tf{k}") > 0 for k in range(len(terms))])
    return _ranked(counted.where(any_).select(id_col, F.round(sum(parts[1:], parts[0]), 6).alias("score")), id_col, limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector at length 1; null for the zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def dense(vectors: DataFrame, id_col: str, vector_col: str, query: Sequence[float], *, limit: int = 50) -> DataFrame:
    """id, score and rank of the vectors by cosine with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    cosine = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return _ranked(vectors.select(id_col, F.round(cosine, 6).alias("score")), id_col, limit)


def fused(rankings: Sequence[DataFrame], id_col: str, *, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rankings (id, rank)."""
    every = reduce(DataFrame.unionByName, [r.select(id_col, "rank") for r in rankings])
    return _ranked(every.groupBy(id_col).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score")), id_col, limit)


#: Rows of a block of the searched table, and queries of a block; a task holds one of each.
BLOCK_ROWS, BLOCK_QUERIES = 50_000, 512


def _in_blocks(rows: DataFrame, queries: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Each block of rows (with an id) with each block of queries (with a q); `side` tells them apart, 0 for rows.

    Rows go out once for each block of queries, so what is shuffled is their product over the
    size of a block; no pair is a row.
    """
    n_rows, n_queries = rows.count(), queries.count()
    tasks = min(2 * rows.sparkSession.sparkContext.defaultParallelism, max(1, n_rows))  # small tables use all cores too
    across, down = max(tasks, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // BLOCK_QUERIES))
    left = rows.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(across)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("side", F.lit(0))
    right = queries.withColumn("y", F.pmod(F.xxhash64("q"), F.lit(down)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("side", F.lit(1))
    return left.unionByName(right, allowMissingColumns=True).groupBy("x", "y").applyInPandas(run, schema)


def _best(ids: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """The places of the `limit` best scores, ties by id; scores of -inf are none."""
    some = np.flatnonzero(scores > -np.inf)
    if len(some) > limit:
        some = some[scores[some] >= -np.partition(-scores[some], limit - 1)[limit - 1]]
    return some[np.lexsort((ids[some], -scores[some]))][:limit]


def _ranked_each(scored: DataFrame, query_id: str, id_col: str, limit: int) -> DataFrame:
    """The first `limit` rows of each query; what arrives are at most `limit` from each block."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(F.col("q").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def dense_each(vectors: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_col: str, *, limit: int = 50) -> DataFrame:
    """For every query vector: id, score and rank of the nearest vectors by cosine, over all of them.

    Zero and null vectors are near nothing. Scores are rounded to 6 digits before they are ranked.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["side"] == k] for k in (0, 1)]
        out = []
        if all(len(s) for s in sides):
            a, b = (np.array(s["v"].tolist(), np.float64) for s in sides)
            a, b = (m / np.where((n := np.sqrt((m * m).sum(axis=1, keepdims=True))) > 0, n, np.nan) for m in (a, b))
            ids = sides[0]["id"].to_numpy(np.int64)
            for q, scores in zip(sides[1]["q"], np.round(b @ a.T, 6), strict=True):
                for k in _best(ids, np.nan_to_num(scores, nan=-np.inf), limit):
                    out.append((int(q), int(ids[k]), float(scores[k])))
        return pd.DataFrame(out, columns=["q", "id", "score"])

    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_col).alias("v"))
    return _ranked_each(_in_blocks(rows, asked, run, "q long, id long, score double"), query_id, id_col, limit)


def bm25_each(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, query_id: str, query_col: str, *, limit: int = 50) -> DataFrame:
    """For every query text: id, score and rank of the documents that hold any of its distinct words, over all of them."""
    counted = docs.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("w"))
    terms = queries.select(F.col(query_id).cast("long").alias("q"), F.explode(F.array_distinct(words(F.col(query_col)))).alias("term"))
    s = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl")).first()
    df = counted.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(terms.select("term").distinct(), "term")
    weighed = terms.join(df, "term").select("q", "term", F.log(1 + (F.lit(s["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = weighed.groupBy("q").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    avgdl = s["avgdl"] or 1.0

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows, asked = (part[part["side"] == k] for k in (0, 1))
        wanted, postings, out = {t["term"] for ts in asked["terms"] for t in ts}, {}, []
        dl = np.array([len(w) for w in rows["w"]], np.float64)
        for k, w in enumerate(rows["w"]):
            for term, n in Counter(x for x in w if x in wanted).items():
                postings.setdefault(term, []).append((k, n))
        each = {}
        for term, xs in postings.items():
            at, f = (np.array(x) for x in zip(*xs, strict=True))
            each[term] = at, f * (K1 + 1) / (f + K1 * (1 - B + B * dl[at] / avgdl))
        ids = rows["id"].to_numpy(np.int64)
        for q, ts in zip(asked["q"], asked["terms"], strict=True):
            scores, held = np.zeros(len(ids)), np.zeros(len(ids), bool)
            for t in ts:
                if t["term"] in each:
                    at, x = each[t["term"]]
                    scores[at] += t["idf"] * x
                    held[at] = True
            scores = np.where(held, np.round(scores, 6), -np.inf)
            out += [(int(q), int(ids[k]), float(scores[k])) for k in _best(ids, scores, limit)]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    return _ranked_each(_in_blocks(counted, asked, run, "q long, id long, score double"), query_id, id_col, limit)


def fused_each(rankings: Sequence[DataFrame], query_id: str, id_col: str, *, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of rankings (query id, id, rank), for every query."""
    every = reduce(DataFrame.unionByName, [r.select(F.col(query_id).alias("q"), F.col(id_col).alias("id"), "rank") for r in rankings])
    return _ranked_each(every.groupBy("q", "id").agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score")), query_id, id_col, limit)


def jaccard(a: Column, b: Column) -> Column:
    """Shared words of all words of two word arrays; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def chosen(hits: DataFrame, id_col: str, text_col: str, *, excluded: Sequence[str] = (), limit: int = 4, similarity: float = 0.8) -> DataFrame:
    """Hits in rank order, without those excluded or too like one chosen before, up to `limit`.

    The hits of one search are few by construction (its limit), so the choice folds over one array.
    """
    rows = hits.where(~F.col(id_col).isin(list(excluded))) if excluded else hits
    item = F.struct("rank", F.col(id_col).alias("id"), F.array_distinct(words(F.col(text_col))).alias("w"))
    listed = rows.groupBy().agg(F.sort_array(F.collect_list(item)).alias("xs"))
    kind = listed.schema["xs"].dataType.simpleString()
    add = lambda out, x: F.when((F.size(out) < limit) & ~F.exists(out, lambda y: jaccard(y["w"], x["w"]) >= similarity), F.array_append(out, x)).otherwise(out)
    return listed.select(F.explode(F.aggregate("xs", F.array().cast(kind), add)).alias("x")).select(F.col("x.rank").alias("rank"), F.col("x.id").alias(id_col))
