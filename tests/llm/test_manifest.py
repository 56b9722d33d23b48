"""The Merkle manifest against trees built one node at a time."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carepath.llm import manifest
from carepath.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, lo long, digest string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(enc, (r[0], r[3], r[2], r[4], text)))


def tree(level):
    """The levels from leaves to the top."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(levels, k):
    out = []
    for nodes in levels[:-1]:
        lo = k // 16 * 16
        out.append(("".join(nodes[lo:k]), "".join(nodes[k + 1 : lo + 16])))
        k //= 16
    return out


def brute(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[b"" if r[3] is None else b"=" + r[3].encode()].append((-(2**70) if r[0] is None else r[0], leaf(r, r[1]), r))
    trees = {g: tree([x[1] for x in sorted(v, key=lambda x: x[:2])]) for g, v in groups.items()}
    order = sorted(trees)
    top = tree([trees[g][-1][0] for g in order])
    for at, g in enumerate(order):
        for k, (_, digest, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            sides = path(trees[g], k) + path(top, at)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            x = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])) if hit else digest
            for left, right in sides:
                x = h(left, x, right)
            out.append((r[0], digest, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in sides]), x, x == top[-1][0]))
    return sorted(out, key=str)


def got(spark, rows):
    prepare(spark)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted((tuple(r) for r in manifest.verified(docs).collect()), key=str)


@pytest.mark.parametrize("case", ["mixed", "hot", "one", "lone sources", "copies"])
def test_manifest_against_trees(spark, case):
    r = random.Random(case)
    row = lambda i, s, t: (i, t, r.choice(["en", None]), s, r.choice([None, 7]), "k", 1, "d", "p")
    texts = ["Plain Text", "no capitals", None, "", "Über ß 語 ABC", "x" * 5000 + "Y"]
    if case == "mixed":
        rows = [row(i, r.choice([None, "", "a", "B", "é", "=", "-"]), r.choice(texts)) for i in range(-20, 300)] + [row(None, "a", "No id"), row(None, None, "No id")]
        rows += rows[:5] + [row(5, "a", "Other"), row(5, "a", "another")]
    elif case == "hot":  # three levels in one source, one node alone at the end of a run
        rows = [row(i, "hot", f"Text {i}") for i in range(16 * 16 + 1)] + [row(900 + i, f"s{i:02}", "T") for i in range(17)]
    elif case == "one":
        rows = [row(5, "a", "Only")]
    elif case == "lone sources":
        rows = [row(i, f"s{i}", "Lone") for i in range(40)]
    else:
        rows = [(7, "Same Text", "en", "a", 9, "k", 1, "d", "p")] * 50
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_intervals_nest(spark):
    prepare(spark)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    nodes = [r.asDict() for r in manifest.nodes_of(docs).collect()]
    assert len(nodes) == 300 + 2 * (10 + 1)
    for n in nodes:
        inside = [m for m in nodes if m["key"] == n["key"] and m["level"] == n["level"] - 1 and n["lo"] <= m["lo"] and m["hi"] <= n["hi"]]
        if n["level"]:
            assert n["digest"] == h(*[m["digest"] for m in sorted(inside, key=lambda m: m["lo"])])


def test_sql_gives_the_same_rows(spark, tmp_path):
    import duckdb

    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted((tuple(x) for x in db.sql(manifest.SQL).fetchall()), key=str)
    docs = prepare(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted((tuple(r) for r in manifest.verified(docs).collect()), key=str) == want
    assert {x[-1] for x in want} == {True, False}
