"""The ranking of document pairs: its likelihood, its cut, held-out accuracy and odd tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from carepath.llm import preference as pf
from carepath.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string, held_out string, score string, t string, good string"
NONE = (None,) * 8


def prose(r, n):
    return " ".join("".join(r.choices("an be co da en fi go ha in ka lo me".split(), k=r.randint(1, 4))) for _ in range(n)) + "."


def corpus():
    r, rows, labels = random.Random(2), [], []
    for i in range(600):
        words = prose(r, r.randint(3, 120)).split()
        if bad := i % 6 == 0:
            words = [w.upper() + "!!" for w in words] if i % 4 == 0 else [w + r.choice(["###", "&&&"]) for w in words] if i % 4 == 2 else words[:2] * 20
        rows.append((i, " ".join(words), *NONE))
        labels.append((i, int(not bad), 0))
    return rows, labels


def tables(spark, rows, labels):
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in pf.quality_ranks(*tables(spark, rows, labels)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.98 * len(held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, labels = corpus()
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in pf.quality_ranks(*tables(spark, rows, x)).collect()} for x in (labels, turned))
    assert a == b


def test_odd_tables(spark):
    rows, labels = corpus()
    more = [(None, "no id", *NONE), (None, None, *NONE), (700, None, *NONE), (701, "", *NONE), (702, " \n\t", *NONE), (703, "x " * 200_000, *NONE), rows[3], rows[3], (704, "語 " * 9, *NONE)]
    told = labels + [(None, 1, 0), (None, 0, 0), (1, None, 0), (2, 1 - labels[2][1], 0), (9_999, 1, 1), (5, 7, 0), labels[3]]
    got = pf.quality_ranks(*tables(spark, rows + more, told)).collect()
    assert len(got) == len(rows) + len(more) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and len({r.score for r in got if r.doc_id in (700, 701)}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert pf.quality_ranks(*tables(spark, [], labels)).collect() == []
    for few in ([], [(1, 1, 0)], [(i, 1, 0) for i, _, _ in labels]):
        assert {r.score for r in pf.quality_ranks(*tables(spark, rows[:9], few)).collect()} == {0.5}


def test_ids_of_any_type(spark):
    docs, labels = tables(spark, *corpus())
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = pf.quality_ranks(text(docs), text(labels)).collect()
    assert {r.held_out for r in got if r.doc_id == "d7"} == {zlib.crc32(b"d7") % 5 == 0}


def test_newton_reaches_the_likeliest_weights():
    g = np.random.default_rng(1)
    x = g.normal(size=(60, 4))
    good = (x @ [1.0, -0.5, 0.0, 0.2] + g.normal(size=60)) > 0
    m = pf.learned(x, good, np.ones(60))
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6)
    a, b = pf.comparisons(int(good.sum()), int((~good).sum()))
    d = z[good][a] - z[~good][b]
    cost = lambda w: np.log1p(np.exp(-(d @ w))).mean() + pf.RIDGE / 2 * w @ w
    least = cost(m.w)
    for k in range(4):
        for e in (-1e-3, 1e-3):
            assert cost(m.w + e * np.eye(4)[k]) > least
    right = [((m.ranks(x) >= c) == good).sum() for c in m.ranks(x)]
    assert ((m.ranks(x) >= m.cut) == good).sum() == max(right)  # no cut agrees with more labels
    assert m.quantile == pytest.approx((m.ranks(x) < m.cut).mean())


def test_comparisons_reach_every_row():
    for n, m in ((1, 1), (5, 40), (40, 5), (300, 7)):
        a, b = pf.comparisons(n, m)
        assert len(set(zip(a, b))) == len(a) <= pf.COMPARISONS * (n + m)
        assert min(np.bincount(a, minlength=n)) >= min(pf.COMPARISONS, m) and min(np.bincount(b, minlength=m)) >= min(pf.COMPARISONS, n)


def test_a_share_tells_and_length_does_not():
    one, ten = (np.array(pf.features(" ".join(["Some words### here"] * k))) for k in (1, 10))
    place = {n: k for k, n in enumerate(pf.NAMES)}
    assert len(one) == len(pf.NAMES)
    assert one[place["#"]] == pytest.approx(ten[place["#"]], rel=0.05) and one[place["words with a symbol"]] == ten[place["words with a symbol"]]
    assert ten[place["word as before"]] == 0 and ten[place["words of repeated threes"]] > 0.9
