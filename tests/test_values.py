"""Written values, texts, stores and reports."""

import unicodedata

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carepath.functions import clinical as cl
from carepath.functions import labs, text, times
from carepath.operators import core, evaluation, retrieval
from carepath.sources import reports, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_numbers(spark):
    got = many(spark, labs.number, ["1.40", "1,234.5", "1.234,5", "1.234", "1,5", "<= 0,05", "−3", "1.234.567", "12a", "", None, "0.123"])
    assert [None if x is None else float(x) for x in got] == [1.4, 1234.5, 1234.5, None, 1.5, 0.05, -3.0, 1234567.0, None, None, None, 0.123]
    assert one(spark, labs.number(F.lit("1.234"), F.lit(","))) == Decimal(1234)
    assert one(spark, labs.number(F.lit("1.234"), F.lit("."))) == Decimal("1.234")
    assert many(spark, labs.comparator, ["=< 3", "≥4", "<5", "6"]) == ["<=", ">=", "<", None]
    assert many(spark, labs.half_unit, ["1.20", "1.2", "12"]) == pytest.approx([0.005, 0.05, 0.5])
    assert one(spark, labs.separator_evidence(F.lit("Hb 12,5 at 10:30 and 1.234"))) == [","]
    assert many(spark, labs.separator_evidence, ["ore 08.30", "h. 12.30, 0.7", "12.30 h"]) == [[], ["."], ["."]]
    assert [float(x) for x in many(spark, labs.number, ["1 234,5", "1'234.5", "12\u00a0345"])] == [1234.5, 1234.5, 12345.0]


def test_units_and_names(spark):
    assert many(spark, labs.ucum, ["mg/dL", " µmol / L", "mL/min/1,73 m²", "mcg/L", "MG/G creat", "cups", None]) == ["mg/dL", "umol/L", "mL/min/{1.73_m2}", "ug/L", "mg/g", None, None]
    assert many(spark, labs.analyte_of_name, ["Creatinina sierica", "HGB", "eGFR (CKD-EPI)", "Velocità di filtrazione glomerulare stimata:", "Glucose"]) == ["creatinine", "hemoglobin", "egfr", "egfr", None]
    assert many(spark, labs.egfr_method, ["eGFR MDRD", "eGFR CKD-EPI 2021", "CKD EPI", "eGFR"]) == ["MDRD", "CKD-EPI 2021", "CKD-EPI", "unspecified"]
    ranges = many(spark, labs.reference_range, ["[0.6 - 1.2]", "< 30", "up to 5", ">= 60", "fino a 3,5", "negative", "-2 ÷ +3", "=> 4", "above 7", "1—2", "=< 9"])
    assert [None if r is None else tuple(None if x is None else float(x) for x in r) for r in ranges] == [(0.6, 1.2), (None, 30.0), (None, 5.0), (60.0, None), (None, 3.5), None, (-2.0, 3.0), (4.0, None), (7.0, None), (1.0, 2.0), (None, 9.0)]


def test_dates(spark):
    got = many(spark, times.report_date, ["2025-03-01", "13/02/2025", "02/13/2025", "02/03/2025", "05/05/2025", "3 marzo 2025", "March 3, 2025", "31/02/2025", "soon"])
    d = date
    assert got == [d(2025, 3, 1), d(2025, 2, 13), d(2025, 2, 13), None, d(2025, 5, 5), d(2025, 3, 3), d(2025, 3, 3), None, None]
    assert many(spark, times.report_date, ["3 Sept 2025", "Sept. 3, 2025"]) == [d(2025, 9, 3)] * 2
    assert [one(spark, times.shown(F.lit("2025-03-04").cast("date"), F.lit(p))) for p in ("day", "month", "year", "instant")] == ["04/03/2025", "03/2025", "2025", "04/03/2025"]
    points = many(spark, times.timepoint, ["2025", "2025-02", "2025-02-30", "2025-01-01T23:30:00-05:00", "2025-01-01T23:30:00"])
    assert [p and (p["date"], p["precision"]) for p in points] == [(d(2025, 1, 1), "year"), (d(2025, 2, 1), "month"), None, (d(2025, 1, 1), "instant"), None]
    months = lambda a, b: one(spark, cl.completed_months(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert months("2024-02-29", "2025-02-28") == 11 and months("2000-01-31", "2000-02-29") == 0


def test_rules_of_thumb(spark):
    assert one(spark, cl.ckd_epi_2021(F.lit(1.0), F.lit(50), F.lit(False))) == pytest.approx(91.69148961281194)
    assert [one(spark, cl.at_least(F.lit(float(v)), F.lit(c), 30)) for v, c in ((30, None), (29, None), (30, "<"), (31, "<"), (30, ">"), (29, ">"), (30, "<="), (29, "<="))] == [True, False, False, None, True, None, None, False]
    assert evaluation.exact_interval(0, 10) == pytest.approx((0, 0.3085), abs=1e-3)
    assert evaluation.exact_interval(10, 10) == pytest.approx((0.6915, 1), abs=1e-3)


def test_texts(spark):
    assert one(spark, text.tokens(F.lit("Hb ≤ -3.5 g/dL, café"))) == ["hb", "<=", "-3.5", "g", "dl", "café"]
    assert text._html_lines("<nav>x</nav><main><p>a <b>b</b><table><tr><td>c<td>d</table>m<sup>2</sup></main>out") == "a b\nc | d\nm^2"
    long = " ".join(["word"] * 250) + "."
    assert [len(p.split()) for p in text.packed(text.paragraphs(["Short one.", long]))] == [2, 200, 50] or len(text.packed([long])) == 2
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three five four six"), (3, None)], "id int, text string")
    quotes = spark.createDataFrame([(9, "Two, three four FIVE six"), (8, "six")], "q int, text string")
    assert [tuple(r) for r in text.contiguous(docs, "id", "text", quotes, "q", "text").orderBy("q").collect()] == [(1, 8), (2, 8), (1, 9)]
    assert text.contiguous(docs, "id", "text", quotes.limit(0), "q", "text").count() == 0


def test_choice_without_repeats(spark):
    hits = spark.createDataFrame([(1, "a", "one two three"), (2, "b", "three two one"), (3, "c", "other words"), (4, "d", "more words still")], "rank int, id string, text string")
    assert [r["id"] for r in retrieval.chosen(hits, "id", "text", excluded=["c"], limit=2).orderBy("rank").collect()] == ["a", "d"]


def test_searches_for_many_queries(spark, monkeypatch):
    import numpy as np

    draw = np.random.default_rng(2)
    v = draw.normal(size=(60, 4)).round(3)
    v[7] = 0
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None)], "id long, v array<double>")
    asked = rows.where("id % 10 = 0 or id = 7").withColumnRenamed("id", "q")
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 13)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)
    got = {}
    for r in retrieval.dense_each(rows, "id", "v", asked, "q", "v", limit=5).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["id"]
    with np.errstate(invalid="ignore"):
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        score = {k: round(float(unit[q] @ unit[k]), 6) for k in range(60) if k != 7}
        assert [got[q][k] for k in range(1, 6)] == sorted(score, key=lambda k: (-score[k], k))[:5]
    assert 7 not in got
    docs = spark.createDataFrame([(1, "kidney stone stone"), (2, "kidney"), (3, "other words"), (4, None)], "id long, text string")
    quest = spark.createDataFrame([(5, "stone kidney"), (6, "nothing"), (7, None)], "q long, text string")
    hits = retrieval.bm25_each(docs, "id", "text", quest, "q", "text", limit=2).collect()
    assert [(r["q"], r["id"], r["rank"]) for r in sorted(hits, key=lambda r: r["rank"])] == [(5, 1, 1), (5, 2, 2)]
    assert retrieval.dense_each(rows.limit(0), "id", "v", asked, "q", "v").count() == 0


def test_runs_and_ranks(spark):
    e = spark.createDataFrame([("u", k, v) for k, v in enumerate([1, 9, 1, 1])] + [("w", 0, 9), ("n", 0, None)], "k string, t int, v int")
    got = core.trailing_run(e, ["k"], ["t"], F.col("v") < 5, F.date_add(F.lit("2020-01-01"), F.col("t")), span_days=1).collect()
    assert [(r["k"], r["n"], r["persistent"]) for r in got] == [("u", 2, True)]
    v = spark.createDataFrame([("k", float(x)) for x in (4, 1, 3, 2, 2)] + [("one", 7.0)], "k string, v double")
    ranks = {r["k"]: r for r in core.nearest_ranks(v, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, cells=2).collect()}
    assert (ranks["k"]["lo"], ranks["k"]["mid"], ranks["k"]["hi"]) == (1, 2, 4) and ranks["one"]["mid"] == 7


def test_store(spark, tmp_path):
    path = str(tmp_path / "nodes")
    store.replace_patients(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "patient string, node string"), path)
    store.replace_patients(spark.createDataFrame([("a", "9")], "patient string, node string"), path)
    assert sorted((r["patient"], r["node"]) for r in spark.read.parquet(path).collect()) == [("a", "9"), ("b", "3")]
    assert [r["node"] for r in store.load_patient(spark, path, "b").collect()] == ["3"]
    edges = spark.createDataFrame([("a", "9", "x", "k")], "patient string, src string, dst string, kind string")
    assert store.dangling(edges, spark.read.parquet(path)).count() == 1


def test_reports(spark):
    body = "Referto di laboratorio\nData prelievo: 03/02/2025\nEsame  Risultato  Unità  Valori\nCreatinina  1,40  mg/dL  0,6 - 1,2\nEmoglobina  12,5  g/dL\nGlucosio  90  mg/dL\nFerritina: assente\n"
    df = spark.createDataFrame([("r", "p", body)], "report_id string, patient string, text string")
    got = {r["name"]: r for r in reports.interpreted(df).collect()}
    assert got["Creatinina"]["status"] == "ok" and got["Creatinina"]["day"] == date(2025, 2, 3) and float(got["Creatinina"]["reference_high"]) == 1.2
    assert got["Emoglobina"]["usable"] and got["Glucosio"]["status"] == "unmapped" and got["Ferritina"]["status"] == "non_numeric"
    moved = spark.createDataFrame([("Hb", "12", "g/dL", None, "12 then Hb then g/dL"), ("Hb", "13", "", None, "Hb 12"), ("Hb", "12", "g/dL", "", "Hb   12 g/dL")], "name string, value_text string, unit_text string, range_text string, text string")
    assert [r["x"] for r in moved.select(reports.grounding(moved).alias("x")).collect()] == ["misplaced", "ungrounded", None]
    tagged, left = reports.filed(df.select("report_id").withColumn("tag", reports.patient_tag(F.lit("p"))), spark.createDataFrame([("p",)], "patient string"))
    assert tagged.count() == 1 and left.count() == 0


def test_store_takes_no_rows(spark, tmp_path):
    path = str(tmp_path / "nodes")
    rows = spark.createDataFrame([("a", "1")], "patient string, node string")
    store.replace_patients(rows, path)
    store.replace_patients(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_a_failed_save_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "nodes")
    rows = spark.createDataFrame([("a", "1")], "patient string, node string")
    store.replace_patients(rows, path)
    with pytest.raises(Exception, match="broken"):
        store.replace_patients(rows.withColumn("node", F.when(F.col("node") == "1", F.raise_error(F.lit("broken"))).cast("string")), path)
    assert [r["node"] for r in spark.read.parquet(path).collect()] == ["1"]
    assert [p.name for p in tmp_path.iterdir()] == ["nodes"]


def test_tokens_read_compatible_forms(spark):
    """Ligatures, wide letters, raised digits and fractions are what they stand for, as in NFKC."""
    texts = ["ﬁve ＡＢＣ１２ 10³ ㎎ ½", "plain −1,5 ≥ 3.0", "Ångström état ŀ ǆ"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(text.tokens(F.col("t"))).collect()]
    assert got[0] == ["five", "abc12", "103", "mg", "1", "2"] and got[1] == ["plain", "-1,5", ">=", "3.0"] and got[2][0] == "ångström"
    for c, to in list(text._SEVERAL.items())[:50]:
        assert unicodedata.normalize("NFKC", c) == to
