"""Passages with ids, running lines, reference pages and the census of statements."""

import random
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carepath.functions.text import BATCH_CHARS, BATCH_ROWS, packed, paragraphs, passage_batches, passages
from carepath.operators import census, chunks

PAGE = "source string, version string, title string, number int, label string, text string"


def pages(spark, *rows):
    return spark.createDataFrame(rows, PAGE)


def test_paragraphs_open_at_fixed_words_and_after_short_last_lines():
    lines = ["Long lines of a paragraph that go on to the", "next, and end here.", "Table talk is no table, but it follows a short line", "Table 3 is one", "2.1.4: A section", "3. no section number, so it goes on"]
    assert paragraphs(lines) == ["Long lines of a paragraph that go on to the next, and end here.", "Table talk is no table, but it follows a short line", "Table 3 is one", "2.1.4: A section 3. no section number, so it goes on"]
    assert paragraphs(["", "  "]) == []


def test_packing_cuts_long_paragraphs_at_sentences_then_words():
    assert packed(["one two", "three four", "five six seven eight nine ten. Eleven twelve."], 5) == ["one two three four", "five six seven eight nine", "ten. Eleven twelve."]
    assert all(len(p.split()) <= 5 for p in packed(["a " * 23, "1.5 ml. of it, i.e. three"], 5))
    assert packed(["v. small. but no Sentence end. Here one"], 3) == ["v. small. but", "no Sentence end.", "Here one"]


def test_document_chunks_by_page_without_running_lines(spark):
    df = pages(spark, ("doc", "abc", "A guideline", 1, "S148", "Header line\nFirst page text.\nS148 Footer"), ("doc", "abc", "A guideline", 2, "S149", " Second page text.\r\nS149 Footer\n\n"), ("doc", "abc", "A guideline", 3, None, "a\nb\nS1 Footer\nc\nd"), ("doc", "abc", "A guideline", 4, None, None))
    patterns = spark.createDataFrame([("doc", ["S\\d+$", "no"], ["Footer$"])], "source string, starts array<string>, anywhere array<string>")
    got = chunks.document_chunks(df, patterns=patterns).orderBy("id").collect()
    want = [("doc@abc/1.1", "p. S148", "Header line First page text."), ("doc@abc/2.1", "p. S149", "Second page text."), ("doc@abc/3.1", "page 3 of the file", "a b S1 Footer c d")]
    assert [(r["id"], r["where"], r["text"]) for r in got] == want
    assert got[0]["code"] is None


def test_label_chunks_carry_section_and_code(spark):
    df = spark.createDataFrame([("set-1", 7, "Examplix", 2, "42229-5", ["2 DOSAGE", "2.2 Renal"], "• eGFR below 30: do not use.\nA row | of a table"), ("set-1", 7, "Examplix", 3, None, ["3 FORMS"], "")], "set_id string, version int, title string, n int, code string, path array<string>, text string")
    assert [tuple(r) for r in chunks.label_chunks(df).collect()] == [("label:set-1@v7/2.1", "label:set-1", "v7", "Examplix", "section 2 DOSAGE > 2.2 Renal", "42229-5", "• eGFR below 30: do not use. A row | of a table")]
    assert [r["id"] for r in chunks.label_chunks(df, most=7).collect()] == ["label:set-1@v7/2.1", "label:set-1@v7/2.2"]


def test_running_lines_are_found_on_either_side_and_dropped_at_the_edges_only(spark):
    rows = []
    for k in range(20):
        head = [f"Guideline 2024, page {k}", "www.site.example"]
        body = [f"text {k} {x}" for x in "abcdef"] + (["Guideline 2024, page 1"] if k == 4 else []) + [f"end {w} {k}" for w in ("of", "it", "all")]
        rows.append(("g", "1", "t", k, None, "\n".join((head if k % 2 else head[::-1][:1]) + body + ([] if k % 2 else head[:1]))))
    rows += [("other", "1", "t", k, None, "www.site.example\nown") for k in range(2)] + [(None, "1", "t", k, None, f"same\n{k} x\n{'ab'[k % 2]}") for k in range(4)]
    df = pages(spark, *rows)
    found = chunks.running_lines(df)
    assert {(r["source"], r["form"], r["n"], r["pages"]) for r in found.collect()} == {("g", "Guideline #, page #", 20, 20), ("g", "www.site.example", 20, 20), (None, "same", 4, 4), (None, "# x", 4, 4)} | {("g", "end all #", 20, 20), ("g", "end it #", 10, 20), ("g", "text # a", 10, 20)}
    kept = {(r["source"], r["number"]): r["lines"] for r in chunks.without_running(df, found=found.where("form not like 'end%' and form not like 'text%'")).collect()}
    assert kept["g", 4] == [f"text 4 {x}" for x in "abcdef"] + ["Guideline 2024, page 1", "end of 4", "end it 4", "end all 4"]
    assert kept["other", 0] == ["www.site.example", "own"] and kept[None, 1] == ["b"]
    assert chunks.running_lines(df.limit(0)).count() == 0


def test_reference_pages_by_printed_label(spark):
    df = pages(spark, *[("d", "1", "t", n, f"S{10 + n}", "") for n in range(1, 5)], ("d", "1", "t", 9, "", ""), ("e", "1", "t", 1, "S12", ""))
    spec = spark.createDataFrame([("d", "S12", "S13"), ("e", "S12", "S13"), ("f", None, None)], "source string, first string, last string")
    marked, missing = chunks.reference_pages(df, spec)
    assert {(r["source"], r["number"]) for r in marked.where("in_references").collect()} == {("d", 2), ("d", 3)}
    assert marked.count() == 6 and [r["source"] for r in missing.collect()] == ["e"]


def test_an_edit_changes_only_the_passages_it_touches(spark):
    r = random.Random(3)
    lines = [" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(r.randint(3, 40))) for _ in range(300)]
    lines[50] = "word " * 950
    edited = [*lines[:120], "an inserted line", *lines[120:]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(edited)), (3, None), (4, " \n"), (5, "same\n" * 3)], "id int, text string")
    got = chunks.lasting_chunks(df, "id", "text").orderBy("id", "n").collect()
    of = lambda i: [x for x in got if x["id"] == i]
    assert " ".join(x["text"] for x in of(2)) == " ".join(" ".join(edited).split())
    assert not of(3) and not of(4)
    assert len(of(1)) > 30 and max(len(x["text"].split()) for x in of(1)) < 400
    before, after = {x["key"] for x in of(1)}, {x["key"] for x in of(2)}
    assert 1 <= len(before - after) <= 3 and 1 <= len(after - before) <= 3
    every = chunks.lasting_chunks(df, "id", "text", spread=1).where("id = 5").collect()
    assert [x["key"][-2:] for x in every] == [".1", ".2", ".3"] and len({x["key"][:16] for x in every}) == 1


@pytest.mark.parametrize(
    ("sentence", "kind"),
    [
        ("Not recommended with an eGFR below 30.", "eGFR threshold"),
        ("Contraindicated when eGFR is <30 mL/min.", "eGFR threshold"),
        ("An egfr below 30 is low.", None),
        ("Patients with CREATININE CLEARANCE between 30 and 60.", "creatinine-clearance threshold"),
        ("Creatinine clearance falls.", None),
        ("Monitoring of renal function is needed at least yearly.", "lab monitoring with a time word"),
        ("Evaluate kidney function prior to initiation.", None),
        ("Measure hemoglobin every week.", "lab monitoring with a time word"),
        ("Measure hemoglobin.", None),
    ],
)
def test_kinds_of_statements(spark, sentence, kind):
    got = census.statements(spark.createDataFrame([("a", None, sentence)], "label string, code string, text string")).collect()
    assert [r["kind"] for r in got] == ([kind] if kind else [])


def test_census_counts_sentences_and_labels_and_skips_sections(spark):
    text = "Use if eGFR ≥ 45. Stop if eGFR < 30; (CrCl < 20 as well)\nCheck eGFR monthly."
    df = spark.createDataFrame([("a", "1", text), ("b", None, text), ("b", census.SKIPPED[0], text), (None, "1", text), ("c", "1", None)], "label string, code string, text string")
    assert {tuple(r) for r in census.census(df).collect()} == {("eGFR threshold", 6, 2), ("creatinine-clearance threshold", 3, 2), ("lab monitoring with a time word", 3, 2)}
    assert {tuple(r)[1:] for r in census.census(df.limit(0)).collect()} == {(0, 0)}


def test_a_limit_on_the_words_between(spark):
    near = census.Kind("near", (census.Phrases((r"\bmonitor",)), census.Phrases(("renal function",))), within=2)
    said = ["Monitoring of the renal function", "renal function, which you monitor", "Monitor all of the many renal function tests", "monitor renal function"]
    df = spark.createDataFrame([(x,) for x in said], "x string").withColumn("hit", census.holds(F.col("x"), near))
    assert [r["hit"] for r in df.collect()] == [True, True, False, True]


def test_census_looks_for_plain_words_before_patterns(spark):
    assert census._opening(r"\bchecks?") == "check" and census._opening("a|b") == "" and census._opening(r"[ab]c") == ""
    said = ["Measure hemoglobin weekly", "MEASURE HEMOGLOBIN WEEKLY", "mea\u017fure hemoglobin wee\u212aly", "measured hæmoglobin weekly", "unmeasured hemoglobin weekly", "Measure hemoglobin biweekly", "eGFR <\u00a030", "eGFR below 30", "eGFR below x", "CRCL under 5"]
    df = spark.createDataFrame([(x,) for x in said], "x string")
    plain = lambda k: reduce(lambda a, b: a & b, [F.col("x").rlike(f"(?{'iu' if g.any_case else ''}U:{'|'.join(g.forms)})") for g in k.groups])
    rows = df.select("x", *[census.holds(F.col("x"), k).alias(f"a{n}") for n, k in enumerate(census.LABEL_KINDS)], *[plain(k).alias(f"b{n}") for n, k in enumerate(census.LABEL_KINDS)]).collect()
    assert [tuple(r)[1:4] for r in rows] == [tuple(r)[4:] for r in rows] and sum(sum(tuple(r)[1:4]) for r in rows) == 6
    sections = df.select(F.col("x").alias("label"), F.lit("1").alias("code"), F.col("x").alias("text"))
    plan = census.statements(sections)._jdf.queryExecution().optimizedPlan()
    assert not any("RLIKE" in line for line in plan.toString().split("\n") if line.lstrip("+-: ").startswith("Filter"))  # a kind is not told again
    assert census.statements(sections).count() == 6


def test_passages_are_handed_back_in_bounded_batches(spark):
    texts = [(k, None if k == 3 else "\n".join(f"Word {j} of text {k} is here." for j in range(4000))) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in texts]), pa.array([t for _, t in texts])], ["id", "text"])
    got = list(passage_batches(batch))
    assert len(got) > 3 and all(sum(map(len, b["passage"].to_pylist())) < BATCH_CHARS + 120_000 for b in got)
    rows = [r for b in got for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert rows == [(k, n, p) for k, t in texts for n, p in enumerate(packed(paragraphs((t or "").split("\n"))), 1)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = passages(spark.createDataFrame([*texts[:5], (None, "One. Two.")], "id long, text string"), "id", "text").collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS
    assert sorted(map(tuple, out), key=str) == sorted([r for r in rows if r[0] < 5] + [(None, 1, "One. Two.")], key=str)
