"""Printed laboratory reports: rows transcribed by rules, checked against the text, read and converted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions import labs, times
from carepath.operators.graph import report_rows

# Words that tell a report's language.
WORDS = {"it": ("referto", "esame", "risultato", "valori", "prelievo", "unità", "paziente"), "en": ("report", "test", "result", "reference", "collected", "units", "patient")}
#: Characters between a name and its value, and between a value, its unit and its range, at most.
NAME_TO_VALUE, NEXT_FIELD = 100, 60
_DATE = r"(?i)^\s*(?:data(?: del)? prelievo|collect(?:ed|ion)(?: date)?|sample date|data)\s*:?\s*(.+?)\s*$"
_VALUE = r"(?:[<>]=?|≤|≥)?\s*\d[\d.,]*"


def texts(spark: SparkSession, root: str) -> DataFrame:
    """path, text and text_sha256 of every report below a folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("text_sha256"))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def language(text: Column) -> Column:
    """it or en by how often its words occur; null on a tie."""
    t = F.lower(text)
    times_ = {k: reduce(lambda a, b: a + b, [(F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / len(w) for w in ws]) for k, ws in WORDS.items()}
    return F.when(times_["it"] > times_["en"], "it").when(times_["en"] > times_["it"], "en")


def conventions(reports: DataFrame) -> DataFrame:
    """Adds language, decimal and date order: by evidence in the text, else by language (English proves no order)."""
    marks, orders = labs.separator_evidence(F.col("text")), times.order_evidence(F.col("text"))
    out = reports.withColumn("language", language(F.col("text")))
    one = lambda xs, default: F.when(F.size(xs) == 1, F.get(xs, 0)).when(F.size(xs) == 0, default)  # noqa: E731  contradictions tell nothing
    it = F.col("language") == "it"
    return out.withColumn("decimal", one(marks, F.when(it, ",").when(F.col("language") == "en", "."))).withColumn("date_order", one(orders, F.when(it, "dmy")))


def transcribed(reports: DataFrame, *, id_col: str = "report_id") -> DataFrame:
    """(id, index, name, value_text, unit_text, range_text) of the lines that are rows: columns set apart by two blanks, a colon or leaders."""
    lines = reports.select("*", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    cells = F.filter(F.split(F.regexp_replace(F.regexp_replace("line", r"\.{3,}", "  "), r":\s+", "  "), r"\s{2,}|\t|\s*\|\s*"), lambda c: F.trim(c) != "")
    rows = lines.withColumn("cells", cells).where((F.size("cells") >= 2) & ~F.col("line").rlike(_DATE))
    value = F.trim(F.get("cells", 1))
    inside = rf"^({_VALUE})\s+(\S.*)$"  # the unit may stand in the value's column
    rows = rows.withColumn("value_text", F.when(value.rlike(inside), F.trim(F.regexp_extract(value, inside, 1))).otherwise(value))
    rows = rows.withColumn("unit_text", F.when(value.rlike(inside), F.regexp_extract(value, inside, 2)).otherwise(F.trim(F.get("cells", 2))))
    rest = F.when(value.rlike(inside), F.get("cells", 2)).otherwise(F.get("cells", 3))
    known = rows.where(F.col("value_text").rlike(rf"^\s*{_VALUE}\s*$") | labs.analyte_of_name(F.get("cells", 0)).isNotNull())
    return known.select(id_col, F.col("line_no").alias("index"), F.trim(F.get("cells", 0)).alias("name"), "value_text", "unit_text", F.trim(rest).alias("range_text"))


def collection_day(text: Column, order: Column) -> Column:
    """The day that the report's date line gives."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(_DATE))
    return times.report_date(F.regexp_extract(F.get(lines, 0), _DATE, 1), order)


def grounding(row: DataFrame, text: str = "text") -> Column:
    """ungrounded when a field is not in the report or name or value is empty; misplaced when fields are too far apart or out of order; else null."""
    hay = squash(F.col(text))
    field = {c: squash(F.coalesce(c, F.lit(""))) for c in ("name", "value_text", "unit_text", "range_text")}
    absent = reduce(lambda a, b: a | b, [(f != "") & ~F.contains(hay, f) for f in field.values()])
    empty = (field["name"] == "") | (field["value_text"] == "")
    gap = lambda s, f: F.when(f == "", 0).otherwise(F.instr(s, f) - 1)
    rest = lambda s, f: F.when(f == "", s).otherwise(F.substring(s, F.instr(s, f) + F.length(f), F.length(s)))
    one = rest(hay, field["name"])
    two = rest(one, field["value_text"])
    three = rest(two, field["unit_text"])
    far = (gap(one, field["value_text"]) > NAME_TO_VALUE) | (gap(two, field["unit_text"]) > NEXT_FIELD) | (gap(three, field["range_text"]) > NEXT_FIELD)
    out_of_order = (~F.contains(one, field["value_text"])) | (~F.contains(two, field["unit_text"])) | (~F.contains(three, field["range_text"]))
    return F.when(empty | absent, "ungrounded").when(out_of_order | far, "misplaced")


def interpreted(reports: DataFrame, *, id_col: str = "report_id") -> DataFrame:
    """Rows of reports (id, patient, text) with their status, first that holds: ungrounded, misplaced, unmapped, non_numeric, unparseable_value, then those of a conversion."""
    known = conventions(reports).withColumn("day", collection_day(F.col("text"), F.col("date_order")))
    rows = transcribed(known.select(id_col, "text"), id_col=id_col).join(known, id_col)
    problem = grounding(rows)
    read = report_rows(rows.withColumn("problem", problem))
    bounds = labs.reference_range(F.col("range_text"), F.col("decimal"))
    out = read.withColumn("status", F.coalesce("problem", "status")).withColumn("usable", F.col("usable") & F.col("problem").isNull())
    return out.withColumn("reference_low", bounds["low"]).withColumn("reference_high", bounds["high"]).drop("problem", "text")


def patient_tag(patient: Column) -> Column:
    """The tag that is printed in place of a patient's id."""
    return F.substring(F.sha2(patient, 256), 1, 8)


def filed(reports: DataFrame, patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports (with tag) joined to patients by their tag, and those that fit none."""
    tagged = patients.select("patient", patient_tag(F.col("patient")).alias("tag"))
    return reports.join(tagged, "tag"), reports.join(tagged, "tag", "left_anti")
