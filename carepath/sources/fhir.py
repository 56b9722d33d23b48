"""FHIR R4 bundles, one patient each, as typed DataFrames.

A file is parsed once, in its task, into one row for each entry; all typing after that is column
expressions. Data problems are rows of `issues`, never errors, but for a bundle that does not
hold exactly one Patient.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions.labs import NUMBER
from carepath.functions.times import timepoint
from carepath.sources.schemas import ENTRY, RESOURCES


class BundleError(ValueError):
    """A bundle that is not of exactly one patient."""


def files(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """Files below a folder, without hidden ones and those in hidden folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.where(~F.col("path").rlike(r"/\.[^/]"))


def entries(found: DataFrame) -> DataFrame:
    """The entries of bundles, in order; source is the SHA-256 of the file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                source = "sha256:" + hashlib.sha256(content).hexdigest()
                bundle = json.loads(content, parse_float=str, parse_int=str)
                for seq, entry in enumerate(bundle.get("entry") or []):
                    r = entry.get("resource") or {}
                    rows.append((source, seq, entry.get("fullUrl"), r.get("resourceType"), r.get("id"), json.dumps(r, ensure_ascii=False)))
            yield pd.DataFrame(rows, columns=["source", "seq", "full_url", "resource_type", "id", "body"])

    return found.select("content").mapInPandas(run, ENTRY)


@dataclass(frozen=True)
class Records:
    """The typed tables of a set of bundles; every row has source (its bundle)."""

    patient: DataFrame
    encounter: DataFrame
    condition: DataFrame
    medication_request: DataFrame
    observation: DataFrame
    procedure: DataFrame
    diagnostic_report: DataFrame
    note: DataFrame
    issue: DataFrame
    skipped: DataFrame


def label(c: Column) -> Column:
    """The text of a concept, else the first display, else the first code."""
    shown = F.filter(c["coding"], lambda x: x["display"].isNotNull())
    return F.coalesce(c["text"], F.get(shown, 0)["display"], F.get(c["coding"], 0)["code"])


def code(c: Column, system: str | None = None) -> Column:
    """`system|code` of the first coding with a code (of a system)."""
    held = F.filter(c["coding"], lambda x: x["code"].isNotNull() & (F.lit(True) if system is None else x["system"] == system))
    return F.concat_ws("|", F.get(held, 0)["system"], F.get(held, 0)["code"])


def categories(c: Column) -> Column:
    return F.filter(F.flatten(F.transform(c, lambda x: F.transform(x["coding"], lambda y: y["code"]))), lambda x: x.isNotNull())


def quantity(q: Column) -> Column:
    """struct(value, text, unit, code, comparator); the code counts only if it is UCUM's. Null without a number."""
    ucum = F.when(q["system"] == "http://unitsofmeasure.org", q["code"])
    value = q["value"].try_cast(NUMBER)
    return F.when(value.isNotNull(), F.named_struct(F.lit("value"), value, F.lit("text"), q["value"], F.lit("unit"), q["unit"], F.lit("code"), ucum, F.lit("comparator"), q["comparator"]))


def _typed(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("resource_type") == kind).select("source", "seq", "id", F.from_json("body", RESOURCES[kind]).alias("r"))


def _index(rows: DataFrame) -> DataFrame:
    """(source, key) of every entry under its fullUrl and its Type/id; a later entry takes a key over."""
    keys = F.array_compact(F.array("full_url", F.when(F.col("id").isNotNull(), F.concat_ws("/", "resource_type", "id"))))
    keyed = rows.select("source", F.explode(keys).alias("key"), F.struct("seq", "resource_type", "id").alias("e"))
    return keyed.groupBy("source", "key").agg(F.max("e").alias("e")).select("source", "key", F.col("e.resource_type").alias("to_type"), F.col("e.id").alias("to_id"))


def resolved(rows: DataFrame, index: DataFrame, reference: Column, kinds: tuple[str, ...], into: str) -> DataFrame:
    """Adds the id that a reference leads to, and the code of its problem if it has one.

    Not a reference or a conditional one: null and no problem; nothing there: unresolved_reference;
    another type: unexpected_reference_type.
    """
    key = F.when(~reference.contains("?"), reference)
    i = index.select(F.col("source").alias("__s"), F.col("key").alias("__k"), "to_type", "to_id")
    out = rows.withColumn("__key", key).join(i, (F.col("source") == F.col("__s")) & (F.col("__key") == F.col("__k")), "left")
    problem = F.when(F.col("__key").isNull(), None).when(F.col("to_type").isNull(), "unresolved_reference").when(~F.col("to_type").isin(*kinds), "unexpected_reference_type")
    fine = F.col("to_type").isin(*kinds)
    return out.withColumn(into, F.when(fine, F.col("to_id"))).withColumn(f"{into}_problem", problem).drop("__key", "__s", "__k", "to_type", "to_id")


def _many(rows: DataFrame, index: DataFrame, references: str, kind: str, into: str) -> DataFrame:
    """Adds the distinct ids of a list of references that lead to `kind`, in order."""
    each = rows.select("source", "seq", F.posexplode(F.transform(references, lambda x: x["reference"])).alias("pos", "ref"))
    each = resolved(each, index, F.col("ref"), (kind,), "to").where("to is not null")
    ids = each.groupBy("source", "seq").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "to"))), lambda x: x["to"])).alias(into))
    return rows.join(ids, ["source", "seq"], "left").withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def _time(*candidates: str) -> Column:
    return timepoint(F.coalesce(*[F.col(c) for c in candidates]))


def records(rows: DataFrame, *, check: bool = True) -> Records:
    """Typed tables of the entries of bundles. With `check`, a bundle without exactly one Patient raises BundleError."""
    if check:
        wrong = rows.groupBy("source").agg(F.count_if(F.col("resource_type") == "Patient").alias("n")).where("n <> 1").limit(5).collect()
        if wrong:
            raise BundleError(", ".join(f"{r['source']}: {r['n']} patients" for r in wrong))
    index = _index(rows)
    problems: list[DataFrame] = []

    def issues(df: DataFrame, code_: Column, severity: str, message: Column) -> None:
        problems.append(df.select("source", code_.alias("code"), F.lit(severity).alias("severity"), message.alias("message"), F.col("id").alias("resource_id")).where("code is not null"))

    def times(df: DataFrame, *columns: str) -> None:
        for c in columns:
            issues(df, F.when(F.col(c).isNotNull() & timepoint(F.col(c)).isNull(), "invalid_time"), "warning", F.concat_ws(": ", F.lit(c.split(".")[-1]), F.col(c)))

    def with_code(kind: str, concept: str) -> DataFrame:
        df = _typed(rows, kind)
        missing = F.col("id").isNull() | F.col(f"r.{concept}").isNull() | (label(F.col(f"r.{concept}")).isNull())
        issues(df.where(missing), F.lit("invalid_resource"), "error", F.lit(f"{kind}: missing {concept}"))
        return df.where(~missing)

    def in_encounter(df: DataFrame) -> DataFrame:
        df = resolved(df, index, F.col("r.encounter.reference"), ("Encounter",), "encounter_id")
        issues(df, F.col("encounter_id_problem"), "warning", F.col("r.encounter.reference"))
        return df

    p = _typed(rows, "Patient")
    known = F.col("r.gender").isin("male", "female", "other", "unknown")
    issues(p, F.when(F.col("r.gender").isNotNull() & ~known, "unsupported_value"), "warning", F.col("r.gender"))
    issues(p, F.when(F.col("r.deceasedBoolean"), "unsupported_value"), "info", F.lit("deceased without a date"))
    times(p, "r.birthDate", "r.deceasedDateTime")
    patient = p.select("source", "id", F.when(known, F.col("r.gender")).otherwise("unknown").alias("gender"), _time("r.birthDate").alias("birth"), _time("r.deceasedDateTime").alias("deceased"))

    e = _typed(rows, "Encounter")
    times(e, "r.period.start", "r.period.end")
    encounter = e.select("source", "seq", "id", "r.status", F.col("r.class.code").alias("class_code"), label(F.get("r.type", 0)).alias("label"), code(F.get("r.type", 0)).alias("code"), _time("r.period.start").alias("start"), _time("r.period.end").alias("end"))
    late = encounter.join(patient.select("source", F.col("deceased.date").alias("died")), "source").where(F.col("start.date") > F.col("died"))
    issues(late, F.lit("event_after_death"), "warning", F.col("id"))

    c = in_encounter(with_code("Condition", "code"))
    times(c, "r.onsetDateTime", "r.abatementDateTime", "r.recordedDate")
    condition = c.select("source", "seq", "id", label(F.col("r.code")).alias("label"), code(F.col("r.code")).alias("code"), code(F.col("r.clinicalStatus")).alias("clinical_status"), categories(F.col("r.category")).alias("categories"), _time("r.onsetDateTime", "r.onsetPeriod.start").alias("onset"), _time("r.abatementDateTime", "r.abatementPeriod.start").alias("abatement"), _time("r.recordedDate").alias("recorded"), "encounter_id")

    m = in_encounter(_typed(rows, "MedicationRequest"))
    m = resolved(m, index, F.col("r.medicationReference.reference"), ("Medication",), "medication_id")
    drug = _typed(rows, "Medication").select(F.col("source").alias("__ms"), F.col("id").alias("__mid"), F.col("r.code").alias("by_reference"))
    m = m.join(drug, (F.col("source") == F.col("__ms")) & (F.col("medication_id") == F.col("__mid")), "left")
    m = m.withColumn("concept", F.coalesce("r.medicationCodeableConcept", "by_reference"))
    issues(m, F.col("medication_id_problem"), "warning", F.col("r.medicationReference.reference"))
    issues(m, F.when(F.col("concept").isNull(), "invalid_resource"), "error", F.lit("MedicationRequest: missing medication"))
    times(m, "r.authoredOn")
    m = _many(m.where("concept is not null"), index, "r.reasonReference", "Condition", "reason_ids")
    medication = m.select("source", "seq", "id", label(F.col("concept")).alias("label"), code(F.col("concept")).alias("code"), "r.status", "r.intent", _time("r.authoredOn").alias("authored"), F.get("r.dosageInstruction", 0)["text"].alias("dosage"), "encounter_id", "reason_ids")

    o = in_encounter(with_code("Observation", "code"))
    times(o, "r.effectiveDateTime", "r.issued")
    other = F.coalesce(*[F.col(f"r.value{x}").cast("string") for x in ("DateTime", "Range", "Ratio", "Period", "SampledData", "Time")])
    issues(o, F.when(other.isNotNull(), "unsupported_value"), "info", F.lit("value of a kind that is not read"))
    none = F.lit(None).cast("string")
    whole = F.named_struct(F.lit("value"), F.col("r.valueInteger"), F.lit("unit"), none, F.lit("system"), none, F.lit("code"), none, F.lit("comparator"), none)
    parts = F.array_join(F.array_compact(F.transform("r.component", lambda x: F.concat_ws(" ", F.concat(label(x["code"]), F.lit(":")), F.coalesce(x["valueQuantity"]["value"], label(x["valueCodeableConcept"]), x["valueString"]), x["valueQuantity"]["unit"]))), "; ")
    text = F.coalesce(label(F.col("r.valueCodeableConcept")), F.col("r.valueString"), F.col("r.valueBoolean").cast("string"), F.nullif(parts, F.lit("")))
    loinc = F.get(F.filter("r.code.coding", lambda x: x["system"] == "http://loinc.org"), 0)["code"]
    observation = o.select("source", "seq", "id", label(F.col("r.code")).alias("label"), code(F.col("r.code")).alias("code"), loinc.alias("loinc"), "r.status", categories(F.col("r.category")).alias("categories"), _time("r.effectiveDateTime", "r.effectivePeriod.start").alias("effective"), F.coalesce(quantity(F.col("r.valueQuantity")), quantity(F.when(F.col("r.valueInteger").isNotNull(), whole))).alias("quantity"), text.alias("text"), F.get("r.referenceRange", 0).alias("reference"), "encounter_id")

    q = in_encounter(with_code("Procedure", "code"))
    times(q, "r.performedDateTime")
    procedure = q.select("source", "seq", "id", label(F.col("r.code")).alias("label"), code(F.col("r.code")).alias("code"), "r.status", _time("r.performedDateTime", "r.performedPeriod.start").alias("start"), _time("r.performedDateTime", "r.performedPeriod.end").alias("end"), "encounter_id")

    d = in_encounter(_typed(rows, "DiagnosticReport"))
    report = _many(d, index, "r.result", "Observation", "result_ids").select("source", "seq", "id", label(F.col("r.code")).alias("label"), code(F.col("r.code")).alias("code"), "r.status", _time("r.effectiveDateTime", "r.effectivePeriod.start").alias("effective"), "result_ids", "encounter_id")

    # notes: inline plain text of reports and documents; the same text in one encounter is one note with all its carriers
    f = resolved(_typed(rows, "DocumentReference"), index, F.get("r.context.encounter", 0)["reference"], ("Encounter",), "encounter_id")
    attached = lambda df, forms, kind, when: df.select("source", "seq", "id", "encounter_id", kind.alias("kind"), when.alias("date"), F.explode(forms).alias("a"))
    carried = attached(d, F.col("r.presentedForm"), label(F.col("r.code")), _time("r.effectiveDateTime", "r.effectivePeriod.start")).unionByName(attached(f, F.transform("r.content", lambda x: x["attachment"]), label(F.col("r.type")), _time("r.date")))
    carried = carried.where(F.col("a.contentType").startswith("text/plain") & F.col("a.data").isNotNull()).withColumn("text", F.try_validate_utf8(F.try_to_binary("a.data", F.lit("base64")).cast("string")))
    issues(carried, F.when(F.col("text").isNull(), "invalid_attachment"), "warning", F.lit("text that cannot be decoded"))
    first = F.min(F.struct("seq", "id", "kind", "date")).alias("f")
    note = carried.where("text is not null").groupBy("source", "encounter_id", "text").agg(first, F.sort_array(F.collect_set("id")).alias("sources")).select("source", F.col("f.seq").alias("seq"), F.col("f.id").alias("id"), F.col("f.kind").alias("kind"), F.col("f.date").alias("date"), "encounter_id", "text", "sources")

    issue = problems[0]
    for x in problems[1:]:
        issue = issue.unionByName(x)
    skipped = rows.where(~F.col("resource_type").isin(*RESOURCES)).groupBy("source", "resource_type").agg(F.count(F.lit(1)).alias("n"))
    return Records(patient, encounter, condition, medication, observation, procedure, report, note, issue, skipped)
