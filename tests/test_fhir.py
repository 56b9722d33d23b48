"""Small bundles of our own through ingest, graph and rules."""

import base64
import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from carepath.operators import evidence, graph, rules
from carepath.sources import fhir

LOINC, SNOMED, RX, UCUM = "http://loinc.org", "http://snomed.info/sct", "http://www.nlm.nih.gov/research/umls/rxnorm", "http://unitsofmeasure.org"


def concept(system, code, text):
    return {"coding": [{"system": system, "code": code, "display": text}], "text": text}


def entry(kind, i, **body):
    return {"fullUrl": f"urn:{i}", "resource": {"resourceType": kind, "id": i, **body}}


def lab(i, code, name, value, unit, day, **more):
    return entry("Observation", i, status="final", code=concept(LOINC, code, name), effectiveDateTime=day, valueQuantity={"value": value, "unit": unit, "system": UCUM, "code": unit}, encounter={"reference": "urn:e1"}, **more)


def written(entries):
    """JSON with numbers as given in strings like '1.50'."""
    text = json.dumps({"resourceType": "Bundle", "entry": entries})
    return text.replace('"@', "").replace('@"', "")


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("bundles")
    note = base64.b64encode("Seen in clinic.".encode()).decode()
    a = [
        entry("Patient", "a", gender="female", birthDate="1960-05-01"),
        entry("Encounter", "e1", status="finished", **{"class": {"code": "AMB"}}, period={"start": "2025-01-10T09:00:00+01:00", "end": "2025-01-10T10:00:00+01:00"}),
        lab("o1", "2160-0", "Creatinine", "@1.40@", "mg/dL", "2025-01-10"),
        lab("o2", "2160-0", "Creatinine", "@1.5@", "mg/dL", "2025-03-01"),
        lab("o3", "2160-0", "Creatinine", "@141.4@", "umol/L", "2025-04-25"),
        lab("o4", "718-7", "Hemoglobin", "@11.0@", "g/dL", "2025-04-25"),
        lab("o5", "2160-0", "Creatinine", "@1.5@", "cups", "2025-05-01"),
        entry("Observation", "o6", status="final", code=concept(LOINC, "2888-6", "Urine protein"), effectiveDateTime="2025-04-25", valueString="negative"),
        entry("Observation", "o7", status="final", effectiveDateTime="2025-04-25", valueString="no code"),
        entry("Condition", "c1", code=concept(SNOMED, "38341003", "Hypertension"), onsetDateTime="2010", encounter={"reference": "urn:nowhere"}),
        entry("MedicationRequest", "m1", status="active", intent="order", medicationCodeableConcept=concept(RX, "314076", "lisinopril 10 MG"), authoredOn="2025-02-01", reasonReference=[{"reference": "Condition/c1"}, {"reference": "Condition/c1"}], encounter={"reference": "urn:e1"}),
        entry("MedicationRequest", "m2", status="active", intent="order", medicationReference={"reference": "urn:med"}, authoredOn="2025-02-02"),
        entry("Medication", "med", code=concept(RX, "849574", "naproxen sodium 220 MG")),
        entry("DiagnosticReport", "d1", status="final", code=concept(LOINC, "34117-2", "History"), effectiveDateTime="2025-01-10", presentedForm=[{"contentType": "text/plain", "data": note}], encounter={"reference": "urn:e1"}),
        entry("DocumentReference", "d2", status="current", type=concept(LOINC, "34117-2", "History"), date="2025-01-10T09:30:00Z", content=[{"attachment": {"contentType": "text/plain", "data": note}}], context={"encounter": [{"reference": "urn:e1"}]}),
        entry("Claim", "x1"),
    ]
    b = [
        entry("Patient", "b", gender="male", birthDate="1950-02-01", deceasedDateTime="2025-06-01"),
        entry("Encounter", "e1", status="finished", **{"class": {"code": "IMP"}}, period={"start": "2025-06-02", "end": "2025-06-02"}),
        lab("o1", "718-7", "Hemoglobin", "@110@", "g/L", "2025-05-01"),
    ]
    (root / "a.json").write_text(written(a))
    (root / ".hidden.json").write_text("{}")
    (root / "deep").mkdir()
    (root / "deep" / "b.json").write_text(written(b))
    rows = fhir.entries(fhir.files(spark, str(root))).cache()
    return rows, fhir.records(rows)


def test_digits_and_times_stay_as_written(records):
    r = records[1]
    got = {x["id"]: x for x in r.observation.collect() if x["id"] in ("o1", "o3") and x["quantity"]["unit"] != "g/L"}
    assert got["o1"]["quantity"]["text"] == "1.40"
    e = r.encounter.where("class_code = 'AMB'").first()
    assert e["start"]["date"] == date(2025, 1, 10) and e["start"]["precision"] == "instant"
    assert r.condition.first()["onset"]["precision"] == "year"


def test_issues_and_skipped(records):
    r = records[1]
    issues = {(x["code"], x["resource_id"]) for x in r.issue.collect()}
    assert {("invalid_resource", "o7"), ("unresolved_reference", "c1"), ("event_after_death", "e1")} <= issues
    assert [(x["resource_type"], x["n"]) for x in r.skipped.collect()] == [("Claim", 1)]


def test_references_and_notes(records):
    r = records[1]
    meds = {x["id"]: x for x in r.medication_request.collect()}
    assert meds["m1"]["reason_ids"] == ["c1"] and meds["m2"]["code"] == f"{RX}|849574"
    note = r.note.collect()
    assert len(note) == 1 and note[0]["sources"] == ["d1", "d2"] and note[0]["id"] == "d1"


def test_a_bundle_without_a_patient_is_refused(spark, tmp_path):
    (tmp_path / "h.json").write_text(written([entry("Organization", "o")]))
    with pytest.raises(fhir.BundleError):
        fhir.records(fhir.entries(fhir.files(spark, str(tmp_path))))


@pytest.fixture(scope="module")
def built(spark, records, tmp_path_factory):
    rows, r = records
    a = r.patient.where("id = 'a'").first()["source"]
    printed = spark.createDataFrame([(a, "rep", 0, date(2025, 4, 25), "Creatinina", "1,6", "mg/dL", ","), (a, "rep", 1, date(2025, 4, 25), "Glucose", "90", "mg/dL", ","), (a, "rep", 2, date(2025, 4, 25), "Hb", "12,5", "g/dL", ",")], "patient string, report_id string, index int, day date, name string, value_text string, unit_text string, decimal string")
    root = tmp_path_factory.mktemp("graph")

    def saved(df, name):
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    n = saved(graph.nodes(r, graph.report_rows(printed)), "nodes")
    same = saved(graph.same_measurement(n), "same")
    return saved(r.patient, "patient"), n, saved(graph.edges(n), "edges"), same, saved(graph.series(n, same), "series")


def test_graph(built):
    patient, n, e, same, points = built
    a = patient.where("id = 'a'").first()["source"]
    status = {x["node"]: x["status"] for x in n.where("kind in ('lab_result', 'report_row')").collect() if x["patient"] == a}
    assert status["lab_result:o5"] == "unit_unknown" and status["lab_result:o6"] == "non_numeric" and status["report_row:rep:1"] == "unmapped"
    kinds = {(x["src"], x["dst"], x["kind"]) for x in e.collect()}
    assert ("report_row:rep:0", "lab_result:o3", "same_measurement") in kinds  # 141.4 umol/L is 1.5995 mg/dL
    assert ("condition:c1", "medication_request:m1", "treated_by") in kinds
    assert ("report_row:rep:0", "lab_report:rep", "part_of") in kinds
    assert not any(k == "same_measurement" and s.endswith(":2") for s, _, k in kinds)
    assert points.where("node = 'lab_result:o3'").first()["corroborated_by"] == ["report_row:rep:0"]
    every = e.unionByName(graph.precedes(points, n))
    assert graph.violations(n, every, points).count() == 0
    assert graph.violations(n, every.limit(1).withColumn("dst", F.lit("gone"))).count() == 1
    bad = n.withColumn("kind", F.when(F.col("node") == "condition:c1", "encounter").otherwise(F.col("kind"))).withColumn("usable", F.when(F.col("node") == "lab_result:o2", False).otherwise(F.col("usable")))
    whats = {x["what"] for x in graph.violations(bad, every.where("kind <> 'precedes'"), points).collect()}
    assert {"node named for another kind", "usable against its status or date", "not usable but in a series", "missing step between values"} <= whats
    assert graph.digest(n, every).count() == 2
    concepts, links = graph.concept_map(n, every)
    assert concepts.where("concept = 'analyte:hemoglobin'").first()["patients"] == 2
    assert links.where("kind = 'treated_by'").count() == 1


def test_rules(built):
    patient, n, e, same, points = built
    out = rules.evaluate(patient, n, points, "2026-01-01")
    a = patient.where("id = 'a'").first()["source"]
    status = {(x["patient"], x["rule"]): x["status"] for x in out["assessment"].collect()}
    assert status[a, "ckd_criteria"] == "met" and status[a, "anaemia_criteria"] == "not_met"  # the report's 12.5 is the later point of that day
    assert status[a, "gfr_due"] == "not_met" and status[a, "albuminuria_due"] == "met"
    assert all(p == a for p, _ in status)  # b died before the day
    flags = {x["rule"] for x in out["flag"].collect()}
    assert {"ckd_no_diagnosis", "albuminuria_due", "ras_nsaid"} <= flags
    egfr = out["computed_egfr"].where("node = 'lab_result:o2'").first()
    assert abs(egfr["egfr"] - 39.6) < 1.5 and egfr["whole"] == int(egfr["egfr"] + 0.5)
    held = {x["rule"]: x for x in out["flag"].collect()}
    run = held["ckd_no_diagnosis"]["evidence"]
    assert [(x["date"], x["node"]) for x in run] == [(date(2025, 1, 10), "lab_result:o1"), (date(2025, 4, 25), "lab_result:o3")] and run[0]["value"].endswith("mL/min/1.73 m2")
    assert {x["node"] for x in held["ras_nsaid"]["evidence"]} == {"medication_request:m1", "medication_request:m2"}
    assert held["albuminuria_due"]["evidence"] == [] and held["albuminuria_due"]["limitations"]
    packed = evidence.pack(out["flag"].withColumn("statements", F.array().cast("array<struct<id:string,citation:string,quote:string>>")).withColumn("passages", F.array().cast("array<struct<id:string,title:string,place:string,text:string>>")))
    assert packed.where("rule = 'ckd_no_diagnosis' and kind = 'evidence'").count() == 2
    said = {x["rule"]: x for x in out["assessment"].collect()}
    assert said["anaemia_criteria"]["reason"] is None and said["anaemia_criteria"]["evidence"][0]["note"] == "cutoff 120 g/L"
    nothing = rules.evaluate(patient, n, points.limit(0), "2026-01-01")["assessment"].where("rule = 'ckd_criteria'").first()
    assert nothing["status"] == "not_assessable" and nothing["reason"].startswith("no eGFR") and nothing["evidence"] == []
