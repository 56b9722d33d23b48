"""Bundles that arrive later replace their patient's graph."""

import json

from carepath.streaming.ingest import keep_graphs


def bundle(patient, *labs):
    rows = [{"resource": {"resourceType": "Patient", "id": patient, "gender": "male", "birthDate": "1980-01-01"}}]
    for k, (day, value) in enumerate(labs):
        rows.append({"resource": {"resourceType": "Observation", "id": f"o{k}", "status": "final", "effectiveDateTime": day, "code": {"coding": [{"system": "http://loinc.org", "code": "2160-0", "display": "Creatinine"}]}, "valueQuantity": {"value": value, "unit": "mg/dL"}}})
    return json.dumps({"resourceType": "Bundle", "entry": rows})


def test_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    paths = [str(tmp_path / x) for x in ("nodes", "edges", "state")]
    (root / "a.json").write_text(bundle("a", ("2025-01-01", 1.1), ("2025-02-01", 1.2)))
    keep_graphs(spark, str(root), *paths).awaitTermination()
    (root / "b.json").write_text(bundle("b", ("2025-01-01", 0.9)))
    keep_graphs(spark, str(root), *paths).awaitTermination()
    nodes, edges = spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
    assert nodes.where("kind = 'lab_result'").count() == 3
    assert edges.where("kind = 'precedes'").count() == 1
