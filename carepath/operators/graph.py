"""The patient graph as two tables, nodes and edges, for all patients at once.

Edges of every kind are equi-joins within a patient; a measurement repeated on a report is an
equi-join on analyte and day with a residual condition on the values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions import labs
from carepath.operators import core
from carepath.sources.fhir import Records

# Which kinds an edge may join, and the SNOMED conditions that are monitored with the analytes to look at.
ALLOWED = {
    "occurred_during": (("condition", "medication_request", "procedure", "observation", "lab_result", "note"), ("encounter",)),
    "treated_by": (("condition",), ("medication_request", "procedure")),
    "monitored_by": (("condition",), ("analyte",)),
    "measures": (("lab_result", "report_row"), ("analyte",)),
    "part_of": (("report_row",), ("lab_report",)),
    "same_measurement": (("report_row",), ("lab_result",)),
    "precedes": (("lab_result", "report_row", "encounter"), ("lab_result", "report_row", "encounter")),
}
_STAGES = ("431855005", "431856006", "433144002", "431857002")
MONITORED = {**{f"http://snomed.info/sct|{c}": ("egfr", "urine_acr", "creatinine") for c in _STAGES}, "http://snomed.info/sct|271737000": ("hemoglobin",)}

NODE = ("patient", "node", "seq", "kind", "label", "code", "start", "end", "status", "usable", "analyte", "value", "unit", "comparator", "method", "value_text", "detail", "encounter_id", "reason_ids")


def _node(df: DataFrame, kind: str, **columns: Column | str) -> DataFrame:
    """Rows of one kind in the shape of all nodes; what a kind has not is null."""
    types = {"seq": "int", "usable": "boolean", "start": "struct<date:date,precision:string,instant:timestamp>", "end": "struct<date:date,precision:string,instant:timestamp>", "value": "decimal(38,17)", "reason_ids": "array<string>"}
    have = {"patient": "source", "seq": "seq", "node": F.concat_ws(":", F.lit(kind), F.col("id")), "kind": F.lit(kind), **columns}
    out = [(F.col(c) if isinstance(c, str) else c).cast(types.get(k, "string")) if (c := have.get(k)) is not None else F.lit(None).cast(types.get(k, "string")) for k in NODE]
    return df.select(*[c.alias(k) for c, k in zip(out, NODE, strict=True)])


def lab_results(observation: DataFrame) -> DataFrame:
    """Observations whose LOINC code is of a known analyte, converted; usable with status ok and a date."""
    rows = observation.withColumn("analyte", labs.analyte_of_loinc(F.col("loinc"))).where("analyte is not null")
    rows = rows.select("*", F.col("quantity.value").alias("value"), F.col("quantity.unit").alias("unit"), F.col("quantity.code").alias("ucum_code")).withColumn("code_", F.col("code")).withColumn("code", F.col("ucum_code"))
    done = labs.converted(rows).withColumn("code", F.col("code_")).drop("code_", "ucum_code")
    status = F.when(F.col("quantity").isNull() & F.col("text").isNotNull(), "non_numeric").otherwise(F.col("status"))
    return done.withColumn("status", status).withColumn("usable", (status == "ok") & F.col("effective.date").isNotNull()).withColumn("method", F.when(F.col("analyte") == "egfr", labs.egfr_method(F.col("label"))))


def report_rows(rows: DataFrame) -> DataFrame:
    """Rows of transcribed reports (patient, report_id, index, day, name, value_text, unit_text, decimal), read and converted.

    Status, first that holds: unmapped (the name), non_numeric, unparseable_value, then those of a conversion.
    """
    out = rows.withColumn("analyte", labs.analyte_of_name(F.col("name"))).withColumn("value", labs.number(F.col("value_text"), F.col("decimal")))
    out = labs.converted(out.withColumn("unit", F.col("unit_text")).withColumn("code", F.lit(None).cast("string")))
    worded = ~F.col("value_text").rlike(r"\d")
    status = F.when(F.col("analyte").isNull(), "unmapped").when(worded, "non_numeric").when(F.col("value").isNull(), "unparseable_value").otherwise(F.col("status"))
    out = out.withColumn("status", status).withColumn("comparator", labs.comparator(F.col("value_text")))
    return out.withColumn("usable", (F.col("status") == "ok") & F.col("day").isNotNull()).withColumn("method", F.when(F.col("analyte") == "egfr", labs.egfr_method(F.col("name"))))


def nodes(r: Records, reports: DataFrame | None = None) -> DataFrame:
    """All nodes; `reports` are rows of report_rows()."""
    at = lambda day: F.when(day.isNotNull(), F.named_struct(F.lit("date"), day, F.lit("precision"), F.lit("day"), F.lit("instant"), F.lit(None).cast("timestamp")))
    results = lab_results(r.observation)
    other = r.observation.join(results.select("source", "seq"), ["source", "seq"], "left_anti")
    made = [
        _node(r.encounter, "encounter", label="label", code="code", start="start", end="end", status="status"),
        _node(r.condition, "condition", label="label", code="code", start=F.coalesce("onset", "recorded"), end="abatement", status="clinical_status", encounter_id="encounter_id"),
        _node(r.medication_request, "medication_request", label="label", code="code", start="authored", status="status", detail="dosage", encounter_id="encounter_id", reason_ids="reason_ids"),
        _node(r.procedure, "procedure", label="label", code="code", start="start", end="end", status="status", encounter_id="encounter_id"),
        _node(other, "observation", label="label", code="code", start="effective", status="status", detail="text", encounter_id="encounter_id"),
        _node(results, "lab_result", label="label", code="code", start="effective", status="status", usable="usable", analyte="analyte", value="canonical", unit="ucum", comparator="quantity.comparator", method="method", value_text="quantity.text", detail="text", encounter_id="encounter_id"),
        _node(r.note, "note", label="kind", start="date", detail="text", encounter_id="encounter_id"),
    ]
    if reports is not None:
        row = reports.withColumn("source", F.col("patient")).withColumn("seq", F.col("index")).withColumn("id", F.concat_ws(":", "report_id", "index"))
        made.append(_node(row, "report_row", label="name", start=at(F.col("day")), status="status", usable="usable", analyte="analyte", value="canonical", unit="ucum", comparator="comparator", method="method", value_text="value_text"))
        one = row.groupBy("source", "report_id").agg(F.min("day").alias("day")).withColumn("seq", F.lit(0)).withColumn("id", F.col("report_id"))
        made.append(_node(one, "lab_report", label=F.lit("laboratory report"), start=at(F.col("day"))))
    every = reduce(DataFrame.unionByName, made)
    watched = every.where("kind = 'condition'").select("patient", F.explode(F.try_element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in MONITORED.items() for x in p]), F.col("code"))).alias("analyte"))
    analytes = every.where("analyte is not null").select("patient", "analyte").unionByName(watched).distinct()
    return every.unionByName(_node(analytes.withColumn("source", F.col("patient")).withColumn("seq", F.lit(0)).withColumn("id", F.col("analyte")), "analyte", label="analyte", analyte="analyte"))


def edges(n: DataFrame) -> DataFrame:
    """(patient, src, dst, kind) of all edges but precedes, from the nodes."""
    edge = lambda df, src, dst, kind: df.select("patient", F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
    link = lambda df, to_kind, to: df.withColumn("to", to).where("to is not null").join(n.where(F.col("kind") == to_kind).select("patient", F.col("node").alias("to")), ["patient", "to"])
    during = edge(link(n.where(F.col("encounter_id").isNotNull()), "encounter", F.concat(F.lit("encounter:"), "encounter_id")), "node", "to", "occurred_during")
    reasons = n.where("kind = 'medication_request'").select("patient", "node", F.explode("reason_ids").alias("reason"))
    treated = edge(link(reasons, "condition", F.concat(F.lit("condition:"), "reason")), "to", "node", "treated_by")
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in MONITORED.items() for x in p])
    watched = n.where("kind = 'condition'").select("patient", "node", F.explode(F.try_element_at(table, F.col("code"))).alias("a"))
    monitored = edge(link(watched, "analyte", F.concat(F.lit("analyte:"), "a")), "node", "to", "monitored_by")
    measures = edge(n.where("kind in ('lab_result', 'report_row') and analyte is not null").withColumn("to", F.concat(F.lit("analyte:"), "analyte")), "node", "to", "measures")
    part = edge(n.where("kind = 'report_row'").withColumn("to", F.concat(F.lit("lab_report:"), F.regexp_extract("node", "^report_row:(.*):[^:]*$", 1))), "node", "to", "part_of")
    return reduce(DataFrame.unionByName, [during, treated, monitored, measures, part, edge(same_measurement(n), "row", "result", "same_measurement")]).distinct()


def method_fits(printed: Column, result: Column) -> Column:
    """Whether a result's equation can be the one that a printed row states."""
    p, r = F.coalesce(printed, F.lit("unspecified")), F.coalesce(result, F.lit("unspecified"))
    return F.when(p == "unspecified", True).when(p == "MDRD", r.contains("MDRD")).when(p == "CKD-EPI 2021", r.startswith("CKD-EPI 2021")).otherwise(r.contains("CKD-EPI"))


def same_measurement(n: DataFrame) -> DataFrame:
    """(patient, row, result): usable report rows that repeat a usable result of that day within half a printed unit."""
    row = n.where("kind = 'report_row' and usable").select("patient", "analyte", F.col("start.date").alias("day"), F.col("node").alias("row"), F.col("comparator").alias("c"), F.col("method").alias("m"), F.col("value").alias("printed"), F.col("value_text").alias("text"), F.col("unit").alias("u"))
    res = n.where("kind = 'lab_result' and usable").select("patient", "analyte", F.col("start.date").alias("day"), F.col("node").alias("result"), F.col("comparator").alias("rc"), F.col("method").alias("rm"), "value")
    # compared in the printed unit: the half unit of the last digit is scaled by the printed unit's factor
    factor = F.try_element_at(F.create_map(*[F.lit(x) for a in labs.ANALYTES for unit, num, den in a[3] for x in (f"{a[0]}|{unit}", num / den)]), F.concat_ws("|", "analyte", "u"))
    row = row.withColumn("width", labs.half_unit(F.col("text")) * factor * (1 + 1e-12))
    same = F.col("c").eqNullSafe(F.col("rc")) & ((F.col("analyte") != "egfr") | method_fits(F.col("m"), F.col("rm")))
    return core.band_pairs(row, res, ["patient", "analyte", "day"], "printed", "value", "width").where(same).select("patient", "row", "result")


def series(n: DataFrame, same: DataFrame) -> DataFrame:
    """The points of every series: usable measurements that don't repeat another, with what repeats them."""
    repeats = same.select("patient", F.col("row").alias("node"))
    by = same.groupBy("patient", F.col("result").alias("node")).agg(F.sort_array(F.collect_list("row")).alias("corroborated_by"))
    points = n.where("kind in ('lab_result', 'report_row') and usable").join(repeats, ["patient", "node"], "left_anti").join(by, ["patient", "node"], "left")
    return points.select("patient", "analyte", "node", F.col("start.date").alias("day"), F.coalesce(F.col("start.instant").cast("string"), F.lit("")).alias("instant"), F.col("value"), "comparator", "method", F.coalesce("corroborated_by", F.array().cast("array<string>")).alias("corroborated_by"))


def precedes(points: DataFrame, n: DataFrame) -> DataFrame:
    """Consecutive points of each series, and consecutive dated encounters."""
    steps = core.precedes(points, ["patient", "analyte"], ["day", "instant", "node"], "node")
    met = n.where("kind = 'encounter' and start is not null").select("patient", "node", F.col("start.date").alias("day"), F.coalesce(F.col("start.instant").cast("string"), F.lit("")).alias("instant"))
    return steps.select("patient", "src", "dst", F.lit("precedes").alias("kind")).unionByName(core.precedes(met, ["patient"], ["day", "instant", "node"], "node").withColumn("kind", F.lit("precedes")))


def violations(n: DataFrame, e: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """(patient, what, item) of everything that a graph must not have; empty for a sound graph.

    With the points of series(), and `e` holding the precedes edges, the series are checked as well.
    """
    kinds = n.select("patient", F.col("node"), "kind")
    ends = e.alias("e").join(kinds.select(F.col("patient").alias("sp"), F.col("node").alias("sn"), F.col("kind").alias("src_kind")), F.expr("e.patient = sp and src = sn"), "left")
    ends = ends.join(kinds.select(F.col("patient").alias("dp"), F.col("node").alias("dn"), F.col("kind").alias("dst_kind")), F.expr("e.patient = dp and dst = dn"), "left").select("e.*", "src_kind", "dst_kind")
    joined = ends.where("src_kind is not null and dst_kind is not null")
    allowed = F.lit(False)
    for kind, (src, dst) in ALLOWED.items():
        allowed |= (F.col("kind") == kind) & F.col("src_kind").isin(*src) & F.col("dst_kind").isin(*dst)
    found = lambda df, what, item: df.select("patient", F.lit(what).alias("what"), F.col(item).alias("item"))
    twice = n.groupBy("patient", "node").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    measured = F.col("kind").isin("lab_result", "report_row")
    sound = (F.coalesce("status", F.lit("")) == "ok") & F.col("start").isNotNull()
    repeats = same_measurement(n).select("patient", F.col("row").alias("src"), F.col("result").alias("dst"))
    out = [
        found(twice, "node twice", "node"),
        found(n.where(~F.col("node").startswith(F.concat("kind", F.lit(":")))), "node named for another kind", "node"),
        found(n.where(measured & (F.coalesce("usable", F.lit(False)) != sound)), "usable against its status or date", "node"),
        found(n.where("kind = 'report_row' and usable and analyte is null"), "usable row without an analyte", "node"),
        found(ends.where("src_kind is null or dst_kind is null"), "edge without an end", "src"),
        found(joined.where(~allowed), "edge between kinds that it may not join", "src"),
        found(e.where("src = dst"), "edge to itself", "src"),
        found(joined.where("kind = 'same_measurement'").join(repeats, ["patient", "src", "dst"], "left_anti"), "repeat whose values don't agree", "src"),
        found(n.where("usable and (value is null or start is null)"), "usable without value or date", "node"),
    ]
    return reduce(DataFrame.unionByName, out if points is None else [*out, *_series_violations(n, e, points, found)])


def _series_violations(n: DataFrame, e: DataFrame, points: DataFrame, found: Callable[[DataFrame, str, str], DataFrame]) -> list[DataFrame]:
    key = ["patient", "node"]
    usable = F.coalesce("usable", F.lit(False))
    values = n.where(F.col("kind").isin("lab_result", "report_row")).select(*key, "kind", usable.alias("usable"), F.col("analyte").alias("of"))
    at = points.select(*key, "analyte")
    placed = values.join(at, key)
    loose = values.where("usable").join(at, key, "left_anti")
    held = e.where("kind = 'same_measurement'").join(at.select("patient", F.col("node").alias("dst")), ["patient", "dst"], "left_semi").select("patient", F.col("src").alias("node"))
    step = ["patient", "src", "dst"]
    steps = e.where("kind = 'precedes'").join(values.select("patient", F.col("node").alias("src")), ["patient", "src"], "left_semi").select(*step)
    due = core.precedes(points, ["patient", "analyte"], ["day", "instant", "node"], "node").select(*step)
    return [
        found(at.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "in more than one series", "node"),
        found(placed.where("not usable"), "not usable but in a series", "node"),
        found(placed.where(~F.col("of").eqNullSafe(F.col("analyte"))), "in the series of another analyte", "node"),
        found(loose.where("kind = 'lab_result'"), "usable result missing from its series", "node"),
        found(loose.where("kind = 'report_row'").join(held, key, "left_anti"), "usable row neither in a series nor a repeat", "node"),
        found(steps.join(due, step, "left_anti"), "step between values that don't follow each other", "src"),
        found(due.join(steps, step, "left_anti"), "missing step between values", "src"),
    ]


def digest(n: DataFrame, e: DataFrame) -> DataFrame:
    """A SHA-256 over each patient's nodes and edges, in an order of their own; equal graphs have equal digests."""
    a = core.ordered_digest(n.withColumn("__j", F.to_json(F.struct(*[c for c in n.columns if c != "patient"]))), ["patient"], ["seq", "node"], F.col("__j")).withColumnRenamed("digest", "a")
    b = core.ordered_digest(e, ["patient"], ["src", "dst", "kind"], F.concat_ws("|", "src", "dst", "kind")).withColumnRenamed("digest", "b")
    return a.join(b, "patient", "left").select("patient", F.sha2(F.concat_ws("|", "a", F.coalesce("b", F.lit(""))), 256).alias("digest"))


def concept(kind: Column, node: Column, label: Column, code: Column, analyte: Column) -> Column:
    """The concept that a node is of, across patients."""
    return F.when(kind == "lab_result", F.concat(F.lit("analyte:"), analyte)).when(kind == "analyte", node).when(kind.isin("lab_report", "report_row"), "lab_report").otherwise(F.concat_ws("|", kind, F.coalesce(code, label)))


def concept_map(n: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Concepts (patients, records, label) and links between concepts (patients, edges) of a cohort."""
    named = n.withColumn("concept", concept(F.col("kind"), F.col("node"), F.col("label"), F.col("code"), F.col("analyte")))
    counted = F.count_if(~F.col("kind").isin("analyte", "lab_report"))
    of = named.groupBy("concept").agg(F.count_distinct("patient").alias("patients"), counted.alias("records"), F.min("code").alias("code"))
    of = of.join(core.most_frequent(named, ["concept"], "label").drop("n"), "concept", "left")
    ends = named.select("patient", "node", "concept")
    j = e.where(F.col("kind").isin("treated_by", "monitored_by", "measures", "occurred_during"))
    j = j.join(ends.select("patient", F.col("node").alias("src"), F.col("concept").alias("a")), ["patient", "src"]).join(ends.select("patient", F.col("node").alias("dst"), F.col("concept").alias("b")), ["patient", "dst"])
    links = j.where("a <> b").groupBy("a", "b", "kind").agg(F.count_distinct("patient").alias("patients"), F.count(F.lit(1)).alias("edges"))
    return of, links


def data_notes(n: DataFrame, points: DataFrame, same: DataFrame) -> DataFrame:
    """(patient, topic, analyte, n): what a reader should know of a patient's data."""
    note = lambda df, topic, *by: df.groupBy("patient", *(by or ("analyte",))).agg(F.count(F.lit(1)).alias("n")).select("patient", F.lit(topic).alias("topic"), *(["analyte"] if not by else [F.col(by[0]).alias("analyte")]), "n")
    measured = n.where("kind in ('lab_result', 'report_row')")
    return reduce(DataFrame.unionByName, [
        note(points, "single value").where("n = 1"),
        note(measured.where("status = 'non_numeric'"), "qualitative"),
        note(measured.where("not usable and status not in ('ok', 'non_numeric')"), "set aside", "status"),
        note(n.where("kind = 'lab_report' and start is null"), "report without a date", "label"),
        note(same.withColumn("analyte", F.lit(None).cast("string")), "repeats a result"),
    ])
