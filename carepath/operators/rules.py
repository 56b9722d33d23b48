"""Guideline and medication rules as of a day, for all patients at once.

Every rule is a grouping or a join over the tables of operators.graph; what cannot be assessed is
a result with a reason. Thresholds are of published guidelines and labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions import clinical as cl
from carepath.operators import core

_SNOMED, _ICD, _RX = "http://snomed.info/sct|", "http://hl7.org/fhir/sid/icd-10|", "http://www.nlm.nih.gov/research/umls/rxnorm|"

# Codes of diagnoses, procedures and drugs that the rules read.
STAGES = {_SNOMED + "431855005": 1, _SNOMED + "431856006": 2, _SNOMED + "433144002": 3, _SNOMED + "431857002": 4}
FAILURE = tuple(_SNOMED + c for c in ("46177005", "698306007", "161665007", "213150003"))
KIDNEY = (*STAGES, *FAILURE, *(_SNOMED + c for c in ("127013003", "90781000119102", "157141000119108", "204949001")))
DIALYSIS = _SNOMED + "265764009"
ANAEMIA = (_SNOMED + "271737000", _ICD + "D46.4")
PREGNANCY = tuple(_SNOMED + c for c in ("72892002", "79586000"))
SMOKING, SMOKER, NOT_SMOKER = "http://loinc.org|72166-2", ("Smokes tobacco daily (finding)",), ("Never smoked tobacco (finding)", "Ex-smoker (finding)")
METFORMIN, EPOETIN = _RX + "860975", _RX + "205923"
NSAIDS = tuple(_RX + c for c in ("849574", "198014", "198405", "310965", "206905"))
RAS = {
    "lisinopril": ("197884", "205326", "311353", "311354", "314076", "314077"), "lisinopril+HCTZ": ("197885", "197886"), "enalapril": ("858804", "858810", "858817"),
    "ramipril": ("198188", "198189"), "ramipril (other label)": ("261962",), "amlodipine+benazepril": ("898356",), "losartan": ("979480", "979485", "979492"),
    "losartan+HCTZ": ("979464", "979468", "979471"), "valsartan": ("349199", "349201"), "valsartan+HCTZ": ("349353",), "telmisartan": ("213432",), "sacubitril+valsartan": ("1656356",),
}
EGFR_BELOW, ACR_FROM, SPAN_DAYS, DIALYSIS_DAYS = 60, 30, 90, 30
METFORMIN_STOP, METFORMIN_CAUTION = 30, 45
EVIDENCE = "array<struct<date:date,label:string,value:string,note:string,node:string>>"
ASSESSMENT = ("patient", "rule", "status", "category", "reason", "evidence")

# What a flag or note of each rule says: kind, title, statement, sources, limitations.
_ELSEWHERE = "Tests and treatment elsewhere, not on this record, are not seen."
_MARKERS = "Of the signs of kidney damage only eGFR and urine ACR are read, and acute injury is not ruled out."
WORDING = {
    "ckd_no_diagnosis": ("criteria_met_no_diagnosis", "Kidney values meet the CKD criteria and no kidney diagnosis is on record", "The values shown stayed abnormal for 90 days or more.", ("KDIGO 2024",), (_MARKERS,)),
    "anaemia_no_diagnosis": ("criteria_met_no_diagnosis", "Haemoglobin is under the cutoff and no anaemia diagnosis is on record", "The latest haemoglobin is under every cutoff that applies.", ("WHO 2024",), ("One value does not tell a cause.",)),
    "gfr_due": ("follow_up_due", "A kidney filtration test is due", "None is on record in the last 12 months.", ("KDIGO 2024",), (_ELSEWHERE,)),
    "albuminuria_due": ("follow_up_due", "A urine albumin test is due", "None is on record in the last 12 months.", ("KDIGO 2024",), (_ELSEWHERE,)),
    "haemoglobin_due": ("follow_up_due", "A haemoglobin test is due", "None is on record within the interval for this stage.", ("KDIGO 2012",), (_ELSEWHERE,)),
    "metformin_stop": ("label", "Metformin is active with an eGFR under 30", "The label advises against its use at this level.", ("drug label",), (_ELSEWHERE,)),
    "metformin_caution": ("label", "Metformin is active with an eGFR under 45", "The label asks to weigh benefit and risk at this level.", ("drug label",), (_ELSEWHERE,)),
    "epoetin_haemoglobin_due": ("label", "Epoetin is active and a haemoglobin test is due", "None is on record in the last month.", ("drug label",), (_ELSEWHERE,)),
    "ras_nsaid": ("note", "A RAS drug and an NSAID are active together", "Their labels name each other.", ("drug label",), ("Over-the-counter use is not on record.",)),
}


def _fact(day: Column, label: Column | str, value: Column | None, note: Column | None, node: Column) -> Column:
    """One item of evidence; null without a node."""
    text = lambda c: (F.lit(None) if c is None else F.lit(c) if isinstance(c, str) else c).cast("string")
    names = ("date", "label", "value", "note", "node")
    made = (day.cast("date"), text(label), text(value), text(note), text(node))
    return F.when(node.isNotNull(), F.named_struct(*[x for k, c in zip(names, made, strict=True) for x in (F.lit(k), c)]))


def _facts(*facts: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*facts))).cast(EVIDENCE)


def _number(value: Column) -> Column:
    """A value without the zeros of its type's scale."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def _hb_fact(cut: Column | None = None) -> Column:
    note = None if cut is None else F.concat(F.lit("cutoff "), F.array_join(F.array_sort(F.array_distinct(cut)), " or "), F.lit(" g/L"))
    return _fact(F.col("day"), "haemoglobin", F.concat(F.coalesce("comparator", F.lit("")), _number(F.col("g_l")), F.lit(" g/L")), note, F.col("node"))


def _gfr_fact() -> Column:
    value, note = F.concat(F.col("whole").cast("string"), F.lit(" mL/min/1.73 m2")), F.concat(F.lit("creatinine "), _number(F.col("creatinine")), F.lit(" mg/dL"))
    return _fact(F.col("day"), "eGFR computed from creatinine", value, note, F.col("node"))


def _assessment(df: DataFrame) -> DataFrame:
    """Rows in the shape of all assessments; what a rule has not is null."""
    none = {"evidence": F.array().cast(EVIDENCE)}
    return df.select(*[F.col(c) if c in df.columns else none.get(c, F.lit(None).cast("string")).alias(c) for c in ASSESSMENT])


@dataclass(frozen=True)
class Context:
    """The as-of views that the rules read; each has `patient`."""

    as_of: Column
    patient: DataFrame  # source as patient, gender, birth, deceased of those evaluated
    points: DataFrame  # series points up to the day
    tests: DataFrame  # analyte and day of every test up to the day, usable or not
    diagnoses: DataFrame  # code, recorded, onset, abatement (dates)
    drugs: DataFrame  # latest request of each code up to the day: code, label, status, day, node
    procedures: DataFrame  # code, day
    smoking: DataFrame  # day, text


def context(patient: DataFrame, n: DataFrame, points: DataFrame, as_of: str) -> Context:
    """Views of data up to a day; who died on or before it is not evaluated. Conditions are not cut by the day."""
    day = F.lit(as_of).cast("date")
    alive = patient.select(F.col("source").alias("patient"), "gender", F.col("birth.date").alias("birth"), F.col("deceased.date").alias("deceased")).where(F.col("deceased").isNull() | (F.col("deceased") > day))
    dated = n.withColumn("day", F.col("start.date"))
    upto = dated.where(F.col("day") <= day)
    drugs = core.latest_by(upto.where("kind = 'medication_request'"), ["patient", "code"], ["day", "node"], "label", "status", "day", "node")
    return Context(
        day, alive, points.where(F.col("day") <= day), upto.where("kind in ('lab_result', 'report_row') and analyte is not null").select("patient", "analyte", "day", "node"),
        dated.where("kind = 'condition'").select("patient", "code", F.col("day").alias("recorded"), F.col("day").alias("onset"), F.col("end.date").alias("abatement"), "node"),
        drugs, upto.where("kind = 'procedure'").select("patient", "code", "day", "node"), upto.where(F.col("code") == SMOKING).select("patient", "day", "node", F.col("detail").alias("text")),
    )


def computed_egfr(c: Context) -> DataFrame:
    """For each creatinine point: the eGFR by CKD-EPI 2021, or why there is none."""
    p = c.points.where("analyte = 'creatinine'").join(c.patient, "patient")
    age = cl.completed_years(F.col("birth"), F.col("day"))
    reason = F.when(F.col("birth").isNull(), "no birth date").when(age < 18, "under 18").when(~F.col("gender").isin("male", "female"), "sex not known").when(F.col("comparator").isNotNull(), "comparator")
    value = F.when(reason.isNull(), cl.ckd_epi_2021(F.col("value"), age, F.col("gender") == "female"))
    return p.select("patient", "node", "day", "instant", F.col("value").alias("creatinine"), age.alias("age"), value.alias("egfr"), cl.whole(value).alias("whole"), reason.alias("skipped"))


def _recorded(c: Context, codes: tuple[str, ...]) -> DataFrame:
    return c.diagnoses.where(F.col("code").isin(*codes) & (F.coalesce("recorded", c.as_of) <= c.as_of))


def assess_ckd(c: Context, egfr: DataFrame) -> DataFrame:
    """status (met, not_met, not_assessable), since, category, of every evaluated patient."""
    order = ["day", "instant", "node"]
    gfr = egfr.where("whole is not null").select("patient", *order, (F.col("whole") < EGFR_BELOW).alias("abnormal"), "whole", _gfr_fact().alias("fact"))
    shown = F.concat(F.coalesce("comparator", F.lit("")), _number(F.col("value")), F.lit(" mg/g"))
    acr = c.points.where("analyte = 'urine_acr'").select("patient", *order, "value", "comparator", cl.at_least(F.col("value"), F.col("comparator"), ACR_FROM).alias("abnormal"), _fact(F.col("day"), "urine ACR", shown, None, F.col("node")).alias("fact"))
    out = c.patient.select("patient")
    for name, x in (("gfr", gfr), ("acr", acr.where("abnormal is not null"))):
        run = core.run_rows(x, ["patient"], order, F.col("abnormal"))
        picks = core.evidence_picks(run, ["patient"], order, "day", "fact", days=SPAN_DAYS).where("later is not null")
        out = out.join(picks.select("patient", F.col("first.date").alias(f"since_{name}"), _facts(F.col("first"), F.col("later"), F.col("latest")).alias(f"run_{name}")), "patient", "left")
    latest_g = core.latest_by(gfr, ["patient"], order, "whole", "fact").select("patient", cl.gfr_category(F.col("whole")).alias("g"), F.col("whole").alias("latest_egfr"), F.col("fact").alias("fact_g"))
    a = F.when(F.col("comparator").isNull(), cl.albuminuria_category(F.col("value"))).alias("a")
    latest_a = core.latest_by(acr, ["patient"], order, "value", "comparator").select("patient", a, F.lit(True).alias("has_acr"))
    judged = core.latest_by(acr.where("abnormal is not null"), ["patient"], order, "fact").withColumnRenamed("fact", "fact_a")
    out = out.join(latest_g, "patient", "left").join(latest_a, "patient", "left").join(judged, "patient", "left").withColumn("since", F.least("since_gfr", "since_acr"))
    status = F.when(F.col("since").isNotNull(), "met").when(F.col("g").isNull() & F.col("fact_a").isNull(), "not_assessable").otherwise("not_met")
    none = F.array().cast(EVIDENCE)
    evidence = F.when(F.col("since").isNotNull(), F.concat(F.coalesce("run_gfr", none), F.coalesce("run_acr", none))).otherwise(_facts(F.col("fact_g"), F.col("fact_a")))
    why = F.concat(F.lit("no eGFR could be computed; "), F.when(F.col("has_acr"), "no urine ACR that tells a category").otherwise("no usable urine ACR"))
    category = F.concat_ws(" ", "g", "a")
    return out.select("patient", F.lit("ckd_criteria").alias("rule"), status.alias("status"), "since", F.when(category != "", category).alias("category"), "g", "latest_egfr", F.when(status == "not_assessable", why).alias("reason"), evidence.alias("evidence"))


def ckd_without_diagnosis(c: Context, ckd: DataFrame) -> DataFrame:
    """Patients who meet the criteria and have neither a kidney diagnosis that still stood nor dialysis since."""
    met = ckd.where("status = 'met'").select("patient", "since", "evidence")
    known = _recorded(c, KIDNEY).select("patient", "abatement")
    stood = core.within(met, known, ["patient"], F.expr("r.abatement is null or r.abatement >= l.since"), there=False)
    sessions = c.procedures.where(F.col("code") == DIALYSIS).select("patient", "day")
    return core.within(stood, sessions, ["patient"], F.expr("r.day >= l.since"), there=False).select("patient", F.lit("ckd_no_diagnosis").alias("rule"), "evidence")


def assess_anaemia(c: Context) -> DataFrame:
    """For every evaluated patient: the latest haemoglobin against the cutoffs that apply on its day; all cutoffs that apply must agree."""
    hb = core.latest_by(c.points.where("analyte = 'hemoglobin'"), ["patient"], ["day", "instant", "node"], "value", "comparator", "day", "node")
    hb = c.patient.join(hb, "patient", "left").withColumn("g_l", F.col("value").cast("double") * 10)
    spans = c.diagnoses.where(F.col("code").isin(*PREGNANCY)).select("patient", "onset", "abatement")
    expecting = core.within(hb.select("patient", "day"), spans, ["patient"], F.expr("r.onset <= l.day and coalesce(r.abatement, l.day) >= l.day"), there=True).select("patient", F.lit(True).alias("pregnant"))
    smoke = hb.where("day is not null").select("patient", F.col("day").alias("hb_day")).join(c.smoking, "patient").where("day <= hb_day")
    smoke = core.latest_by(smoke, ["patient"], ["day", "node"], "text").select("patient", F.when(F.col("text").isin(*SMOKER), True).when(F.col("text").isin(*NOT_SMOKER), False).alias("smoker"))
    x = hb.join(expecting, "patient", "left").join(smoke, "patient", "left")
    female = F.when(F.col("gender") == "female", True).when(F.col("gender") == "male", False)
    cut = cl.haemoglobin_cutoffs(cl.completed_months(F.col("birth"), F.col("day")), female, F.coalesce("pregnant", F.lit(False)))
    cut = F.transform(cut, lambda k: k + F.when(F.col("smoker"), 3).otherwise(0))
    low = F.transform("cut", lambda k: cl.below(F.col("g_l"), F.col("comparator"), k.cast("double")))
    x = x.withColumn("cut", cut).withColumn("low", low)
    status = (
        F.when(F.col("g_l").isNull() | F.col("birth").isNull() | F.col("cut").isNull(), "not_assessable")
        .when(F.forall("low", lambda b: F.coalesce(b, F.lit(False))), "met")
        .when(F.forall("low", lambda b: F.coalesce(~b, F.lit(False))), "not_met")
        .otherwise("not_assessable")
    )
    reason = F.when(F.col("g_l").isNull(), "no usable haemoglobin").when(F.col("birth").isNull(), "no birth date").when(F.col("cut").isNull(), "no cutoff for the age").otherwise("the cutoffs that apply disagree")
    return x.select("patient", F.lit("anaemia_criteria").alias("rule"), status.alias("status"), "day", "g_l", "cut", "node", F.when(status == "not_assessable", reason).alias("reason"), _facts(_hb_fact(F.col("cut"))).alias("evidence"))


def anaemia_without_diagnosis(c: Context, anaemia: DataFrame) -> DataFrame:
    met = anaemia.where("status = 'met'").select("patient", "day", "evidence")
    return core.within(met, _recorded(c, ANAEMIA).select("patient", "abatement"), ["patient"], F.expr("r.abatement is null or r.abatement >= l.day"), there=False).select("patient", F.lit("anaemia_no_diagnosis").alias("rule"), "evidence")


def _last(c: Context, *analytes: str) -> DataFrame:
    """The day and node of each patient's last test of these analytes, usable or not."""
    return c.tests.where(F.col("analyte").isin(*analytes)).groupBy("patient").agg(F.max(F.struct("day", "node")).alias("last"))


def follow_up(c: Context, ckd: DataFrame) -> DataFrame:
    """For patients with known kidney disease: whether the filtration, albumin and haemoglobin tests are due."""
    staged = _recorded(c, tuple(STAGES)).where(F.col("abatement").isNull() | (F.col("abatement") > c.as_of))
    table = F.create_map(*[F.lit(x) for p in STAGES.items() for x in p])
    staged = staged.groupBy("patient").agg(F.max(F.try_element_at(table, F.col("code"))).alias("stage"))
    failed = _recorded(c, FAILURE).select("patient").unionByName(c.procedures.where((F.col("code") == DIALYSIS) & (F.col("day") >= F.date_sub(c.as_of, DIALYSIS_DAYS))).select("patient")).distinct().withColumn("failed", F.lit(True))
    known = ckd.select("patient", "status", "g").join(staged, "patient", "left").where("stage is not null or status = 'met'").join(failed, "patient", "left").join(c.patient.select("patient", "birth"), "patient")
    young = cl.completed_years(F.col("birth"), c.as_of) < 18
    by_g = F.when(F.col("g").isin("G3a", "G3b"), 12).when(F.col("g").isin("G4", "G5"), 6)
    hb_months = F.when(F.col("g").isNotNull(), by_g).otherwise(F.when(F.col("stage") == 3, 12).when(F.col("stage") == 4, 6))
    x = known
    for name, last in (("gfr", _last(c, "creatinine", "egfr")), ("acr", _last(c, "urine_acr")), ("protein", _last(c, "urine_protein")), ("hb", _last(c, "hemoglobin"))):
        x = x.join(last.withColumnRenamed("last", name), "patient", "left")
    x = x.withColumn("albumin", F.when(young, F.greatest("acr", "protein")).otherwise(F.col("acr")))
    outside, tests = "kidney failure, dialysis or transplant is outside these rules", []
    for rule, last, months, label in (("gfr_due", "gfr", F.lit(12), "last filtration test"), ("albuminuria_due", "albumin", F.lit(12), "last urine test"), ("haemoglobin_due", "hb", hb_months, "last haemoglobin test")):
        day = F.col(last)["day"]
        due = day.isNull() | (day < F.add_months(c.as_of, -months))
        reason = F.when(F.col("failed"), outside).when(months.isNull(), "an interval is set for stages 3 to 5 only")
        status = F.when(reason.isNotNull(), "not_assessable").when(due, "met").otherwise("not_met")
        evidence = F.when(reason.isNull(), _facts(_fact(day, label, None, None, F.col(last)["node"]))).otherwise(F.array().cast(EVIDENCE))
        tests.append(x.select("patient", F.lit(rule).alias("rule"), status.alias("status"), day.alias("last_test"), reason.alias("reason"), evidence.alias("evidence")))
    return reduce(DataFrame.unionByName, tests)


def medications(c: Context, egfr: DataFrame) -> DataFrame:
    """(patient, rule, status, detail, reason, evidence) of the metformin, epoetin and RAS with NSAID rules, for those with the drug active."""
    latest = core.latest_by(egfr.where("whole is not null").withColumn("fact", _gfr_fact()), ["patient"], ["day", "instant", "node"], "whole", "fact")
    drug = _fact(F.col("day"), F.col("label"), F.col("status"), None, F.col("node")).alias("drug")
    drugs = c.drugs.join(c.patient.select("patient"), "patient").where("status = 'active'").select("patient", "code", "label", "day", "node", drug)
    met = drugs.where(F.col("code") == METFORMIN).select("patient", "drug").join(latest, "patient", "left")
    w, none = F.col("whole"), F.lit(None).cast("string")
    status = F.when(w.isNull(), "not_assessable").when(w < METFORMIN_CAUTION, "met").otherwise("not_met")
    rule = F.when(w < METFORMIN_STOP, "metformin_stop").otherwise("metformin_caution")
    a = met.select("patient", rule.alias("rule"), status.alias("status"), w.cast("string").alias("detail"), F.when(w.isNull(), "no eGFR could be computed").alias("reason"), _facts(F.col("drug"), F.col("fact")).alias("evidence"))
    epo = drugs.where(F.col("code") == EPOETIN).select("patient", "drug").join(_last(c, "hemoglobin"), "patient", "left")
    day = F.col("last")["day"]
    due = day.isNull() | (day < F.add_months(c.as_of, -1))
    b = epo.select("patient", F.lit("epoetin_haemoglobin_due").alias("rule"), F.when(due, "met").otherwise("not_met").alias("status"), day.cast("string").alias("detail"), none.alias("reason"), _facts(F.col("drug"), _fact(day, "last haemoglobin test", None, None, F.col("last")["node"])).alias("evidence"))
    table = F.create_map(*[F.lit(x) for g, codes in RAS.items() for code in codes for x in (_RX + code, g)])
    ras = drugs.withColumn("group", F.try_element_at(table, F.col("code"))).where("group is not null")
    ras = core.latest_by(ras, ["patient", "group"], ["day", "node"], "drug").withColumnRenamed("drug", "ras")
    nsaid = core.latest_by(drugs.where(F.col("code").isin(*NSAIDS)), ["patient"], ["day", "node"], "label", "drug")
    d = ras.join(nsaid, "patient").select("patient", F.lit("ras_nsaid").alias("rule"), F.lit("note").alias("status"), F.concat_ws(" + ", "group", "label").alias("detail"), none.alias("reason"), _facts(F.col("ras"), F.col("drug")).alias("evidence"))
    return a.unionByName(b).unionByName(d)


# Words of a topic, and the topics that each rule needs to be read.
TOPIC_WORDS = {"kidney": "kidney|renal|nephr|dialysis", "anaemia": "ana?emia", "metformin": "metformin", "epoetin": "epoetin|erythropoietin", "ras_nsaid": "pril\\b|sartan\\b|ibuprofen|naproxen|diclofenac|meloxicam"}
NEEDS = {
    "ckd_no_diagnosis": ("kidney", "lab"), "gfr_due": ("kidney", "lab"), "albuminuria_due": ("kidney", "lab"), "haemoglobin_due": ("kidney", "lab"), "anaemia_no_diagnosis": ("anaemia", "lab"),
    "metformin_stop": ("metformin", "lab"), "metformin_caution": ("metformin", "lab"), "epoetin_haemoglobin_due": ("epoetin", "lab"), "ras_nsaid": ("ras_nsaid", "lab"),
}


def unread(n: DataFrame, as_of: Column) -> DataFrame:
    """(patient, topic, node): records up to the day whose words are of a topic but whose code no rule reads."""
    rows = n.where(F.col("start").isNull() | (F.col("start.date") <= as_of))
    listed = {"kidney": (*KIDNEY, DIALYSIS), "anaemia": ANAEMIA, "metformin": (METFORMIN,), "epoetin": (EPOETIN,), "ras_nsaid": (*NSAIDS, *(_RX + c for cs in RAS.values() for c in cs))}
    kinds = {"kidney": ("condition", "procedure"), "anaemia": ("condition",)}
    found = []
    for topic, pattern in TOPIC_WORDS.items():
        of = F.col("kind").isin(*kinds.get(topic, ("medication_request",)))
        found.append(rows.where(of & F.lower("label").rlike(pattern) & ~F.coalesce(F.col("code").isin(*listed[topic]), F.lit(False))).select("patient", F.lit(topic).alias("topic"), "node"))
    from carepath.functions.labs import analyte_of_name

    named = (F.col("kind") == "observation") & ~F.coalesce(F.col("code").startswith("http://loinc.org|"), F.lit(False)) & analyte_of_name(F.col("label")).isNotNull()
    found.append(rows.where(named).select("patient", F.lit("lab").alias("topic"), "node"))
    return reduce(DataFrame.unionByName, found)


def guarded(flags: DataFrame, unread_: DataFrame) -> DataFrame:
    """The flags whose rule needs no topic with unread records; criteria assessments are not touched."""
    needs = flags.sparkSession.createDataFrame([(r, t) for r, ts in NEEDS.items() for t in ts], "rule string, topic string")
    unchecked = unread_.select("patient", "topic").distinct().join(F.broadcast(needs), "topic").select("patient", "rule").distinct()
    return flags.join(unchecked, ["patient", "rule"], "left_anti")


def worded(flags: DataFrame) -> DataFrame:
    """Flags (patient, rule, evidence) with what they say, in the shape that evidence.pack reads beside statements and passages."""
    form = "struct<kind:string,title:string,statement:string,sources:array<string>,limitations:array<string>>"
    strings = lambda xs: F.array(*map(F.lit, xs))
    said = [x for rule, (kind, title, text, sources, limits) in WORDING.items() for x in (F.lit(rule), F.struct(F.lit(kind), F.lit(title), F.lit(text), strings(sources), strings(limits)).cast(form))]
    out = flags.withColumn("said", F.try_element_at(F.create_map(*said), F.col("rule")))
    return out.select("patient", "rule", "said.kind", "said.title", "said.statement", "evidence", "said.sources", "said.limitations")


def evaluate(patient: DataFrame, n: DataFrame, points: DataFrame, as_of: str, *, guard: bool = True) -> dict[str, DataFrame]:
    """Assessments and flags, with their evidence, of every patient alive on the day."""
    c = context(patient, n, points, as_of)
    egfr = computed_egfr(c)
    ckd, anaemia, meds = assess_ckd(c, egfr), assess_anaemia(c), medications(c, egfr)
    due = follow_up(c, ckd)
    hit = lambda df: df.where(F.col("status").isin("met", "note")).select("patient", "rule", "evidence")
    flags = worded(reduce(DataFrame.unionByName, [ckd_without_diagnosis(c, ckd), anaemia_without_diagnosis(c, anaemia), hit(due), hit(meds)]))
    missed = unread(n, c.as_of)
    every = reduce(DataFrame.unionByName, map(_assessment, (ckd, anaemia, due, meds)))
    return {"assessment": every, "flag": guarded(flags, missed) if guard else flags, "computed_egfr": egfr, "unread": missed}
