"""The record side applied to the given tables: events as laboratory results, through graph and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.operators import graph, rules
from carepath.plans.table_queries import _t, query

AS_OF = "2024-01-01"


def _results(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patients, nodes): each sign-up read as a creatinine and each purchase as a urine ACR, days twelve times as far apart."""
    user, event = F.col("user_id"), F.col("event_id")
    birth = F.when(user % 10 != 0, F.date_add(F.lit("1940-01-01").cast("date"), (user % 20000).cast("int")))
    who = events.select("user_id").distinct()
    at = lambda day, instant: F.named_struct(F.lit("date"), day, F.lit("precision"), F.lit("day"), F.lit("instant"), instant)
    none = F.lit(None).cast("timestamp")
    patients = who.select(user.cast("string").alias("source"), F.when(user % 2 == 0, "female").otherwise("male").alias("gender"), at(birth, none).alias("birth"), at(F.lit(None).cast("date"), none).alias("deceased"))
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 12)
    analyte = F.when(F.col("event_type") == "signup", "creatinine").when(F.col("event_type") == "purchase", "urine_acr")
    value = F.when(analyte == "creatinine", (8 + 3 * (event % 8)) / 10).otherwise(F.col("value"))
    rows = events.select(
        user.cast("string").alias("source"), F.lit(0).alias("seq"), F.lpad(event.cast("string"), 12, "0").alias("id"), F.col("event_type").alias("label"), analyte.alias("analyte"), value.alias("value"),
        at(day, F.col("ts").cast("timestamp")).alias("start"), F.when((analyte == "urine_acr") & (event % 9 == 0), "<").alias("comparator"),
    )
    named = {c: c for c in ("label", "analyte", "value", "start", "comparator")}
    return patients, graph._node(rows.where("analyte is not null"), "lab_result", status=F.lit("ok"), usable=F.lit(True), **named)


@query("""
WITH d AS (SELECT user_id, event_id, ts, event_type, value, DATE '2023-01-01' + 12 * CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
  user_id % 2 = 0 AS female, CASE WHEN user_id % 10 <> 0 THEN DATE '1940-01-01' + CAST(user_id % 20000 AS INTEGER) END AS birth FROM events),
c AS (SELECT *, (8 + 3 * (event_id % 8)) / 10.0::DOUBLE / CASE WHEN female THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS ratio,
  floor(((year(day) - year(birth)) * 12 + month(day) - month(birth) - CASE WHEN day(day) < day(birth) THEN 1 ELSE 0 END) / 12) AS age FROM d WHERE event_type = 'signup' AND birth IS NOT NULL),
g AS (SELECT user_id, day, ts, event_id, CAST(floor(142 * pow(least(ratio, 1), CASE WHEN female THEN -0.241 ELSE -0.302 END) * pow(greatest(ratio, 1), -1.2) * pow(0.9938, age) * CASE WHEN female THEN 1.012::DOUBLE ELSE 1 END + 0.5) AS INTEGER) AS whole FROM c),
a AS (SELECT user_id, day, ts, event_id, value, event_id % 9 = 0 AS censored FROM d WHERE event_type = 'purchase'),
p AS (SELECT user_id, 'g' AS marker, day, ts, event_id, whole < 60 AS abnormal FROM g UNION ALL SELECT user_id, 'a', day, ts, event_id, CASE WHEN NOT censored THEN value >= 30 WHEN value <= 30 THEN false END FROM a),
r AS (SELECT *, sum(CASE WHEN abnormal THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, marker ORDER BY day DESC, ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM p WHERE abnormal IS NOT NULL),
f AS (SELECT *, min(day) OVER (PARTITION BY user_id, marker) AS first_day FROM r WHERE breaks = 0),
s AS (SELECT user_id, marker, first_day, CASE count(*) FILTER (day - first_day >= 90) WHEN 1 THEN 2 ELSE 3 END AS picked FROM f GROUP BY ALL HAVING max(day) - first_day >= 90),
m AS (SELECT user_id, min(first_day) AS since, sum(picked) AS picked FROM s GROUP BY 1),
lg AS (SELECT user_id, whole FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, ts DESC, event_id DESC) = 1),
la AS (SELECT user_id, CASE WHEN censored THEN NULL WHEN value < 30 THEN 'A1' WHEN value <= 300 THEN 'A2' ELSE 'A3' END AS a FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, ts DESC, event_id DESC) = 1),
j AS (SELECT DISTINCT user_id FROM p WHERE marker = 'a' AND abnormal IS NOT NULL)
SELECT CAST(u.user_id AS VARCHAR) AS patient, CASE WHEN since IS NOT NULL THEN 'met' WHEN whole IS NULL AND j.user_id IS NULL THEN 'not_assessable' ELSE 'not_met' END AS status, since, whole AS latest_egfr,
  nullif(concat_ws(' ', CASE WHEN whole >= 90 THEN 'G1' WHEN whole >= 60 THEN 'G2' WHEN whole >= 45 THEN 'G3a' WHEN whole >= 30 THEN 'G3b' WHEN whole >= 15 THEN 'G4' WHEN whole IS NOT NULL THEN 'G5' END, a), '') AS category,
  CAST(CASE WHEN since IS NOT NULL THEN picked ELSE CASE WHEN whole IS NULL THEN 0 ELSE 1 END + CASE WHEN j.user_id IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS items
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m USING (user_id) LEFT JOIN lg USING (user_id) LEFT JOIN la USING (user_id) LEFT JOIN j USING (user_id)""")
def kidney_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kidney criteria of every user, with the number of records they rest on."""
    patients, nodes = _results(_t(spark, sf_dir, "events"))
    c = rules.context(patients, nodes, graph.series(nodes, graph.same_measurement(nodes)), AS_OF)
    found = rules.assess_ckd(c, rules.computed_egfr(c))
    return found.select("patient", "status", "since", "latest_egfr", "category", F.size("evidence").cast("long").alias("items"))


# ---- haemoglobin, pregnancies and smoking read from the events, through the anaemia rule and the concept map


def _start(df: DataFrame) -> DataFrame:
    """The events with their day (twelve times as far apart), the same as a timepoint, and an id that sorts as the number does."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 12)
    at = F.struct(day.alias("date"), F.lit("day").alias("precision"), F.col("ts").cast("timestamp").alias("instant"))
    return df.select("*", F.col("user_id").cast("string").alias("source"), F.lit(0).alias("seq"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), at.alias("at"), day.alias("on"))


def _blood(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patients, nodes): errors as haemoglobin, views of every sixth user as pregnancies of 60 days, clicks as smoking answers."""
    user, event = F.col("user_id"), F.col("event_id")
    at = lambda day: F.struct(day.alias("date"), F.lit("day").alias("precision"), F.lit(None).cast("timestamp").alias("instant"))
    birth = F.when(user % 10 != 7, F.date_add(F.lit("1950-01-01").cast("date"), (user * 180 % 25000).cast("int")))
    who = events.select("user_id").distinct()
    patients = who.select(user.cast("string").alias("source"), F.when(user % 2 == 0, "female").otherwise("male").alias("gender"), at(birth).alias("birth"), at(F.lit(None).cast("date")).alias("deceased"))
    rows, label = _start(events), F.concat(F.col("event_type"), (event % 3).cast("string"))
    answer = F.when(event % 3 == 0, rules.SMOKER[0]).when(event % 3 == 1, rules.NOT_SMOKER[0]).otherwise("Not asked")
    hb = graph._node(rows.where("event_type = 'error'"), "lab_result", label=label, analyte=F.lit("hemoglobin"), value=(90 + event % 60) / 10, start="at", comparator=F.when(event % 11 == 0, "<"), status=F.lit("ok"), usable=F.lit(True))
    expecting = graph._node(rows.where("event_type = 'view' and user_id % 6 = 0"), "condition", label=label, code=F.lit(rules.PREGNANCY[0]), start="at", end=at(F.date_add("on", 60)))
    smoking = graph._node(rows.where("event_type = 'click'"), "observation", label=label, code=F.lit(rules.SMOKING), start="at", detail=answer)
    return patients, hb.unionByName(expecting).unionByName(smoking)


@query("""
WITH d AS (SELECT user_id, event_id, ts, event_type, DATE '2023-01-01' + 12 * CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
  CASE WHEN user_id % 10 <> 7 THEN DATE '1950-01-01' + CAST(user_id * 180 % 25000 AS INTEGER) END AS birth FROM events),
h AS (SELECT user_id, day, birth, 90 + event_id % 60 AS g, event_id % 11 = 0 AS censored FROM d WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, ts DESC, event_id DESC) = 1),
e AS (SELECT DISTINCT h.user_id FROM h JOIN d ON h.user_id = d.user_id AND event_type = 'view' AND d.user_id % 6 = 0 AND d.day <= h.day AND d.day + 60 >= h.day),
s AS (SELECT h.user_id, event_id % 3 = 0 AS smoker FROM h JOIN d ON h.user_id = d.user_id AND event_type = 'click' AND d.day <= h.day QUALIFY row_number() OVER (PARTITION BY h.user_id ORDER BY d.day DESC, event_id DESC) = 1),
m AS (SELECT h.*, e.user_id IS NOT NULL AS expecting, CASE WHEN smoker THEN 3 ELSE 0 END AS more,
  (year(day) - year(birth)) * 12 + month(day) - month(birth) - CASE WHEN day(day) < day(birth) THEN 1 ELSE 0 END AS months FROM h LEFT JOIN e ON h.user_id = e.user_id LEFT JOIN s ON h.user_id = s.user_id),
b AS (SELECT *, CASE WHEN expecting THEN 105 WHEN months < 6 THEN NULL WHEN months < 24 THEN 105 WHEN months < 60 THEN 110 WHEN months < 144 THEN 115 WHEN months < 180 THEN 120 WHEN months < 792 THEN CASE WHEN user_id % 2 = 0 THEN 120 ELSE 130 END END + more AS low FROM m),
k AS (SELECT *, CASE WHEN expecting THEN 110 + more ELSE low END AS high FROM b),
r AS (SELECT *, CASE WHEN birth IS NULL THEN 'no birth date' WHEN low IS NULL THEN 'no cutoff for the age' WHEN g < low OR censored AND g = low THEN 'met' WHEN NOT censored AND g >= high THEN 'not_met' ELSE 'the cutoffs that apply disagree' END AS found FROM k)
SELECT CAST(u.user_id AS VARCHAR) AS patient, CASE WHEN found IN ('met', 'not_met') THEN found ELSE 'not_assessable' END AS status, day,
  CASE WHEN found IS NULL THEN 'no usable haemoglobin' WHEN found NOT IN ('met', 'not_met') THEN found END AS reason, CAST(CASE WHEN found IS NULL THEN 0 ELSE 1 END AS BIGINT) AS items
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON u.user_id = r.user_id""")
def anaemia_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest haemoglobin of every user against the cutoffs for age, sex, pregnancy and smoking as of its day."""
    patients, nodes = _blood(_t(spark, sf_dir, "events"))
    found = rules.assess_anaemia(rules.context(patients, nodes, graph.series(nodes, graph.same_measurement(nodes)), AS_OF))
    return found.select("patient", "status", "day", "reason", F.size("evidence").cast("long").alias("items"))


@query(f"""
WITH n AS (SELECT user_id, event_type || CAST(event_id % 3 AS VARCHAR) AS label, CASE event_type WHEN 'view' THEN '{rules.PREGNANCY[0]}' WHEN 'click' THEN '{rules.SMOKING}' END AS code,
  CASE event_type WHEN 'error' THEN 'analyte:hemoglobin' WHEN 'view' THEN 'condition|{rules.PREGNANCY[0]}' ELSE 'observation|{rules.SMOKING}' END AS concept
  FROM events WHERE event_type IN ('error', 'click') OR event_type = 'view' AND user_id % 6 = 0),
l AS (SELECT concept, label FROM n GROUP BY concept, label QUALIFY row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, label) = 1)
SELECT n.concept, count(DISTINCT user_id) AS patients, count(*) AS records, min(code) AS code, any_value(l.label) AS label FROM n JOIN l ON n.concept = l.concept GROUP BY 1""")
def cohort_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts of the same records: patients, records, code and most frequent label."""
    _, nodes = _blood(_t(spark, sf_dir, "events"))
    return graph.concept_map(nodes, graph.edges(nodes))[0]


@query("""
WITH d AS (SELECT CAST(user_id AS VARCHAR) AS patient, CAST(ts AS DATE) AS day, event_type, value / 10 AS v, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id FROM events WHERE event_type IN ('purchase', 'view')),
p AS (SELECT a.patient, a.id AS row_id, b.id AS result_id FROM d a JOIN d b ON a.patient = b.patient AND a.day = b.day AND a.event_type = 'view' AND b.event_type = 'purchase' AND abs(b.v - round(a.v)) <= 0.5 * (1 + 1e-12)),
c AS (SELECT patient, result_id AS id, count(*) AS n FROM p GROUP BY ALL)
SELECT d.patient, 'lab_result:' || d.id AS node, CAST(coalesce(n, 0) AS BIGINT) AS repeats FROM d LEFT JOIN c ON d.patient = c.patient AND d.id = c.id WHERE event_type = 'purchase'
UNION ALL SELECT d.patient, 'report_row:' || d.id, 0 FROM d WHERE event_type = 'view' AND id NOT IN (SELECT row_id FROM p)""")
def corroborated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the series of every user: purchases as results, views as printed rows, which drop out where they repeat a result of the day."""
    at = F.struct(F.to_date("ts").alias("date"), F.lit("day").alias("precision"), F.col("ts").cast("timestamp").alias("instant"))
    rows, v, printed = _start(_t(spark, sf_dir, "events")), F.col("value") / 10, F.round(F.col("value") / 10)
    same = {"label": F.lit("acr"), "analyte": F.lit("urine_acr"), "unit": F.lit("mg/g"), "status": F.lit("ok"), "usable": F.lit(True), "start": at}
    results = graph._node(rows.where("event_type = 'purchase'"), "lab_result", value=v, **same)
    nodes = results.unionByName(graph._node(rows.where("event_type = 'view'"), "report_row", value=printed, value_text=printed.cast("long"), **same))
    points = graph.series(nodes, graph.same_measurement(nodes))
    return points.select("patient", "node", F.size("corroborated_by").cast("long").alias("repeats"))


@query("""
WITH f AS (SELECT DISTINCT o_custkey AS patient, CASE o_orderkey % 3 WHEN 0 THEN 'metformin_stop' WHEN 1 THEN 'ras_nsaid' ELSE 'anaemia_no_diagnosis' END AS rule FROM orders),
u AS (SELECT o_custkey AS patient, CASE (o_orderkey // 3) % 4 WHEN 0 THEN 'metformin' WHEN 1 THEN 'ras_nsaid' WHEN 2 THEN 'anaemia' ELSE 'lab' END AS topic FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT patient, rule FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.patient = f.patient AND (topic = 'lab' OR starts_with(rule, topic)))""")
def guarded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of customers, without those whose rule needs a topic with records that nothing reads."""
    orders, patient = _t(spark, sf_dir, "orders"), F.col("o_custkey").alias("patient")
    k = F.col("o_orderkey")
    rule = F.when(k % 3 == 0, "metformin_stop").when(k % 3 == 1, "ras_nsaid").otherwise("anaemia_no_diagnosis")
    part = F.floor(k / 3) % 4
    topic = F.when(part == 0, "metformin").when(part == 1, "ras_nsaid").when(part == 2, "anaemia").otherwise("lab")
    return rules.guarded(orders.select(patient, rule.alias("rule")).distinct(), orders.where("o_orderpriority = '1-URGENT'").select(patient, topic.alias("topic"))).select("patient", "rule")
