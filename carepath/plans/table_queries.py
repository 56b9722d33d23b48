"""The generic operators applied to the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions import clinical as cl
from carepath.functions import labs, stems
from carepath.functions import text as tx
from carepath.operators import core, postings, retrieval
from carepath.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "1998-08-02"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH m AS (SELECT user_id, ts, event_id, value < 50 AS low FROM events),
s AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS breaks FROM m)
SELECT user_id, count(*) AS n, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day,
  CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS BIGINT) AS span,
  count(*) >= 2 AND date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) >= 3 AS persistent
FROM s WHERE breaks = 0 GROUP BY user_id""")
def trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of low values that each user's events end with."""
    return core.trailing_run(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 50, F.to_date("ts"), span_days=3)


@query("""
SELECT * FROM (SELECT user_id, event_type, event_id AS src, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL""")
def precedes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.precedes(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("""
WITH e AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders),
f AS (SELECT o_custkey, arg_min(o_orderkey, (day, o_orderkey)) AS first, arg_max(o_orderkey, (day, o_orderkey)) AS latest, min(day) AS d FROM e GROUP BY 1),
l AS (SELECT e.o_custkey, arg_min(o_orderkey, (day, o_orderkey)) AS later FROM e JOIN f ON e.o_custkey = f.o_custkey WHERE date_diff('day', d, day) >= 90 GROUP BY 1)
SELECT f.o_custkey, first, later, latest FROM f LEFT JOIN l ON f.o_custkey = l.o_custkey""")
def first_90_days_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, the first at least 90 days later, and the latest order of each customer."""
    orders = _t(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return core.evidence_picks(orders, ["o_custkey"], ["day", "o_orderkey"], "day", "o_orderkey")


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.latest_by(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


@query(f"""
SELECT c_custkey, last_test, last_test IS NULL OR last_test < CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS DATE) AS due
FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_test FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' GROUP BY 1) ON c_custkey = o_custkey""")
def last_test_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose last order lies more than six months back."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    return core.overdue(_t(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "day", as_of=F.lit(AS_OF).cast("date"), months=6)


@query("""
SELECT p.event_id, p.user_id, p.ts, (SELECT v.value FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) AS asof_value
FROM events p WHERE p.event_type = 'purchase'""")
def asof_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the value of the user's last view at or before it."""
    events = _t(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return core.asof_latest(bought, events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", ["ts", "event_id"], "value")


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT * FROM o l WHERE NOT EXISTS (SELECT 1 FROM o r WHERE r.o_custkey = l.o_custkey AND r.day < l.day AND r.day >= l.day - 90)""")
def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before which the customer had none for 90 days."""
    o = _order_days(spark, sf_dir)
    return core.near(o, o, ["o_custkey"], F.unix_date("day"), F.unix_date("day"), -90, -1, there=False)


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT * FROM o l WHERE EXISTS (SELECT 1 FROM o r WHERE r.o_custkey = l.o_custkey AND r.day > l.day AND r.day <= l.day + 30)""")
def interval_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after which the customer ordered again within 30 days."""
    o = _order_days(spark, sf_dir)
    return core.near(o, o, ["o_custkey"], F.unix_date("day"), F.unix_date("day"), 1, 30, there=True)


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS raw, round(l_extendedprice / 100) * 100 AS printed FROM lineitem)
SELECT r.l_orderkey AS row_order, r.l_linenumber AS row_line, v.l_orderkey AS result_order, v.l_linenumber AS result_line
FROM a r JOIN a v ON r.l_suppkey = v.l_suppkey AND r.day = v.day WHERE (r.l_orderkey <> v.l_orderkey OR r.l_linenumber <> v.l_linenumber) AND abs(v.raw - r.printed) <= 50 * (1 + 1e-12)""")
def half_unit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one supplier and day whose price repeats another's printed price within half a unit of its last digit."""
    a = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_extendedprice")
    r = a.select(F.col("l_orderkey").alias("row_order"), F.col("l_linenumber").alias("row_line"), "l_suppkey", "day", (F.round(F.col("l_extendedprice") / 100) * 100).alias("printed"))
    v = a.select(F.col("l_orderkey").alias("result_order"), F.col("l_linenumber").alias("result_line"), "l_suppkey", "day", "l_extendedprice")
    other = (F.col("row_order") != F.col("result_order")) | (F.col("row_line") != F.col("result_line"))
    near = core.band_pairs(r.withColumn("width", F.lit(50 * (1 + 1e-12))), v, ["l_suppkey", "day"], "printed", "l_extendedprice", "width")
    return near.where(other).select("row_order", "row_line", "result_order", "result_line")


@query("""
WITH u AS (SELECT l_orderkey, l_linenumber, l_quantity AS v, CASE l_linenumber WHEN 1 THEN 'mg/dL' WHEN 2 THEN 'umol/L' WHEN 3 THEN 'mmol/L' WHEN 4 THEN 'cups' WHEN 5 THEN ' MG / L ' WHEN 6 THEN 'µmol/l' END AS unit FROM lineitem),
c AS (SELECT *, CASE WHEN l_linenumber = 1 THEN v WHEN l_linenumber IN (2, 6) THEN v * 10 / 884 WHEN l_linenumber = 5 THEN v / 10 END AS x FROM u)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (4, 7) THEN 'unit_unknown' WHEN l_linenumber = 3 THEN 'unit_incompatible' WHEN x < 0.05 OR x > 40 THEN 'implausible' ELSE 'ok' END AS status, round(x, 6) AS canonical FROM c""")
def unit_convert_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities read as creatinine in units that are known, known but of another kind, and unknown."""
    n = F.col("l_linenumber")
    unit = F.when(n == 1, "mg/dL").when(n == 2, "umol/L").when(n == 3, "mmol/L").when(n == 4, "cups").when(n == 5, " MG / L ").when(n == 6, "µmol/l")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("creatinine").alias("analyte"), F.col("l_quantity").cast(labs.NUMBER).alias("value"), unit.alias("unit"))
    done = labs.converted(rows.withColumn("code", F.lit(None).cast("string")))
    return done.select("l_orderkey", "l_linenumber", "status", F.round(F.col("canonical").cast("double"), 6).alias("canonical"))


_EGFR = """
WITH p AS (SELECT c_custkey, 0.4 + abs(c_acctbal) / 2000 AS scr, 18 + c_custkey % 70 AS age, c_custkey % 2 = 0 AS f FROM customer),
e AS (SELECT *, 142 * pow(least(scr / CASE WHEN f THEN 0.7 ELSE 0.9 END, 1), CASE WHEN f THEN -0.241 ELSE -0.302 END) * pow(greatest(scr / CASE WHEN f THEN 0.7 ELSE 0.9 END, 1), -1.2) * pow(0.9938, age) * CASE WHEN f THEN 1.012 ELSE 1 END AS egfr FROM p)
"""


def _egfr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "customer").select("c_custkey", (0.4 + F.abs("c_acctbal") / 2000).alias("scr"), (18 + F.col("c_custkey") % 70).alias("age"), (F.col("c_custkey") % 2 == 0).alias("f"))
    return p.withColumn("egfr", cl.ckd_epi_2021(F.col("scr"), F.col("age"), F.col("f")))


@query(_EGFR + "SELECT c_custkey, round(egfr, 6) AS egfr FROM e")
def egfr_ckd_epi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _egfr(spark, sf_dir).select("c_custkey", F.round("egfr", 6).alias("egfr"))


@query(_EGFR + """SELECT c_custkey, CAST(w AS INTEGER) AS whole, CASE WHEN w >= 90 THEN 'G1' WHEN w >= 60 THEN 'G2' WHEN w >= 45 THEN 'G3a' WHEN w >= 30 THEN 'G3b' WHEN w >= 15 THEN 'G4' ELSE 'G5' END AS category FROM (SELECT c_custkey, floor(egfr + 0.5) AS w FROM e)""")
def egfr_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _egfr(spark, sf_dir).select("c_custkey", cl.whole(F.col("egfr")).alias("whole")).withColumn("category", cl.gfr_category(F.col("whole")))


@query("""
WITH p AS (SELECT c_custkey, (c_custkey * 7) % 1000 AS m, c_custkey % 2 = 0 AS f, c_custkey % 11 = 0 AND c_custkey % 2 = 0 AS preg FROM customer)
SELECT c_custkey, CASE WHEN preg THEN 105 WHEN m < 6 THEN NULL WHEN m < 24 THEN 105 WHEN m < 60 THEN 110 WHEN m // 12 < 12 THEN 115 WHEN m // 12 < 15 THEN 120 WHEN m // 12 <= 65 THEN CASE WHEN f THEN 120 ELSE 130 END END AS lowest,
  CASE WHEN preg THEN 3 WHEN m < 6 OR m // 12 > 65 THEN 0 ELSE 1 END AS n FROM p""")
def who_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haemoglobin cutoffs by an age in months, sex and pregnancy made from the customer key."""
    k = F.col("c_custkey")
    p = _t(spark, sf_dir, "customer").select("c_custkey", ((k * 7) % 1000).alias("m"), (k % 2 == 0).alias("f"), ((k % 11 == 0) & (k % 2 == 0)).alias("preg"))
    cut = cl.haemoglobin_cutoffs(F.col("m"), F.col("f"), F.col("preg"))
    return p.select("c_custkey", F.array_min(cut).alias("lowest"), F.when(cut.isNull(), 0).otherwise(F.size(cut)).alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN l_quantity >= 30 WHEN 1 THEN CASE WHEN l_quantity <= 30 THEN false END WHEN 2 THEN CASE WHEN l_quantity < 30 THEN false END ELSE CASE WHEN l_quantity >= 30 THEN true END END AS abnormal FROM lineitem""")
def censored_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with comparators against 30: true, false or not to be told."""
    c = F.element_at(F.array(*map(F.lit, ("", "<", "<=", ">", ">="))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cl.at_least(F.col("l_quantity"), c, 30).alias("abnormal"))


@query("""
SELECT r_name, n_name, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def code_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded rows with their dimensions; codes without rows stay."""
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("balance"))
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.join(s, "n_nationkey", "left").select("r_name", "n_name", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def coverage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a node: customers without an urgent order."""
    return _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(_t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
WITH a AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k, l_orderkey FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k, l_orderkey FROM lineitem WHERE l_linestatus = 'F')
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CAST(coalesce(a.k, b.k) AS INTEGER) AS k, a.l_orderkey AS left_value, b.l_orderkey AS right_value FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.k = b.k""")
def kth_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th open with the k-th filled line of each part; what is over stays alone."""
    lines, order = _t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    return core.kth_pairs(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), ["l_partkey"], order, order, "l_orderkey", "l_orderkey")


@query("""
WITH j AS (SELECT c_mktsegment, o_orderpriority, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT c_mktsegment, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY c_mktsegment, o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS r FROM j GROUP BY 1, 2, 3)
SELECT j.c_mktsegment, j.o_orderpriority, count(DISTINCT o_custkey) AS patients, count(*) AS records, any_value(m.o_orderstatus) AS label FROM j JOIN m ON j.c_mktsegment = m.c_mktsegment AND j.o_orderpriority = m.o_orderpriority AND r = 1 GROUP BY 1, 2""")
def concept_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers, records and the most frequent status of each concept."""
    keys = ["c_mktsegment", "o_orderpriority"]
    j = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    counts = j.groupBy(*keys).agg(F.count_distinct("o_custkey").alias("patients"), F.count(F.lit(1)).alias("records"))
    return counts.join(core.most_frequent(j, keys, "o_orderstatus").select(*keys, F.col("o_orderstatus").alias("label")), keys)


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("p"))


@query("""
WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, v[1] AS least, v[1 + round_even(0.05 * (n - 1), 0)::BIGINT] AS p5, v[1 + round_even(0.5 * (n - 1), 0)::BIGINT] AS median, v[1 + round_even(0.95 * (n - 1), 0)::BIGINT] AS p95, v[n] AS most FROM s""")
def nearest_rank_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.nearest_ranks(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"least": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "most": 1.0})


@query("SELECT l_partkey FROM lineitem WHERE l_quantity = 50 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem")
    return lines.where("l_quantity = 50").select("l_partkey").subtract(lines.where("l_quantity = 1").select("l_partkey"))


@query("""SELECT c_custkey, CASE WHEN ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 2))::INTEGER / 256 < 0.3 THEN 'test' ELSE 'dev' END AS split FROM customer""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", F.when(core.hash_share(F.col("c_custkey")) < 0.3, "test").otherwise("dev").alias("split"))


@query("""
SELECT c_mktsegment, c_custkey, CAST(place AS INTEGER) AS place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('s1|' || c_custkey), c_custkey) AS place FROM customer) WHERE place <= 5""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five customers of each segment in the order of a seeded hash."""
    return core.seeded_sample(_t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", "s1", 5)


@query("""SELECT o_custkey, sha256(string_agg(o_orderkey || ':' || o_orderstatus, chr(10) ORDER BY CAST(o_orderdate AS DATE), o_orderkey)) AS digest FROM orders GROUP BY 1""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    return core.ordered_digest(orders, ["o_custkey"], ["day", "o_orderkey"], F.concat_ws(":", "o_orderkey", "o_orderstatus"))


@query("""
SELECT source, sha256(text) AS note, min(doc_id) AS first_id, count(*) AS carriers FROM documents GROUP BY 1, 2""")
def note_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each source and text, with the first row that carries it."""
    docs = _t(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("note"), "doc_id")
    return docs.groupBy("source", "note").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("carriers"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM t""")
def tokens_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tx.words(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


_INDEX_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\pL\pN\p{{Co}}]+') AS w, text FROM documents WHERE doc_id IS NOT NULL),
asked_tokens AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(regexp_replace(translate(lower(text), '‘’“”–—−', '''''""---'), '([\pL\pN])[-+]', '\1 ', 'g'), '[-+]?[0-9]+(?:[.,][0-9]+)*|[\pL\pN]+')) AS token FROM t WHERE doc_id % 100 = 0),
asked_parts AS (SELECT query_id, token, w, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT *, regexp_extract_all(strip_accents(token), '[\pL\pN]+') AS w FROM asked_tokens WHERE regexp_full_match(regexp_replace(token, '[.-]', '', 'g'), '[\pL\pN]+'))),
every_word AS (SELECT DISTINCT unnest(w) AS word FROM t UNION SELECT word FROM asked_parts),
{stems.stem_sql("every_word")},
places AS (SELECT doc_id, dl, k, term FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM t) JOIN stems USING (word)),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
phrases AS (SELECT query_id, token, string_agg(term, ' ' ORDER BY k) AS phrase, count(*) AS m FROM asked_parts JOIN stems USING (word) GROUP BY 1, 2),
phrase_terms AS (SELECT phrase, m, unnest(string_split(phrase, ' ')) AS term, generate_subscripts(string_split(phrase, ' '), 1) AS j FROM (SELECT DISTINCT phrase, m FROM phrases)),
p AS (SELECT phrase, doc_id, dl, count(*) AS tf FROM (SELECT phrase, m, doc_id, dl, k - j AS start FROM phrase_terms JOIN places USING (term) GROUP BY phrase, m, doc_id, dl, start HAVING count(*) = m) GROUP BY 1, 2, 3),
d AS (SELECT phrase, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), {postings.LEAST_IDF}) AS idf FROM p, s GROUP BY phrase, n),
r AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM phrases JOIN p USING (phrase) JOIN d USING (phrase), s GROUP BY 1, 2)
"""


@query(_INDEX_SQL + "SELECT query_id, doc_id, floor(score * 10000 + 0.5) / 10000 AS score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents, by stems, for the words of every document whose id is divisible by 100."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    found = postings.search(postings.build(docs, "doc_id", "text"), docs.where("doc_id % 100 = 0"), "doc_id", "text", "id", limit=10)
    return found.select(F.col("doc_id").alias("query_id"), F.col("id").alias("doc_id"), (F.floor(F.col("score") * 10000 + 0.5) / 10000).alias("score"))


@query(_INDEX_SQL + """SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS places, CAST(max(tf) AS INTEGER) AS most FROM (SELECT term, doc_id, count(*) OVER (PARTITION BY term, doc_id) AS tf FROM places) GROUP BY term""")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the inverted index with their documents and places."""
    held = postings.build(_t(spark, sf_dir, "documents"), "doc_id", "text", keep=False).postings
    return held.groupBy("term").agg(F.sum(F.size("ids")).alias("documents"), F.sum("total").alias("places"), F.max("most").alias("most"))


@query("""
WITH r AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every vector whose id is divisible by 100."""
    e = _t(spark, sf_dir, "embeddings")
    return retrieval.dense_each(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "query_id", "embedding", limit=10)


@query("""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
r AS (SELECT 1 AS k, query_id, vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, q
  UNION ALL SELECT 2, query_id, vec_id, round(list_cosine_similarity(v.e, list_reverse(q.e)), 6) FROM v, q),
t AS (SELECT k, query_id, vec_id, row_number() OVER (PARTITION BY k, query_id ORDER BY score DESC, vec_id) AS rank FROM r QUALIFY rank <= 50),
f AS (SELECT query_id, vec_id, round(sum(1 / (60 + rank)), 9) AS score FROM t GROUP BY 1, 2)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100: its ranking and that of its mirror image, fused by reciprocal ranks."""
    e = _t(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    both = [retrieval.dense_each(e, "vec_id", "embedding", x, "query_id", "embedding", limit=50) for x in (q, q.withColumn("embedding", F.reverse("embedding")))]
    return retrieval.fused_each(both, "query_id", "vec_id", limit=10)


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of at most 200 words that each document's paragraphs are packed into."""
    return tx.passages(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page, with lines for blocks."""
    return _t(spark, sf_dir, "pages").select("page_id", tx.html_lines(F.col("html")).alias("text"))


@query(r"""
WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\pL\pN]+'), ' ') || ' ' AS t FROM documents),
b AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\pL\pN]+'), ' ') AS q FROM benchmark WHERE len(regexp_extract_all(text, '[\pL\pN]+')) > 0)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, ' ' || q || ' ')""")
def contiguous_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage stands word for word."""
    return tx.contiguous(_t(spark, sf_dir, "documents"), "doc_id", "text", _t(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""
SELECT CAST(date_diff('month', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INTEGER) AS months_apart, count(*) AS n, count(DISTINCT o_custkey) AS patients FROM orders
WHERE CAST(o_orderdate AS DATE) <= DATE '{AS_OF}' AND CAST(o_orderdate AS DATE) >= CAST(DATE '{AS_OF}' - INTERVAL 12 MONTH AS DATE) GROUP BY 1""")
def monthly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the twelve months up to a day, by calendar month."""
    day, as_of = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    rows = _t(spark, sf_dir, "orders").where((day <= as_of) & (day >= cl.months_before(as_of, 12)))
    apart = ((F.year(as_of) - F.year(day)) * 12 + F.month(as_of) - F.month(day)).cast("int")
    return rows.groupBy(apart.alias("months_apart")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("patients"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def cache_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no earlier result covers."""
    return store.todo(_t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256")), _t(spark, sf_dir, "labels"), ["doc_id"])


@query(r"""
WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\pL\pN]+')) AS w FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS similarity
FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words of each turn and the one that answers it."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(retrieval.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '1998-09-02' GROUP BY 1, 2""")
def cohort_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional totals over one pass (the cohort build totals)."""
    rows = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1998-09-03").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.user_id, a.event_type AS left_type, b.event_type AS right_type, a.event_id AS left_id, b.event_id AS right_id
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('purchase', 'view')) a
JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') b ON a.user_id = b.user_id WHERE a.r = 1 AND b.r = 1""")
def co_active_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each latest purchase or view of a user with the user's latest error (the drug-pair note)."""
    e = _t(spark, sf_dir, "events")
    a = core.latest_by(e.where("event_type in ('purchase', 'view')"), ["user_id", "event_type"], ["ts", "event_id"], "event_id").select("user_id", F.col("event_type").alias("left_type"), F.col("event_id").alias("left_id"))
    b = core.latest_by(e.where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], "event_id", "event_type").select("user_id", F.col("event_type").alias("right_type"), F.col("event_id").alias("right_id"))
    return a.join(b, "user_id")
