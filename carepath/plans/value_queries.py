"""Queries for written values, choices, scores and checks on the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions import clinical as cl
from carepath.functions import labs, times
from carepath.functions import text as tx
from carepath.operators import core, evaluation, quotes
from carepath.plans.table_queries import AS_OF, _t, query
from carepath.sources import store


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS v, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN w WHEN 4 THEN CASE WHEN w < 1000 THEN w END WHEN 5 THEN w WHEN 6 THEN NULL ELSE v END AS number,
  CASE l_linenumber WHEN 3 THEN '<=' END AS comparator FROM t""")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in English, in Italian, with a comparator, with one mark that may group (refused unless the mark in use is known), and as words."""
    n, v = F.col("l_linenumber"), F.col("l_extendedprice")
    w = F.floor(v).cast("long")
    english = F.format_number(F.round(v, 2), 2)
    text = (
        F.when(n == 1, english).when(n == 2, F.translate(english, ",.", ".,")).when(n == 3, F.concat(F.lit("≤ "), w.cast("string"))).when(n == 4, F.translate(F.format_number(w, 0), ",", "."))
        .when(n == 5, F.translate(F.format_number(w, 0), ",", ".")).when(n == 6, "negative").otherwise(F.concat(F.lit("+"), F.format_string("%.2f", F.round(v, 2))))
    )
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), F.when(n == 5, ",").alias("mark"))
    return rows.select("l_orderkey", "l_linenumber", labs.number(F.col("text"), F.col("mark")).cast("double").alias("number"), labs.comparator(F.col("text")).alias("comparator"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN CASE WHEN day(d) > 12 OR day(d) = month(d) THEN d END WHEN 4 THEN NULL ELSE d END AS day FROM o""")
def report_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as reports print them; a numeric one that could be read in two ways is refused."""
    k, d = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    italian = F.element_at(F.array(*[F.lit(m[-2]) for m in times.MONTHS]), F.month(d))
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.concat_ws(" ", F.dayofmonth(d), italian, F.year(d))).when(k == 3, F.date_format(d, "MMMM d, yyyy")).otherwise("31/02/2020")
    return _t(spark, sf_dir, "orders").select("o_orderkey", times.report_date(text).alias("day"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', d)::DATE WHEN 1 THEN date_trunc('month', d)::DATE WHEN 2 THEN d END AS day, CASE o_orderkey % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' END AS precision FROM o""")
def timepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates at three precisions, and a time without an offset, which is refused."""
    k, d = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd'T'10:00:00"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", times.timepoint(text).alias("t")).select("o_orderkey", F.col("t.date").alias("day"), "t.precision")


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '{AS_OF}' AS a FROM orders)
SELECT o_orderkey, CAST((year(a) - year(d)) * 12 + month(a) - month(d) - CASE WHEN day(a) < day(d) THEN 1 ELSE 0 END AS INTEGER) AS months,
  CAST(floor(((year(a) - year(d)) * 12 + month(a) - month(d) - CASE WHEN day(a) < day(d) THEN 1 ELSE 0 END) / 12) AS INTEGER) AS years FROM o""")
def completed_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, a = F.to_date("o_orderdate"), F.lit(AS_OF).cast("date")
    return _t(spark, sf_dir, "orders").select("o_orderkey", cl.completed_months(d, a).cast("int").alias("months"), cl.completed_years(d, a).alias("years"))


@query("""
WITH t AS (SELECT p_size, p_partkey, p_retailprice, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS tier FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY tier, p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_size, tier) AS candidates FROM t)
SELECT p_size AS rxcui, p_partkey AS set_id, tier, candidates FROM r WHERE r = 1""")
def label_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part of each size as the label lock chooses: best tier, newest, then lower id."""
    k = F.col("p_partkey")
    kind = F.when(k % 7 == 0, "C73594").when(k % 7 == 1, "C73605").otherwise("none")
    rows = _t(spark, sf_dir, "part").select(F.col("p_size").alias("rxcui"), kind.alias("type"), F.col("p_retailprice").alias("published"), F.lit(1).alias("version"), k.alias("set_id"))
    return evaluation.label_choice(rows).select("rxcui", "set_id", "tier", "candidates")


@query("""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3""")
def newest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.newest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("""
WITH a AS (SELECT l_shipdate, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k, l_quantity FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS k, l_quantity FROM lineitem WHERE l_linestatus = 'F'),
j AS (SELECT coalesce(a.l_partkey, b.l_partkey) % 10 AS family, a.l_quantity AS t, b.l_quantity AS p FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.k = b.k)
SELECT family, count(t) AS n_truth, count(p) AS n_predicted, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) AS n_paired, count(*) FILTER (t = p) AS n_exact,
  round(count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) / count(t), 9) AS recall, round(count(*) FILTER (t IS NOT NULL AND p IS NOT NULL) / count(p), 9) AS precision, round(count(*) FILTER (t = p) / count(*) FILTER (t IS NOT NULL AND p IS NOT NULL), 9) AS exact FROM j GROUP BY 1""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and exact values of filled against open lines, by family of parts."""
    lines, order = _t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    pairs = core.kth_pairs(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), ["l_partkey"], order, order, "l_quantity", "l_quantity")
    out = evaluation.scores(pairs.select((F.col("l_partkey") % 10).alias("family"), F.col("left_value").alias("truth_value"), F.col("right_value").alias("predicted_value")), ("family",))
    return out.select("family", "n_truth", "n_predicted", "n_paired", "n_exact", *[F.round(c, 9).alias(c) for c in ("recall", "precision", "exact")])


@query("""
WITH o AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS body FROM documents),
n AS (SELECT doc_id, source, sha256(translate(coalesce(text, ''), '#*$%&|<>', '')) AS body FROM documents)
SELECT 'keep' AS what, o.doc_id FROM o JOIN n ON o.doc_id = n.doc_id AND o.body = n.body
UNION ALL SELECT 'drop', o.doc_id FROM o LEFT JOIN n ON o.doc_id = n.doc_id AND o.body = n.body WHERE n.doc_id IS NULL
UNION ALL SELECT 'insert', n.doc_id FROM n LEFT JOIN o ON o.doc_id = n.doc_id AND o.body = n.body WHERE o.doc_id IS NULL""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental merge of the documents with a version without markup symbols keeps, drops and inserts."""
    text = F.coalesce("text", F.lit(""))
    d = _t(spark, sf_dir, "documents")
    old, new = (d.select("doc_id", "source", F.sha2(t, 256).alias("body")) for t in (text, F.translate(text, "#*$%&|<>", "")))
    plan = store.merge_plan(old, new, "doc_id", ["source", "body"])
    parts = [plan[k].select(F.lit(k).alias("what"), "doc_id") for k in ("keep", "drop", "insert")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH s AS (SELECT o_custkey, count(*) AS n, date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS span FROM orders GROUP BY 1)
SELECT count(*) AS patients, count(*) FILTER (n >= 2) AS two_or_more, count(*) FILTER (n >= 2 AND span >= 90) AS spanning FROM s""")
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with two orders or more, and those whose orders span 90 days."""
    d = F.to_date("o_orderdate")
    s = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.date_diff(F.max(d), F.min(d)).alias("span"))
    return s.agg(F.count(F.lit(1)).alias("patients"), F.count_if(F.col("n") >= 2).alias("two_or_more"), F.count_if((F.col("n") >= 2) & (F.col("span") >= 90)).alias("spanning"))


@query("""
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)""")
def flag_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts left after those with returned large lines are suppressed (the unread guard's anti-join)."""
    seen = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name").join(seen, "p_partkey", "left_anti")


@query("""
WITH l AS (SELECT o_custkey AS patient, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT p_brand AS a, n_name AS b, count(DISTINCT patient) AS patients, count(*) AS edges FROM l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def concept_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between concepts of a cohort: distinct patients and edges."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient")), "l_orderkey")
    nodes = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("b"))
    named = lines.join(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("a")), "l_partkey").join(nodes, "l_suppkey")
    return named.groupBy("a", "b").agg(F.count_distinct("patient").alias("patients"), F.count(F.lit(1)).alias("edges"))


@query("""
WITH u AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS asked, max(turn) AS last_turn FROM conversations GROUP BY 1)
SELECT turns, count(*) AS conversations, CAST(sum(asked) AS BIGINT) AS asked, max(last_turn) AS last_turn FROM u GROUP BY 1""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by their number of turns."""
    u = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"))
    return u.groupBy("turns").agg(F.count(F.lit(1)).alias("conversations"), F.sum("asked").alias("asked"), F.max("last_turn").alias("last_turn"))


# ---- more of the generic operators


@query("""
WITH r AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, max(l_quantity) FILTER (k = CAST(floor(0.25 * (n - 1)) AS BIGINT)) AS lower, max(l_quantity) FILTER (k = CAST(floor(0.5 * (n - 1)) AS BIGINT)) AS middle, max(l_quantity) FILTER (k = CAST(floor(0.75 * (n - 1)) AS BIGINT)) AS upper FROM r GROUP BY 1""")
def floor_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles at the floor of their rank."""
    return core.floor_ranks(_t(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", {"lower": 0.25, "middle": 0.5, "upper": 0.75})


@query("""
SELECT o_orderstatus, CAST(sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderpriority), 1, 12))::BIGINT) AS DECIMAL(38, 0)) AS digest, count(*) AS n FROM orders GROUP BY 1""")
def order_free_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each group that doesn't depend on the order of its rows."""
    return core.unordered_digest(_t(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("""
SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) = 1""")
def first_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, day and type wins."""
    return core.first_by(_t(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day", "event_type"], ["ts", "event_id"], "event_id", "value")


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day FROM events),
g AS (SELECT user_id, day, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 30 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT * FROM e))
SELECT user_id, max(day) FILTER (fresh = 1) AS since, max(day) AS last_day FROM g GROUP BY 1""")
def episode_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the current episode of each user begins: no gap of more than 30 days since."""
    return core.episode_start(_t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")), ["user_id"], "day", gap=30)


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS what
FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 49) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 25) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two sets of keys don't share: expected ones missing and extra ones (the edge check)."""
    a = _t(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    b = _t(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").cast("long").alias("k"))
    return core.set_differences(a, b, ["k"])


@query("""
WITH a AS (SELECT l_orderkey AS k, CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS w FROM orders)
SELECT a.k, a.day, round(v - w, 2) AS difference FROM a JOIN b ON a.k = b.k AND a.day = b.day""")
def same_day_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values computed and reported for one subject on one day, and how they differ."""
    a = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    b = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("w"))
    return a.join(b, ["k", "day"]).select("k", "day", F.round(F.col("v") - F.col("w"), 2).alias("difference"))


@query("""
SELECT CASE WHEN years < 18 THEN '0-17' WHEN years >= 90 THEN '90+' ELSE CAST(floor((years - 18) / 12) * 12 + 18 AS INTEGER) || '-' || CAST(floor((years - 18) / 12) * 12 + 29 AS INTEGER) END AS band, count(*) AS n
FROM (SELECT date_diff('year', CAST(o_orderdate AS DATE), DATE '2040-01-01') * 3 AS years FROM orders) GROUP BY 1""")
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by bands of a whole number of years."""
    years = (F.lit(2040) - F.year("o_orderdate")) * 3
    return _t(spark, sf_dir, "orders").groupBy(cl.age_band(years).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') WHEN 1 THEN strftime(CAST(o_orderdate AS DATE), '%m/%Y') ELSE strftime(CAST(o_orderdate AS DATE), '%Y') END AS shown FROM orders""")
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates shown as precisely as they are known."""
    k = F.col("o_orderkey") % 3
    precision = F.when(k == 0, "day").when(k == 1, "month").otherwise("year")
    return _t(spark, sf_dir, "orders").select("o_orderkey", times.shown(F.to_date("o_orderdate"), precision).alias("shown"))


@query("""
SELECT e.user_id, count(*) AS events FROM events e WHERE e.user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""")
def earlier_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of those subjects whom no earlier cohort holds."""
    earlier = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("user_id"))
    return _t(spark, sf_dir, "events").join(earlier, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))


@query("""
SELECT p_brand, rule, count(*) FILTER (status = 'met') AS met, count(*) FILTER (status = 'not_met') AS not_met, count(*) FILTER (status = 'not_assessable') AS not_assessable FROM (
SELECT p_brand, 'size' AS rule, CASE WHEN p_size > 25 THEN 'met' ELSE 'not_met' END AS status FROM part UNION ALL
SELECT p_brand, 'price', CASE WHEN p_size < 5 THEN 'not_assessable' WHEN p_retailprice > 1200 THEN 'met' ELSE 'not_met' END FROM part) GROUP BY 1, 2""")
def rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule was met, not met and not assessable."""
    p = _t(spark, sf_dir, "part")
    size = p.select("p_brand", F.lit("size").alias("rule"), F.when(F.col("p_size") > 25, "met").otherwise("not_met").alias("status"))
    price = p.select("p_brand", F.lit("price").alias("rule"), F.when(F.col("p_size") < 5, "not_assessable").when(F.col("p_retailprice") > 1200, "met").otherwise("not_met").alias("status"))
    return evaluation.rule_totals(size.unionByName(price), ("p_brand", "rule"))


@query(r"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM conversations),
u AS (SELECT conv_id, turn, k, ws[k] AS word FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
s AS (SELECT conv_id, turn, word, lead(word) OVER x AS next, lead(turn) OVER x AS last FROM u WINDOW x AS (PARTITION BY conv_id ORDER BY turn, k)),
q AS (SELECT conv_id, turn, ws[1] AS a, ws[2] AS b FROM w WHERE len(ws) >= 2)
SELECT q.conv_id, q.turn, count(*) AS places, min(s.turn) AS first_turn, max(s.last) AS last_turn FROM q JOIN s ON q.conv_id = s.conv_id AND word = a AND next = b GROUP BY 1, 2""")
def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first two words of each turn stand in its conversation, across turns as well."""
    c = _t(spark, sf_dir, "conversations")
    pages = c.select(F.col("conv_id").alias("document"), F.col("turn").alias("number"), F.col("turn").cast("string").alias("label"), "text")
    asked = c.withColumn("ws", tx.words(F.col("text"))).where("size(ws) >= 2").select(F.struct("conv_id", "turn").alias("quote_id"), F.col("conv_id").alias("document"), F.array_join(F.slice("ws", 1, 2), " ").alias("quote"))
    found = quotes.places(asked, pages, cut=tx.words).where("size(hits) > 0")
    first, last = F.transform("hits", lambda h: h["first"]["number"]), F.transform("hits", lambda h: h["last"]["number"])
    return found.select("quote_id.conv_id", "quote_id.turn", F.size("hits").cast("long").alias("places"), F.array_min(first).alias("first_turn"), F.array_max(last).alias("last_turn"))
