"""Evidence packs: what a flag rests on, as numbered items, and the review of sentences that cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.operators import sentences

ITEM = ("patient", "rule", "id", "kind", "text", "ref")


def _numbered(rows: DataFrame, letter: str, kind: str, items: str, text: Column, ref: Column) -> DataFrame:
    each = rows.select("patient", "rule", F.posexplode(items).alias("pos", "x"))
    return each.select("patient", "rule", F.concat(F.lit(letter), (F.col("pos") + 1).cast("string")).alias("id"), F.lit(kind).alias("kind"), text.alias("text"), ref.alias("ref"))


def pack(flags: DataFrame) -> DataFrame:
    """Items of every flag: F, then E (evidence), L (limitations), S (statements) and P (passages), numbered from 1.

    `flags` has patient, rule, title, statement, evidence array<struct<date,label,value,note,node>>,
    limitations array<string>, statements array<struct<id,citation,quote>> and passages
    array<struct<id,title,place,text>>.
    """
    x = lambda f: F.col(f"x.{f}")
    none = F.lit(None).cast("string")
    fact = F.concat(x("date").cast("string"), F.lit(": "), x("label"), F.coalesce(F.concat(F.lit(": "), x("value")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), x("note"), F.lit(")")), F.lit("")))
    parts = [
        flags.select("patient", "rule", F.lit("F").alias("id"), F.lit("flag").alias("kind"), F.concat("title", F.lit(". "), "statement").alias("text"), none.alias("ref")),
        _numbered(flags, "E", "evidence", "evidence", fact, x("node")),
        _numbered(flags, "L", "limitation", "limitations", F.col("x"), none),
        _numbered(flags, "S", "statement", "statements", F.concat(x("citation"), F.lit(': "'), x("quote"), F.lit('"')), x("id")),
        _numbered(flags, "P", "passage", "passages", F.concat(x("title"), F.lit(", "), x("place"), F.lit(": "), x("text")), x("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flag_hash(columns: list[str]) -> Column:
    """What a kept explanation is tied to: a digest of the flag's fields."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def reviewed(written: DataFrame, items: DataFrame, *, least: int = 2) -> DataFrame:
    """For each flag: the sentences kept, those dropped, and whether the text is used or the template.

    A sentence (patient, rule, n, text, cites and, if there is one, language) is kept when it passes
    every check of `sentences.checked`. The text is used with `least` kept, one of which cites the
    flag or its evidence.
    """
    of = F.struct("patient", "rule").alias("pack")
    language = F.col("language") if "language" in written.columns else F.lit("en")
    asked = written.select(of, F.col("n").alias("sentence"), "text", "cites", language.alias("language"))
    known = items.select(of, F.col("id").alias("item"), "kind", "text", F.lit(None).cast("date").alias("day"))
    own = F.exists("cites", lambda c: c.startswith("F") | c.startswith("E"))
    found = sentences.checked(asked, known).join(asked.select("pack", "sentence", own.alias("own")), ["pack", "sentence"]).withColumn("kept", F.size("problems") == 0)
    counts = found.groupBy("pack").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"), F.max(F.col("kept") & F.col("own")).alias("own"))
    return counts.select("pack.patient", "pack.rule", "n_kept", "n_dropped", ((F.col("n_kept") >= least) & F.coalesce("own", F.lit(False))).alias("used"))


def knowledge_links(drugs: DataFrame, labels: DataFrame, conditions: DataFrame, statements: DataFrame) -> DataFrame:
    """(concept, to, kind): drugs to their chosen label, conditions to the statements that guide them."""
    labelled = drugs.join(labels, "rxcui").select(F.concat(F.lit("medication_request|"), "rxcui").alias("concept"), F.concat(F.lit("label:"), "set_id", F.lit("@v"), F.col("version").cast("string")).alias("to"), F.lit("labelled_by").alias("kind"))
    guided = conditions.join(statements, "code").select(F.concat(F.lit("condition|"), "code").alias("concept"), F.concat(F.lit("statement:"), "statement_id").alias("to"), F.lit("guided_by").alias("kind"))
    return labelled.unionByName(guided).distinct()
