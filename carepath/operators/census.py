"""A census of statements: sentences of given kinds, their number and the labels that hold them.

A kind is a list of groups of phrases; a sentence is of the kind if it holds a phrase of every group,
within a number of words of one another if a limit is set. Each group, or with a limit each kind, is
one alternation, so a sentence is read once for each of them, in the JVM. Patterns are slow, so a
sentence is first looked through for the plain words that their alternatives begin with.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Phrases(NamedTuple):
    """Alternatives, as patterns; `any_case` reads them in either case."""

    forms: tuple[str, ...]
    any_case: bool = True

    def pattern(self) -> str:
        bounded = [f[2:] for f in self.forms if f.startswith(r"\b") and "|" not in f]  # their bound is looked for once
        rest = [f for f in self.forms if not f.startswith(r"\b") or "|" in f]
        return f"(?{'iu' if self.any_case else ''}U:{'|'.join(rest + ([rf'\b(?:{"|".join(bounded)})'] if bounded else []))})"

    def openings(self) -> list[str] | None:
        """Plain text that each alternative begins with; None if one has none."""
        found = [_opening(f) for f in self.forms]
        return None if not all(found) or (self.any_case and not all(f.isascii() for f in found)) else found


def _opening(form: str) -> str:
    plain = re.match(r"(?:\\b)?((?:[^\W_]|[ <>≤≥])*)", form)
    some = plain[1][:-1] if form[plain.end() :][:1] in ("?", "*", "{") else plain[1]
    return "" if "|" in form else some


class Kind(NamedTuple):
    """A kind of statement: a phrase of every group, with `within` other words between two of them at most (None: anywhere)."""

    name: str
    groups: tuple[Phrases, ...]
    within: int | None = None


# What the kinds of a label's statements are told by, and the sections that are not read.
_NUMBER = Phrases((r"<\s*\d+", r">\s*\d+", r"≤\s*\d+", r"≥\s*\d+", *(rf"\b{w}\b\s*\d+" for w in ("below", "less than", "greater than", "between", "under", "at least"))), any_case=False)
_EGFR = Phrases((r"\beGFR\b",), any_case=False)
_CLEARANCE = Phrases(("creatinine clearance", r"\bCrCl\b", r"\bCLcr\b"))
_DO = Phrases(tuple(rf"\b{w}" for w in ("monitor", "measure", "assess", "check", "obtain", "evaluate", "determine")))
_LAB = Phrases(("hemoglobin", "haemoglobin", r"\beGFR\b", "renal function", "kidney function", "serum creatinine"))
_WHEN = Phrases(tuple(rf"\b{w}\b" for w in ("every", "at least", "weekly", "monthly", "annually", "yearly", "periodically", "before initiat", "prior to initiat", "regularly", "months")))
LABEL_KINDS = (Kind("eGFR threshold", (_EGFR, _NUMBER)), Kind("creatinine-clearance threshold", (_CLEARANCE, _NUMBER)), Kind("lab monitoring with a time word", (_DO, _LAB, _WHEN)))
SKIPPED = ("34069-5", "34089-3", "34092-7", "34084-4", "43682-4", "43681-6", "43679-0", "34083-6")
SENTENCE_BOUND = r"(?U)(?<=[.;])\s+(?=[A-Z•(\[])|\n"


def lowered(sentence: Column) -> Column:
    """An ASCII sentence in lower case; null for others, in which letters such as the long s match plain ones."""
    return F.when(F.octet_length(sentence) == F.length(sentence), F.lower(sentence))


def _may_hold(sentence: Column, low: Column, group: Phrases) -> Column:
    """Whether plain text of a group is there; without it none of its phrases is."""
    if (openings := group.openings()) is None:
        return F.lit(True)
    if group.any_case:
        return reduce(lambda a, x: a | F.contains(low, F.lit(x.lower())), openings, low.isNull())
    return reduce(lambda a, b: a | b, [F.contains(sentence, F.lit(x)) for x in openings])


def holds(sentence: Column, kind: Kind, low: Column | None = None) -> Column:
    """Whether a sentence is of a kind; `low` is the sentence as `lowered` gives it. With a limit the phrases must not overlap."""
    low = lowered(sentence) if low is None else low
    found = reduce(lambda a, b: a & b, [_may_hold(sentence, low, group) for group in kind.groups], F.lit(True))
    if kind.within is None:
        for group in kind.groups:
            found = found & sentence.rlike(group.pattern())
        return found
    gap = rf"(?U:\w*\W+(?:\w+\W+){{0,{kind.within}}}?)"
    return found & sentence.rlike("|".join(gap.join(g.pattern() for g in order) for order in permutations(kind.groups)))


def statements(sections: DataFrame, *, kinds: Sequence[Kind] = LABEL_KINDS, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """label, code, sentence and kind of every sentence of a kind in `sections` (label, code, text), the first that fits.

    Sections with a skipped code are not read; those without a code are. A null text has no sentence.
    """
    read = sections.where(F.col("code").isNull() | ~F.col("code").isin(*skipped)) if skipped else sections
    kind = lambda x: F.coalesce(F.lit(None).cast("string"), *[F.when(holds(x["sentence"], k, x["low"]), k.name) for k in kinds])
    cut = F.transform(F.split("text", SENTENCE_BOUND), lambda s: F.struct(s.alias("sentence"), lowered(s).alias("low")))
    told = F.transform(cut, lambda x: F.struct(x["sentence"].alias("sentence"), kind(x).alias("kind")))
    return read.select("label", "code", F.inline(told)).where("kind is not null")  # a kind is told once, where sentences are cut


def census(sections: DataFrame, *, kinds: Sequence[Kind] = LABEL_KINDS, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """kind, sentences and labels (different ones; null is none) of every kind, also of those that no sentence is of."""
    found = statements(sections, kinds=kinds, skipped=skipped)
    of_label = found.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    counts = of_label.groupBy("kind").agg(F.sum("n").alias("n"), F.count("label").alias("m"))
    every = sections.sparkSession.createDataFrame([(k.name,) for k in kinds], "kind string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return every.join(counts, "kind", "left").select("kind", zero("n").alias("sentences"), zero("m").alias("labels"))
