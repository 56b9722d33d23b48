"""Checks of written sentences against the items they cite.

Every sentence and every item is read once into typed values: numbers with what they may mean in
their language, days, months, categories and sources. What remains is set arithmetic on columns:
a sentence's values are met with those of the items it cites, found by a join.

Wording is told by rules over words: a rule is a row of slots, each a set of words or phrases, an
optional one, or a few free words; all rules are walked along the words of a sentence.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from decimal import Decimal
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that the checks know, in English and Italian.
_MONTHS_EN = "january february march april may june july august september october november december".split()
_MONTHS_IT = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
MONTHS = {name: k for names in (_MONTHS_EN, _MONTHS_IT, [m[:3] for m in _MONTHS_EN]) for k, name in enumerate(names, 1)} | {"sept": 9}
NEGATIONS = set("no not never without none nor non nessuno nessuna nessun mai senza né".split())
CONDITIONS_EN = (
    "chronic kidney disease", "ckd", "kidney disease", "kidney failure", "renal disease", "renal failure", "renal insufficiency", "renal impairment", "anaemia", "anemia", "anaemic", "anemic",
)
CONDITIONS_IT = ("malattia renale cronica", "mrc", "insufficienza renale", "nefropatia", "malattia renale", "anemia", "anemico", "anemica")
SEVERITY = {"mild": "mild", "mildly": "mild", "moderate": "moderate", "moderately": "moderate", "severe": "severe", "severely": "severe"}
SEVERITY_IT = {"lieve": "mild", "moderata": "moderate", "grave": "severe", "severa": "severe"}
RISKS = {"very high": "very high", "high": "high", "moderately increased": "moderately increased"}
RISKS_IT = {"molto alto": "very high", "molto elevato": "very high", "alto": "high", "elevato": "high", "moderatamente aumentato": "moderately increased"}
NOT_GRADED = ("diagnos*", "code", "condition", "is recorded", "was recorded", "registrat*", "codificat*")
ACTIONS_EN = tuple("stop start take discontinue increase reduce lower raise switch avoid change".split())
ACTIONS_IT = tuple("smettere sospendere interrompere iniziare cominciare prendere assumere aumentare ridurre cambiare evitare".split())
ORDERS_EN = ("stop", "start", "take", "discontinue", "switch", "avoid", "do not take", "don' t take", "continue taking")
ORDERS_IT = (
    *"smetta smetti sospenda sospendi interrompa interrompi inizi inizia prenda prendi".split(), "non prenda", "non prendere", *"aumenti aumenta riduca riduci cambi cambia eviti evita".split(),
)
DONE_EN = tuple("stopped started discontinued increased reduced switched changed avoided".split())
DONE_IT = tuple("sospes* interrott* iniziat* ridott* aumentat* evitat*".split())
ATTRIBUTIONS = (
    "say", "says", "said", "state", "states", "recommend", "recommends", "advise", "advises", "according to", "per the", "indicate", "indicates", "label", "guideline",
    "secondo", "indica", "raccomanda", "afferma", "dice", "riporta", "consiglia", "etichetta", "foglietto", "linea guida", "linee guida",
)
DOCTORS = set("doctor doctors physician physicians medico medici medica".split())
COMMON_EN = set("the and is are of with to for this that was were not be your you an it its has have from or by on at which".split())
COMMON_IT = set("il lo la le gli di che è e con per non del della dei delle nel nella un una sono questo questa lei suo sua al alla da ha hanno come più".split())
#: Ways to write a source that sentences may name; "who" in small letters is the pronoun.
SOURCES = {"WHO": ("who", "oms", "world health organization", "world health organisation", "organizzazione mondiale della sanità"), "KDIGO": ("kdigo",)}
BEFORE_AN_ID = (
    "item", "items", "passage", "passages", "source", "sources", "limitation", "limitations", "statement", "statements", "evidence", "flag", "guidance in",
    "elemento", "elementi", "fonte", "fonti", "documento", "limite", "limiti",
)
POINTERS_IN = "stated noted shown indicated described listed specified reported mentioned cited explained given outlined detailed".split() + ["set out"]
POINTERS_IT = "indicat specificat descritt riportat mostrat avvertit menzionat citat segnalat spiegat".split()
POINTS_TO_F = set("in see from by item items source da dal dalla nel nella vedi elemento fonte documento".split())

# ---- references to items

_WORDED = rf"(?:(?i:(?:the )?(?:{'|'.join(BEFORE_AN_ID)})) )?[FELSP]\d*"
_LIST = rf"{_WORDED}(?: ?(?:[,;]|(?i:\band\b|\be\b)) ?{_WORDED})*"
_BRACKETED = re.compile(rf"\[ ?[A-Z]\d*(?: ?[,;] ?[A-Z]\d*)* ?\]|\( ?{_LIST} ?\)")
_POINTING = "|".join([
    rf"(?:as )?(?:{'|'.join(POINTERS_IN)}) in", "according to", "per", "see", rf"(?:come )?(?:{'|'.join(POINTERS_IT)})[oaie] (?:in|da)",
    "secondo quanto (?:indicato|specificato|riportato) (?:in|da)", "secondo",
])
_TAIL = re.compile(rf"(?<=[\w)\]])(?:[,;] ?\(?| ?\()(?i:\b(?:{_POINTING})) {_LIST}\)?(?= ?[.;:,]| ?$)")


def without_refs(text: str) -> str:
    """A sentence in single blanks without bracketed item ids and without tails that only point at items."""
    text = " ".join(text.split())
    text = _TAIL.sub("", " ".join(_BRACKETED.sub(" ", text).split()))
    return re.sub(r" +([.,;:!?])", r"\1", " ".join(text.split()))


# ---- numbers and days

_PIECE = re.compile(r"\d+(?:[./,-]\d+)*|[^\W\d_]+|[^\s\w]|_")
_ISO, _DMY, _YEAR, _ONE_OR_TWO = (re.compile(x) for x in (r"\d{4}-\d\d-\d\d", r"\d{1,2}[./]\d{1,2}[./]\d{4}", r"\d{4}", r"\d{1,2}"))


def readings(number: str, language: str) -> set[str]:
    """What a written number may mean, in plain decimal form; a code such as 2.1.1 stays as it is."""
    sign, digits = ("-", number[1:]) if number[0] in "-\u2212" else ("", number)
    first, *groups = re.split("[.,]", digits)
    thousands = bool(groups) and len(first) <= 3 and all(len(g) == 3 for g in groups)
    if len(groups) > 1 and not thousands:
        return {number.replace("\u2212", "-")}
    forms = {digits.replace(",", "." if language == "it" else "")}
    if thousands:
        forms.add(first + "".join(groups))
    return {format(Decimal(sign + f).normalize(), "f") if f.count(".") < 2 else sign + f for f in forms}


def _day(y: str, m: int | str, d: str) -> str | None:
    try:
        return dt.date(int(y), int(m), int(d)).isoformat()
    except ValueError:
        return None


def values(text: str, language: str) -> tuple[list[list[str]], list[str], list[str]]:
    """The readings of every number of a text, its days, and its months (of days that are not written)."""
    pieces = [(m.group(), m.start(), m.end()) for m in _PIECE.finditer(text)]
    words = [p.lower() for p, _, _ in pieces]
    used, days, months = set(), set(), set()

    def year(k: int) -> bool:
        return k < len(words) and _YEAR.fullmatch(words[k]) is not None

    def after(k: int, *skipped: str) -> int:
        """The place of the next piece that is none of the skipped ones."""
        return k + 1 if k < len(words) and words[k] in skipped else k

    for k, w in enumerate(words):
        if w not in MONTHS and not w[0].isdigit():
            continue
        if _ISO.fullmatch(w):
            used.add(k)
            days.add(_day(*w.split("-")))
        elif _DMY.fullmatch(w):  # day first, in English as well month first
            used.add(k)
            parts = re.split("[./]", w)
            days.add(_day(parts[2], parts[1], parts[0]))
            if language == "en":
                days.add(_day(parts[2], parts[0], parts[1]))
        elif w in MONTHS and k not in used:
            ordinals = ("st", "nd", "rd", "th")
            end = after(k + 1, ".")
            before = k - 1 - (k > 0 and words[k - 1] in (*ordinals, "°", "º"))
            late = after(end, ",")
            if before >= 0 and _ONE_OR_TWO.fullmatch(words[before]) and before not in used and year(late):
                used |= {before, late}
                days.add(_day(words[late], MONTHS[w], words[before]))
            elif end < len(words) and _ONE_OR_TWO.fullmatch(words[end]) and year(late := after(after(end + 1, *ordinals), ",")):
                used |= {end, late}
                days.add(_day(words[late], MONTHS[w], words[end]))
            elif year(late := after(end, "of", "del", "di")):
                used.add(late)
                months.add(f"{words[late]}-{MONTHS[w]:02}")
    numbers = []
    for k, (piece, start, _) in enumerate(pieces):
        if not piece[0].isdigit() or k in used:
            continue
        minus = start and text[start - 1] in "-\u2212" and (start < 2 or not re.match(r"[\w.,]", text[start - 2]))
        if start and not minus and re.match(r"[\w.,]", text[start - 1]):
            continue
        for n, part in enumerate(re.split("[/-]", piece)):
            numbers.append(sorted(readings(("-" if minus and n == 0 else "") + part, language)))
    return numbers, sorted(d for d in days if d), sorted(months)


# ---- rules over words

_WORD = re.compile(r"[^\W_]+['\u2019]?|[.,;:!?()\"]")


def words_of(text: str) -> list[str]:
    return [w.replace("\u2019", "'") for w in _WORD.findall(text.lower())]


@cache
def _parts(phrases: tuple[str, ...]) -> dict[str, list[list[str]]]:
    """The words of phrases, by their first letter."""
    out: dict[str, list[list[str]]] = {}
    for p in phrases:
        out.setdefault(p[0], []).append(p.split(" "))
    return out


def _phrase(words: list[str], at: int, phrases: tuple[str, ...]) -> list[int]:
    """The ends of all phrases that begin at a place; a star stands for any ending."""
    if at >= len(words):
        return []
    some = _parts(phrases).get(words[at][0], ())
    return [at + len(p) for p in some if at + len(p) <= len(words) and all(w.startswith(x[:-1]) if x.endswith("*") else w == x for w, x in zip(words[at:], p))]


def _walk(words: list[str], at: int, rule: tuple) -> int | None:
    """The end of a rule that holds from a place. Slots: phrases; ("maybe", phrases); ("free", most words)."""
    if not rule:
        return at
    slot, rest = rule[0], rule[1:]
    if slot[0] == "free":
        for n in range(slot[1] + 1):
            if n and (at + n > len(words) or not words[at + n - 1][0].isalnum()):
                return None
            if (end := _walk(words, at + n, rest)) is not None:
                return end
        return None
    if slot[0] == "maybe":
        ends = [*_phrase(words, at, slot[1]), at]
    else:
        ends = _phrase(words, at, slot)
    return next((end for e in ends if (end := _walk(words, e, rest)) is not None), None)


@cache
def _first(rule: tuple) -> frozenset[str]:
    """The words that a rule may begin with."""
    slot = rule[0]
    some = frozenset(p.split(" ")[0] for p in (slot[1] if slot[0] == "maybe" else slot))
    return some | _first(rule[1:]) if slot[0] == "maybe" else some


@cache
def _by_first(rules: tuple) -> dict[str, list[tuple]]:
    """The rules that may begin with a word."""
    out: dict[str, list[tuple]] = {}
    for r in rules:
        for w in _first(r):
            out.setdefault(w, []).append(r)
    return out


def _found(words: list[str], rules: tuple, places: Iterable[int] | None = None) -> Iterator[int]:
    some = _by_first(rules)
    for at in range(len(words)) if places is None else places:
        if at < len(words) and any(_walk(words, at, r) is not None for r in some.get(words[at], ())):
            yield at


_PATIENT = ("the patient", "patient", "you", "he", "she", "they")
DIAGNOSTIC = (
    (_PATIENT, ("have", "has", "had", "suffer", "suffers", "is suffering", "are suffering"), ("maybe", ("from",)), ("free", 3), CONDITIONS_EN),
    (("is", "are", "was", "were", "been", "be"), ("diagnosed with",)),
    (("your",), ("free", 2), CONDITIONS_EN),
    (("this", "it", "these values", "the values", "the record"), ("confirm", "confirms", "prove", "proves", "mean", "means"), ("maybe", ("that",)), ("you", "the patient"), ("have", "has", "are", "is")),
    (("lei", "il paziente", "la paziente", "paziente"), _HAS_IT := ("ha", "hai", "presenta", "soffre di", "soffri di", "è affetto da", "è affetta da", "sei affetto da", "sei affetta da"), ("free", 3), CONDITIONS_IT),
    (("la sua", "il suo", "la tua", "il tuo"), ("free", 2), CONDITIONS_IT),
    (("le", "ti", "gli"), ("è stato", "è stata"), ("diagnosticato", "diagnosticata")),
    (("è", "sei"), ("anemico", "anemica", "nefropatico", "nefropatica")),
)
AT_THE_START = ((_HAS_IT, ("free", 3), CONDITIONS_IT),)
TREATMENT = (
    (("the patient", "patient", "you", "they"), ("should", "must", "need to", "needs to", "ought to", "have to", "has to"), ("free", 1), ACTIONS_EN),
    (("deve", "dovrebbe", "devi", "dovresti", "bisogna", "occorre", "è necessario"), ("free", 1), ACTIONS_IT),
)
ORDERS = ((("maybe", ("please",)), ORDERS_EN), (ORDERS_IT,))
PASSIVE = ((("should", "must"), ("maybe", ("be",)), DONE_EN), (("deve", "dovrebbe", "devono", "dovrebbero"), ("essere",), DONE_IT))


def wording(text: str) -> list[str]:
    """Diagnoses that no word before denies, and instructions that no source is named for."""
    words, out = words_of(text), []
    starts = [0, *[k + 1 for k, w in enumerate(words) if w in ".;:"]]
    for at in [*_found(words, DIAGNOSTIC), *_found(words, AT_THE_START, starts)]:
        before = [w for w in words[:at] if w[0].isalnum()][-6:]
        if not NEGATIONS & set(before):
            out.append("diagnostic wording")
            break
    holds = lambda rules, places=None: next(_found(words, rules, places), None) is not None
    orders = holds(ORDERS, [0]) or holds(TREATMENT)
    if orders or (holds(PASSIVE) and not any(_phrase(words, k, ATTRIBUTIONS) for k in range(len(words)))):
        out.append("treatment instruction")
    return out


_FREE_FROM = ((("no", "without", "non"), ("anaemia", "anemia", "anaemic", "anemic")), (("nessuna", "assenza di", "senza", "no"), ("anemia",)))
#: The words that a category may begin with, other than G and A with a number.
_TELLING = {"stage", "stadio", "ckd", "mrc", "risk", "rischio", *SEVERITY, *SEVERITY_IT} | {p.split(" ")[0] for p in (*CONDITIONS_IT, *RISKS, *_FREE_FROM[0][0], *_FREE_FROM[1][0])}


def categories(text: str) -> list[str]:
    """Stages, categories, grades of severity and levels of risk that a text names, in one form for both languages."""
    plain = re.findall(r"[^\W_]+", text)
    words, out = [w.lower() for w in plain], set()
    for k, w in enumerate(words):
        if w not in _TELLING and plain[k][0] not in "GA":
            continue
        if m := re.fullmatch(r"G([1-5][ab]?)|A([1-3])", plain[k]):
            out.add(m.group())
        if w in ("stage", "stadio", "ckd", "mrc") and k + 1 < len(words) and re.fullmatch("[1-5][ab]?", words[k + 1]):
            out.add(f"G{plain[k + 1]}")
        if w in SEVERITY and _phrase(words, k + 1, CONDITIONS_EN):
            out.add(f"severity {SEVERITY[w]}")
        if w in SEVERITY_IT and _phrase(words, k + 1, CONDITIONS_IT):
            out.add(f"severity {SEVERITY_IT[w]}")
        out |= {f"severity {SEVERITY_IT[words[e]]}" for e in _phrase(words, k, CONDITIONS_IT) if e < len(words) and words[e] in SEVERITY_IT}
        ends = [e for starts, names in _FREE_FROM for s in _phrase(words, k, starts) for e in _phrase(words, s, names)]
        if any(not _phrase(words, e, NOT_GRADED) for e in ends):
            out.add("severity none")
        out |= {f"risk {RISKS[r]}" for r in RISKS if any(words[e : e + 1] == ["risk"] for e in _phrase(words, k, (r,)))}
        if w == "risk":
            out |= {f"risk {RISKS[r]}" for r in RISKS for e in _phrase(words, k + 1, ("is", "was", "would be")) if _phrase(words, e, (r,))}
        if w == "rischio":
            out |= {f"risk {RISKS_IT[r]}" for r in RISKS_IT for e in (k + 1, *_phrase(words, k + 1, ("è",))) if _phrase(words, e, (r,))}
    return sorted(out)


#: The words that the name of a source begins with.
_NAMING = {form.split(" ")[0] for forms in SOURCES.values() for form in forms}


def sources(text: str) -> list[str]:
    """The sources that a text names."""
    plain = re.findall(r"[^\W_]+", text)
    words = [w.lower() for w in plain]
    named = {name for k, w in enumerate(words) if w in _NAMING and plain[k] != "who" for name, forms in SOURCES.items() if _phrase(words, k, forms)}
    return sorted(named)


def wrong_language(text: str, language: str) -> bool:
    words = re.findall(r"[a-zà-ÿ']+", text.lower())
    n = {"en": sum(w in COMMON_EN for w in words), "it": sum(w in COMMON_IT for w in words)}
    other = "it" if language == "en" else "en"
    return n[other] >= 3 and n[other] > n[language]


def ids_in(text: str) -> list[str]:
    """What may be the id of an item in a text: letters with a number that stand alone, and F after a word that points to it."""
    found = re.findall(r"(?<![\w/.\-])[A-Z]+\d+(?![\w/\-]|\.\d)", text)
    pointed = [b for a, b in zip(re.findall(r"[^\W_]+", text), re.findall(r"[^\W_]+", text)[1:]) if b == "F" and a.lower() in POINTS_TO_F]
    return sorted({*found, *pointed})


# ---- on tables

_READ = pa.struct([
    ("text", pa.string()), ("numbers", pa.list_(pa.list_(pa.string()))), ("days", pa.list_(pa.string())), ("months", pa.list_(pa.string())), ("categories", pa.list_(pa.string())),
    ("sources", pa.list_(pa.string())), ("ids", pa.list_(pa.string())), ("wording", pa.list_(pa.string())),
])
_KIND = "struct<text:string,numbers:array<array<string>>,days:array<string>,months:array<string>,categories:array<string>,sources:array<string>,ids:array<string>,wording:array<string>>"


#: Characters of a text at most whose reading is kept, and how many are.
SHORT_TEXT, KEPT_TEXTS = 1000, 4096


def _read(text: str | None, language: str | None, sentence: bool) -> dict:
    text, language = without_refs(text or "") if sentence else text or "", language if language == "it" else "en"
    numbers, days, months = values(text, language)
    said = []
    if sentence:
        said = ["doctor sentence (code adds it)"] * bool(DOCTORS & set(re.findall(r"[^\W_]+", text.lower()))) + wording(text) + ["wrong language"] * wrong_language(text, language)
    return {"text": text, "numbers": numbers, "days": days, "months": months, "categories": categories(text), "sources": sources(text), "ids": ids_in(text), "wording": said}


_read_again = lru_cache(KEPT_TEXTS)(_read)  # stock sentences come again and again


def _reading(text: str | None, language: str | None, sentence: bool) -> dict:
    return (_read_again if len(text or "") <= SHORT_TEXT else _read)(text, language, sentence)


def typed(rows: DataFrame, text_col: str, language: Column, *, sentence: bool) -> DataFrame:
    """The rows with `read`, the typed values of their text; sentences lose their references first."""
    keep = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            read = [_reading(t, x, sentence) for t, x in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(read, _READ)], [*keep, "read"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(*keep, F.col(text_col).alias("__t"), language.alias("__l")).mapInArrow(run, f"{kinds}, read {_KIND}")


def checked(sentences: DataFrame, items: DataFrame) -> DataFrame:
    """pack, sentence, kept text and problems of every sentence; no problem means that it may stay.

    `sentences` has pack, sentence, text, cites (item ids) and language (en or it; others count as
    en), `items` pack, item, kind, text and day. Items are read as English. A null text is empty,
    and so is a sentence of references alone.
    """
    known = typed(items.select("pack", "item", "kind", "text", "day"), "text", F.lit("en"), sentence=False)
    years = F.transform("read.days", lambda d: F.regexp_replace(F.substring(d, 1, 4), "^0+", ""))  # a year may be written by itself
    known = known.select(
        "pack", F.col("item").alias("cite"), F.concat(F.flatten("read.numbers"), years).alias("numbers"), F.array_compact(F.concat("read.days", F.array(F.col("day").cast("string")))).alias("days"),
        F.when(F.col("kind") != "passage", F.col("read.categories")).otherwise(F.array().cast("array<string>")).alias("categories"), F.col("read.sources").alias("sources"),
    )
    ids = items.groupBy("pack").agg(F.collect_set("item").alias("item_ids"))
    read = typed(sentences.select("pack", "sentence", "text", "cites", "language"), "text", F.col("language"), sentence=True).drop("text", "language")
    met = sentences.select("pack", "sentence", F.explode(F.coalesce("cites", F.array().cast("array<string>"))).alias("cite")).join(known.withColumn("known", F.lit(True)), ["pack", "cite"], "left")
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(f"cited_{c}")
    cited = met.groupBy("pack", "sentence").agg(*map(every, ("numbers", "days", "categories", "sources")), F.collect_set(F.when(F.col("known").isNull(), F.col("cite"))).alias("unknown"))
    rows = read.join(cited, ["pack", "sentence"], "left").join(ids, "pack", "left")
    none = F.array().cast("array<string>")
    c = {name: F.coalesce(name, none) for name in ("cited_numbers", "cited_days", "cited_categories", "cited_sources", "unknown", "item_ids", "cites")}
    unknown = F.filter("cites", lambda x: F.array_contains(c["unknown"], x))
    months = F.transform(c["cited_days"], lambda d: F.substring(d, 1, 7))
    when = lambda is_, name: F.when(is_, F.array(F.lit(name))).otherwise(none)
    found = F.concat(
        when((F.size(F.array_except("read.days", c["cited_days"])) > 0) | (F.size(F.array_except("read.months", months)) > 0), "date not in cited items"),
        when(F.exists("read.numbers", lambda forms: ~F.arrays_overlap(forms, c["cited_numbers"])), "number not in cited items"),
        when(F.size(F.array_except("read.categories", c["cited_categories"])) > 0, "category not from the rule"),
        when(F.size(F.array_except("read.sources", c["cited_sources"])) > 0, "source not in cited items"),
        when(F.size(F.array_intersect("read.ids", c["item_ids"])) > 0, "item ID in the text"),
        F.col("read.wording"),
    )
    problems = (
        F.when(F.col("read.text") == "", F.array(F.lit("empty")))
        .when(F.size(c["cites"]) == 0, F.array(F.lit("no citation")))
        .when(F.size(c["unknown"]) > 0, F.array(F.concat(F.lit("unknown citation "), F.array_join(unknown, ", "))))
        .otherwise(found)
    )
    return rows.select("pack", "sentence", F.col("read.text").alias("text"), problems.alias("problems"))
