"""Sentences against the items they cite: what is kept and why the rest is not."""

import datetime as dt

import pytest

from carepath.operators import sentences as st

ITEMS = [
    ("F", "flag", "Hemoglobin under the WHO cutoff. The latest value 118.40 g/L on 2024-02-17 is under the WHO 2024 cutoff of 120 g/L for women. Worth raising with a doctor.", None),
    ("E1", "evidence", "2024-02-17: Hemoglobin: 118.40 g/L (latest)", dt.date(2024, 2, 17)),
    ("E2", "evidence", "Creatinine 1,250 umol/L, was 1.5 mg/dL", dt.date(2023, 12, 1)),
    ("L1", "limitation", "Only the last value counts. Latest category G3b A2.", None),
    ("S1", "statement", 'KDIGO 2024, Practice Point 3.2.1: "Test yearly in CKD 4", no anemia', None),
    ("P1", "passage", "Table: mild anaemia 110-119, G4 means a very high risk; KDIGO", None),
]
KEPT = [
    ("The latest hemoglobin was 118.4 g/L on 17 February 2024.", ["E1"], "en"),
    ("On February 17th, 2024 it was 118.40.", ["E1"], "en"),
    ("In February 2024 the value was low.", ["E1"], "en"),
    ("Prelievo del 17.2.2024, sotto la soglia.", ["E1"], "it"),
    ("L'ultimo valore, 118,4 g/L del 17 febbraio 2024, è sotto 120.", ["F"], "it"),
    ("Il valore del 17/02/2024 era 118,40 g/L.", ["E1"], "it"),
    ("Creatinine was 1250 umol/L or 1,250.", ["E2"], "en"),
    ("La creatinina era 1.250 oppure 1,5.", ["E2"], "it"),
    ("It was taken in December 2023.", ["E2"], "en"),
    ("KDIGO 2024 Practice Point 3.2.1 asks for a yearly test in stage 4.", ["S1"], "en"),
    ("Latest category: G3b with A2 [L1].", ["L1"], "en"),
    ("L'ultima categoria è G3b.", ["L1"], "it"),
    ("The record does not say that you have anaemia.", ["F"], "en"),
    ("Only the last value counts, as stated in L1.", ["L1"], "en"),
    ("Secondo l'OMS la soglia è 120 g/L.", ["F"], "it"),
    ("The label says that metformin should be stopped.", ["L1"], "en"),
    ("Lower values were seen, and reduced ones, who knows.", ["L1"], "en"),
]
DROPPED = [
    ("It was low.", [], "en", "no citation"),
    ("It was low.", ["E1", "E9", "X"], "en", "unknown citation E9, X"),
    (" [E1] (F, L1) ", ["E1"], "en", "empty"),
    (None, ["E1"], "en", "empty"),
    ("The value was 118 g/L.", ["E1"], "en", "number not in cited items"),
    ("The cutoff is 120 g/L.", ["E1"], "en", "number not in cited items"),
    ("Il valore era 11,84 g/dL.", ["E1"], "it", "number not in cited items"),
    ("The change was -1.5 mg/dL.", ["E2"], "en", "number not in cited items"),
    ("It was taken on 2024-02-18.", ["E1"], "en", "date not in cited items"),
    ("It was taken on 03/02/2024.", ["E1"], "en", "date not in cited items"),
    ("It was taken in March 2024.", ["E1"], "en", "date not in cited items"),
    ("You have a mild anaemia.", ["F"], "en", "diagnostic wording"),
    ("She was diagnosed with it.", ["F"], "en", "diagnostic wording"),
    ("Your kidney disease should be looked at.", ["F"], "en", "diagnostic wording"),
    ("Lei ha un'anemia.", ["F"], "it", "diagnostic wording"),
    ("Presenta una nefropatia.", ["F"], "it", "diagnostic wording"),
    ("Le è stata diagnosticata.", ["F"], "it", "diagnostic wording"),
    ("Please stop the tablets.", ["F"], "en", "treatment instruction"),
    ("Don't take more of it.", ["F"], "en", "treatment instruction"),
    ("You must quickly reduce it.", ["F"], "en", "treatment instruction"),
    ("It should be avoided.", ["F"], "en", "treatment instruction"),
    ("Sospenda tutto.", ["F"], "it", "treatment instruction"),
    ("Bisogna ridurre la dose.", ["F"], "it", "treatment instruction"),
    ("The value is under the cutoff for this person.", ["F"], "it", "wrong language"),
    ("Il valore è sotto la soglia per questa persona.", ["F"], "en", "wrong language"),
    ("This is a mild anaemia by the table.", ["E1", "P1"], "en", "category not from the rule"),
    ("By this table they are non-anaemic.", ["P1"], "en", "category not from the rule"),
    ("Il rischio è molto alto.", ["P1"], "it", "category not from the rule"),
    ("The risk is very high.", ["P1"], "en", "category not from the rule"),
    ("This is stage 4.", ["F"], "en", "category not from the rule"),
    ("KDIGO sets 120 g/L.", ["F"], "en", "source not in cited items"),
    ("Secondo l'OMS va valutato.", ["S1"], "it", "source not in cited items"),
    ("Ask a physician.", ["F"], "en", "doctor sentence (code adds it)"),
    ("Ne parli con il medico.", ["F"], "it", "doctor sentence (code adds it)"),
    ("As shown in F it is low.", ["F"], "en", "item ID in the text"),
    ("La fonte L1 lo spiega.", ["L1"], "it", "item ID in the text"),
]


def test_cases(spark):
    rows = [("p", k, t, c, x) for k, (t, c, x) in enumerate(KEPT)] + [("p", 1000 + k, t, c, x) for k, (t, c, x, _) in enumerate(DROPPED)]
    items = spark.createDataFrame([("p", *i) for i in ITEMS] + [("q", "E9", "evidence", "120", None)], "pack string, item string, kind string, text string, day date")
    got = {r.sentence: r for r in st.checked(spark.createDataFrame(rows, "pack string, sentence int, text string, cites array<string>, language string"), items).collect()}
    assert len(got) == len(rows)
    assert [(t, got[k].problems) for k, (t, *_) in enumerate(KEPT) if got[k].problems] == []
    assert [(t, why, got[1000 + k].problems) for k, (t, _, _, why) in enumerate(DROPPED) if why not in got[1000 + k].problems] == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Under the cutoff [E1, F].", "Under the cutoff."),
        ("It was 118.4 (E1), under 120 (F, S1; P1).", "It was 118.4, under 120."),
        ("Category (A2) and mass [Mass/volume].", "Category (A2) and mass [Mass/volume]."),
        ("Only one counts, per L1 and S2.", "Only one counts."),
        ("Sotto la soglia, come indicato in F.", "Sotto la soglia."),
        ("Dal sesso registrato, secondo quanto indicato da L3.", "Dal sesso registrato."),
        ("Not seen (see limitation L1).", "Not seen."),
        ("Seen on 2016-02-22 (item E1) and later.", "Seen on 2016-02-22 and later."),
        ("La fonte L1 lo spiega.", "La fonte L1 lo spiega."),
        ("The dose per day is listed in the label.", "The dose per day is listed in the label."),
    ],
)
def test_references_go(text, want):
    assert st.without_refs(text) == want


def test_values():
    numbers, days, months = st.values("2024-02-17, 17 Feb 2024, Feb. 17, 2024, 3/4/2025 and March of 2023; 31/02/2024; 1,148 to 15-65, -3 and HbA1c 6.1 in 2.1.1", "en")
    assert days == ["2024-02-17", "2025-03-04", "2025-04-03"] and months == ["2023-03"]
    assert numbers == [["1.148", "1148"][1:], ["15"], ["65"], ["-3"], ["6.1"], ["2.1.1"]]
    assert st.values("3/4/2025 e 1.148", "it") == ([["1.148", "1148"]], ["2025-04-03"], [])
    assert st.readings("121.130", "en") == {"121.13", "121130"}


def test_categories_in_both_languages():
    assert st.categories("CKD stage 3, stadio 3, MRC 3 and G3") == ["G3"]
    assert st.categories("anemia lieve; lieve anemia; mild anaemia") == ["severity mild"]
    assert st.categories("No anaemia diagnosis is recorded; nessuna anemia registrata; without anemia code") == []
    assert st.categories("senza anemia") == st.categories("non-anemic") == ["severity none"]
    assert st.categories("rischio moderatamente aumentato") == st.categories("moderately increased risk") == ["risk moderately increased"]
    assert st.categories("HbA1c 6.1 and 130 g/L, A2B") == []


def test_ids():
    assert st.ids_in("Int 2024;105(4S):S117-S314, pp. S155. P1.2 and as listed in P1.") == ["P1", "S155"]
    assert st.ids_in("5.1 F is warm, in F not") == ["F"]


def test_a_text_is_read_once(spark, monkeypatch):
    seen, real = [], st.values
    monkeypatch.setattr(st, "values", lambda *a: seen.append(a) or real(*a))
    once, long = "It was 4.5 on 2020-01-02, once more.", "It was 4.5. " * 200
    assert st._reading(once, "en", True) == st._reading(once, "en", True) and len(seen) == 1
    assert st._reading(long, "en", True) == st._reading(long, "en", True) and len(seen) == 3  # long texts are not kept
    asked = spark.createDataFrame([(1, 1, once, ["E1"], "en")], "pack int, sentence int, text string, cites array<string>, language string")
    items = spark.createDataFrame([(1, "E1", "evidence", "2020-01-02: 4.5", None)], "pack int, item string, kind string, text string, day date")
    out = st.checked(asked, items)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # sentences and items
    assert [r.problems for r in out.collect()] == [[]]
