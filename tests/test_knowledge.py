"""Label sections and evidence packs."""

from datetime import date

from carepath.operators import evidence
from carepath.sources import labels

XML = b"""<document xmlns="urn:hl7-org:v3"><setId root="s-1"/><versionNumber value="4"/><effectiveTime value="20250102"/><code code="34391-3"/>
<author><assignedEntity><representedOrganization><name>Maker</name></representedOrganization></assignedEntity></author>
<component><structuredBody><component><section><code code="34067-9"/><title>1 USES</title><text><paragraph>For <content>pain</content>.</paragraph><list><item>one</item><item>two</item></list>
<table><tr><td>a</td><td>b</td></tr></table><paragraph>10<sup>2</sup> mL</paragraph></text>
<component><section><title>1.1 Adults</title><text>Take it.</text></section></component></section></component>
<component><section><code code="48780-1"/><text>data</text></section></component></structuredBody></component></document>"""


def test_sections(spark):
    files = spark.createDataFrame([("f.xml", bytearray(XML))], "path string, content binary")
    got = labels.sections(files).orderBy("n").collect()
    assert [(r["code"], r["path"], r["text"]) for r in got] == [("34067-9", ["1 USES"], "For pain.\n• one\n• two\na | b\n10^2 mL"), (None, ["1 USES", "1.1 Adults"], "Take it.")]
    x = labels.identity(files).first()
    assert (x["set_id"], x["version"], x["effective"], x["labeler"]) == ("s-1", 4, date(2025, 1, 2), "Maker")


def test_pack_and_review(spark):
    flags = spark.createDataFrame(
        [("p", "r", "Test due", "No test since 2024.", [(date(2024, 1, 5), "eGFR", "45", None, "n1")], ["one value"], [("k1", "Guide 2024", "Test each year")], [("c1", "Guide", "page 3", "Yearly tests.")])],
        "patient string, rule string, title string, statement string, evidence array<struct<date:date,label:string,value:string,note:string,node:string>>, limitations array<string>, statements array<struct<id:string,citation:string,quote:string>>, passages array<struct<id:string,title:string,place:string,text:string>>",
    )
    items = evidence.pack(flags)
    assert {r["id"]: r["text"] for r in items.collect()} == {"F": "Test due. No test since 2024.", "E1": "2024-01-05: eGFR: 45", "L1": "one value", "S1": 'Guide 2024: "Test each year"', "P1": "Guide, page 3: Yearly tests."}
    said = [("p", "r", 1, "The eGFR was 45.", ["E1"]), ("p", "r", 2, "A test each year.", ["S1"]), ("p", "r", 3, "It was 46.", ["E1"]), ("p", "r", 4, "See there.", ["X9"]), ("p", "r", 5, "No source.", [])]
    x = evidence.reviewed(spark.createDataFrame(said, "patient string, rule string, n int, text string, cites array<string>"), items).first()
    assert (x["n_kept"], x["n_dropped"], x["used"]) == (2, 3, True)
