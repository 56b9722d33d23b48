"""Schemas of the resources that are read, as far as they are read. Numbers are kept as written, so they are strings here."""

from __future__ import annotations

CODING = "struct<system:string,code:string,display:string>"
CONCEPT = f"struct<coding:array<{CODING}>,text:string>"
REF = "struct<reference:string>"
PERIOD = "struct<start:string,end:string>"
QUANTITY = "struct<value:string,unit:string,system:string,code:string,comparator:string>"
RANGE = f"struct<low:{QUANTITY},high:{QUANTITY},text:string>"
VALUES = f"valueQuantity:{QUANTITY},valueCodeableConcept:{CONCEPT},valueString:string,valueBoolean:boolean,valueInteger:string,valueDateTime:string,valueRange:string,valueRatio:string,valuePeriod:string,valueSampledData:string,valueTime:string"
_COMMON = f"subject:{REF},encounter:{REF},status:string"

RESOURCES = {
    "Patient": "struct<gender:string,birthDate:string,deceasedDateTime:string,deceasedBoolean:boolean>",
    "Encounter": f"struct<status:string,class:struct<code:string>,type:array<{CONCEPT}>,period:{PERIOD},subject:{REF}>",
    "Condition": f"struct<code:{CONCEPT},clinicalStatus:{CONCEPT},verificationStatus:{CONCEPT},category:array<{CONCEPT}>,onsetDateTime:string,onsetPeriod:{PERIOD},abatementDateTime:string,abatementPeriod:{PERIOD},recordedDate:string,{_COMMON}>",
    "MedicationRequest": f"struct<medicationCodeableConcept:{CONCEPT},medicationReference:{REF},intent:string,authoredOn:string,dosageInstruction:array<struct<text:string,asNeededBoolean:boolean>>,reasonReference:array<{REF}>,{_COMMON}>",
    "Medication": f"struct<code:{CONCEPT}>",
    "Observation": f"struct<code:{CONCEPT},category:array<{CONCEPT}>,effectiveDateTime:string,effectivePeriod:{PERIOD},issued:string,{VALUES},component:array<struct<code:{CONCEPT},{VALUES}>>,referenceRange:array<{RANGE}>,interpretation:array<{CONCEPT}>,{_COMMON}>",
    "Procedure": f"struct<code:{CONCEPT},performedDateTime:string,performedPeriod:{PERIOD},reasonReference:array<{REF}>,{_COMMON}>",
    "DiagnosticReport": f"struct<code:{CONCEPT},category:array<{CONCEPT}>,effectiveDateTime:string,effectivePeriod:{PERIOD},issued:string,result:array<{REF}>,presentedForm:array<struct<contentType:string,data:string>>,{_COMMON}>",
    "DocumentReference": f"struct<type:{CONCEPT},date:string,content:array<struct<attachment:struct<contentType:string,data:string>>>,context:struct<encounter:array<{REF}>>,subject:{REF},status:string>",
}

#: A row of `resources`: one entry of a bundle. `body` is JSON with every number as it was written.
ENTRY = "source string, seq int, full_url string, resource_type string, id string, body string"
