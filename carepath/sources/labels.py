"""Drug labels in HL7 structured product labelling: one row for each section, in document order."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Section codes and elements that carry no text of their own to read.
NO_SECTIONS = ("48780-1", "51945-4")
NO_ELEMENTS = ("excerpt", "renderMultiMedia", "observationMedia")

SECTION = "source string, n int, code string, path array<string>, text string"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _flow(node: ElementTree.Element) -> Iterator[str]:
    """The text in a node; '\\n' ends a line, cells are set apart, items and superscripts marked."""
    name = _name(node.tag)
    if name in NO_ELEMENTS or name == "section":
        return
    if name == "sup":
        yield "^"
    elif name == "br":
        yield " "
    elif name == "item":
        yield "\n• "
    elif name in ("td", "th"):
        yield "\t"
    elif name in ("paragraph", "caption", "tr", "list", "table"):
        yield "\n"
    yield node.text or ""
    for child in node:
        yield from _flow(child)
        yield child.tail or ""
    if name in ("paragraph", "caption", "tr", "item", "list", "table"):
        yield "\n"


def _lines(node: ElementTree.Element | None) -> str:
    if node is None:
        return ""
    lines = []
    for row in "".join(_flow(node)).split("\n"):
        cells = [" ".join(c.split()) for c in row.split("\t")]
        lines.append(" | ".join(c for c in cells if c))
    return "\n".join(x for x in lines if x.strip("•| "))


def _children(node: ElementTree.Element, *steps: str) -> list[ElementTree.Element]:
    """The elements that a path of names leads to, in order."""
    found = [node]
    for step in steps:
        found = [c for n in found for c in n if _name(c.tag) == step]
    return found


def section_rows(xml: bytes) -> Iterator[tuple[str | None, list[str], str]]:
    """(code, titles from the top down, own text) of every section that has text, in the order of the document.

    Sections wait on a stack with the titles above them, so they may nest to any depth.
    """
    root = ElementTree.fromstring(xml)
    inner = {s for p in root.iter() if _name(p.tag) == "section" for s in p.iter() if s is not p and _name(s.tag) == "section"}
    waiting = [(s, ()) for s in root.iter() if _name(s.tag) == "section" and s not in inner][::-1]
    while waiting:
        section, above = waiting.pop()
        codes, titles, texts = (_children(section, name) for name in ("code", "title", "text"))
        code = codes[0].get("code") if codes else None
        if code in NO_SECTIONS:
            continue
        path = (*above, " ".join("".join(titles[0].itertext()).split()) if titles else "")
        if text := _lines(texts[0] if texts else None):
            yield code, list(path), text
        waiting += [(s, path) for s in reversed(_children(section, "component", "section"))]


def sections(files: DataFrame) -> DataFrame:
    """Sections of label files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, n, *s) for path, xml in zip(part["path"], part["content"], strict=True) for n, s in enumerate(section_rows(xml), 1)]
            yield pd.DataFrame(rows, columns=["source", "n", "code", "path", "text"])

    return files.select("path", "content").mapInPandas(run, SECTION)


def identity(files: DataFrame) -> DataFrame:
    """Set id, version, effective date, type and labeler of label files."""
    xml = F.regexp_replace(F.col("content").cast("string"), r'\sxmlns(?::\w+)?="[^"]*"|\w+:(?=schemaLocation)', "")
    get = lambda path: F.expr(f"xpath_string(__xml, '{path}')")
    return files.withColumn("__xml", xml).select("path", get("/document/setId/@root").alias("set_id"), get("/document/versionNumber/@value").cast("int").alias("version"), F.try_to_date(get("/document/effectiveTime/@value"), "yyyyMMdd").alias("effective"), get("/document/code/@code").alias("type"), get("/document/author//representedOrganization/name").alias("labeler"))
