"""Word documents: body paragraphs and table cells in order, as rows of lines.

A document's zip and XML have no built-in reader, so each file is parsed in an Arrow batch function; a file
that can't be read becomes an error row and stops nothing else. Positions are ordinal: one unit down a
paragraph, one to the right a half inch of indent.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the format, and the styles that make list items and headings.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LIST_STYLES = ("list bullet", "list number", "list paragraph")
MARKER = "• "
LINES = "path string, line_no int, text string, style string, size double, bold boolean, level double, tbl int, row int, col int, links array<struct<text:string,url:string>>, error string"


def _value(element, path: str) -> str | None:
    found = element.find(path) if element is not None else None
    return found.get(f"{W}val", "true") if found is not None else None


class Styles:
    """Names and font properties of styles, each falling back on what it is based on."""

    def __init__(self, xml: bytes | None):
        self.by_id, self.size = {}, 11.0
        if xml:
            root = ElementTree.fromstring(xml)
            default = _value(root, f"{W}docDefaults/{W}rPrDefault/{W}rPr/{W}sz")
            self.size = float(default) / 2 if default else self.size
            for s in root.iter(f"{W}style"):
                run = s.find(f"{W}rPr")
                self.by_id[s.get(f"{W}styleId")] = (_value(s, f"{W}name") or "", _value(s, f"{W}basedOn"), _value(run, f"{W}sz"), _value(run, f"{W}b"))

    def name(self, style: str | None) -> str:
        return self.by_id.get(style, ("",))[0]

    def look_up(self, style: str | None, field: int):
        for _ in range(10):
            if style not in self.by_id:
                return None
            entry = self.by_id[style]
            if entry[field] is not None:
                return entry[field]
            style = entry[1]
        return None


def _on(value: str | None) -> bool:
    return value is not None and value not in ("0", "false", "off", "none")


def parse(path: str, content: bytes):
    """Rows of one file."""
    from re import match

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = Styles(z.read("word/styles.xml") if "word/styles.xml" in names else None)
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
    state = {"line": 0, "table": -1}

    def paragraph(p, cell):
        style = _value(p, f"{W}pPr/{W}pStyle")
        runs, links = [], []
        for node in p:
            inside = [node] if node.tag == f"{W}r" else list(node.iter(f"{W}r")) if node.tag == f"{W}hyperlink" else []
            said = []
            for run in inside:
                text = "".join("\t" if t.tag == f"{W}tab" else "\n" if t.tag == f"{W}br" else t.text or "" for t in run if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))
                own = run.find(f"{W}rPr")
                sizes = [_value(own, f"{W}sz"), styles.look_up(_value(own, f"{W}rStyle"), 2), styles.look_up(style, 2)]
                bolds = [_value(own, f"{W}b"), styles.look_up(_value(own, f"{W}rStyle"), 3), styles.look_up(style, 3)]
                if text:
                    runs.append((text, next((float(s) / 2 for s in sizes if s), styles.size), _on(next((b for b in bolds if b is not None), None))))
                    said.append(text)
            target = rels.get(node.get(f"{R}id")) if node.tag == f"{W}hyperlink" else None
            if target and said:
                links.append({"text": "".join(said), "url": target})
        text = "".join(r[0] for r in runs)
        if not text.strip():
            return None
        listed = styles.name(style).lower().startswith(LIST_STYLES) or p.find(f"{W}pPr/{W}numPr") is not None
        if listed and not match(r"\s*(?:[-+*•●▪◦‣¢]|\d+[.)])", text):
            text = MARKER + text
        indent = p.find(f"{W}pPr/{W}ind")
        left = float((indent.get(f"{W}left") or indent.get(f"{W}start") or 0) if indent is not None else 0) / 1440
        row = (path, state["line"], text, styles.name(style), max(r[1] for r in runs), any(r[2] for r in runs), max(0.0, round(left / 0.5, 2)), *(cell or (None, None, None)), links, None)
        state["line"] += 1
        return row

    def walk(container, cell):
        for node in container:
            if node.tag == f"{W}p":
                if (row := paragraph(node, cell)) is not None:
                    yield row
            elif node.tag == f"{W}tbl":
                state["table"] += 1
                table = state["table"]
                for i, tr in enumerate(node.findall(f"{W}tr")):
                    for j, tc in enumerate(tr.findall(f"{W}tc")):
                        yield from walk(tc, (table, i, j))
            elif node.tag == f"{W}sdt" and node.find(f"{W}sdtContent") is not None:
                yield from walk(node.find(f"{W}sdtContent"), cell)

    yield from walk(body, None)


def read_docx(files: DataFrame) -> DataFrame:
    """Lines of files (path, content), as the binaryFile source gives them."""

    def run(batches):
        import pandas as pd

        names = [c.split(" ")[0] for c in LINES.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = list(parse(path, content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, TypeError) as e:
                    rows = [(path, 0, None, None, None, None, None, None, None, None, None, f"unreadable: {type(e).__name__}")]
                yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line_no", "tbl", "row", "col")})

    return files.select("path", "content").mapInPandas(run, LINES)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    return read_docx(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder))


def links(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line_no", F.explode("links").alias("l")).select("path", "line_no", "l.text", "l.url")
