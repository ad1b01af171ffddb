"""Readers on files made here."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from quirewise.plans import output
from quirewise.sources import corpus, docx, images, ocr, physical
from quirewise.streaming import incoming

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOC = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>EDUCATION</w:t></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="LB"/><w:ind w:left="1440"/></w:pPr><w:r><w:t>item </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r></w:p>
<w:p><w:r><w:t> </w:t></w:r></w:p>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>left</w:t></w:r></w:p></w:tc><w:tc><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>
<w:p><w:hyperlink r:id="r1"><w:r><w:t>site</w:t></w:r></w:hyperlink></w:p></w:body></w:document>"""
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:styleId="B"><w:name w:val="base"/><w:rPr><w:b/><w:sz w:val="28"/></w:rPr></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="B"/></w:style>
<w:style w:styleId="LB"><w:name w:val="List Bullet"/></w:style></w:styles>"""
RELS = '<Relationships><Relationship Id="r1" Target="https://x.example"/></Relationships>'


def make_docx() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("word/document.xml", DOC), ("word/styles.xml", STYLES), ("word/_rels/document.xml.rels", RELS)):
            z.writestr(name, text)
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx())
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = docx.scan(spark, str(tmp_path)).collect()
    good = sorted((r for r in rows if r["path"].endswith("/a.docx")), key=lambda r: r["line_no"])
    assert [(r["text"], r["size"], r["bold"], r["level"], r["tbl"], r["row"], r["col"]) for r in good] == [
        ("EDUCATION", 14.0, True, 0.0, None, None, None), ("• item bold", 10.0, True, 2.0, None, None, None), ("left", 10.0, False, 0.0, 0, 0, 0), ("inner", 10.0, False, 0.0, 1, 0, 0), ("site", 10.0, False, 0.0, None, None, None),
    ]
    assert [r["error"] for r in rows if r["path"].endswith("bad.docx")] == ["unreadable: BadZipFile"]
    assert [(r["text"], r["url"]) for r in docx.links(docx.scan(spark, str(tmp_path))).collect()] == [("site", "https://x.example")]


def test_docx_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(make_docx())
    for _ in range(2):  # what was seen stays seen
        q = incoming.write_lines(incoming.incoming_docx(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_ocr_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    body = "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t\n5\t1\t1\t1\t1\t1\t300\t300\t100\t30\t90\tHello\n5\t1\t1\t1\t1\t2\t450\t300\t100\t60\t-1\t\"quoted\n5\t1\t1\t1\t1\t3\t600\t300\t100\t30\t80\t \n"
    (tmp_path / "p.tsv").write_text(head + body)
    r = ocr.lines(ocr.words(ocr.read_tsv(spark, str(tmp_path / "p.tsv")))).first()
    assert r["text"] == 'Hello "quoted' and r["confidence"] == 90 and abs(r["size"] - 10.8) < 1e-9 and r["bbox"]["x0"] == 72.0


def test_physical_pages(spark, tmp_path):
    char = lambda c, x: {"c": c, "bbox": [x, 0.0, x + 5, 10.0], "origin": [x, 8.0]}
    span = {"font": "Arial-Bold", "size": 10.0, "flags": 2, "color": 0, "chars": [char("H", 0.0), char("i", 5.0)]}
    page = {"doc_id": "d", "page": 1, "width": 600.0, "height": 800.0, "rotation": 0, "blocks": [{"type": 0, "bbox": [0, 0, 10, 10], "lines": [{"dir": [1.0, 0.0], "bbox": [0, 0, 10, 10], "spans": [span]}, {"dir": [1.0, 0.0], "bbox": [0, 0, 1, 1], "spans": []}]}, {"type": 1, "bbox": [5, 5, 50, 50], "lines": []}], "drawings": [[0, 5, 100, 6], [5, 0, 6, 100], [0, 0, 50, 50]], "links": [{"uri": "https://x", "rect": [0, 0, 9, 9]}, {"uri": None, "rect": None}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    pages = physical.read_pages(spark, str(tmp_path / "p.json"))
    lines = physical.lines(pages)
    assert [(r["text"], r["bold"], r["size"]) for r in lines.collect()] == [("Hi", True, 10.0)]
    s = physical.spans(lines).first()
    assert (s["text"], s["italic"], s["mono"], s["x0"], s["x1"]) == ("Hi", True, False, 0.0, 10.0)
    assert [(r["text"], r["origin_y"], r["char_width"]) for r in physical.tokens(physical.spans(lines)).collect()] == [("H", 8.0, 5.0), ("i", 8.0, 5.0)]
    assert sorted(r["orientation"] for r in physical.rules(pages).collect()) == ["horizontal", "vertical"]
    assert physical.images(pages).count() == 1 and [r["uri"] for r in physical.links(pages).collect()] == ["https://x"]


def jpeg(w, h, turn):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, turn, 0)
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 20


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 400, 200) + b"\0" * 8
    df = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(jpeg(400, 200, 6))), ("c", bytearray(b"text")), ("d", bytearray(jpeg(10, 20, 2)))], "path string, content binary")
    got = {r["path"]: (r["rotation"], r["width"], r["height"]) for r in images.pages(images.sizes(df)).collect()}
    assert got["a"] == (0, 842.0, 421.0) and got["b"] == (270, 421.0, 842.0) and got["d"] == (0, 421.0, 842.0) and got["c"][1] is None


def test_bad_files_are_rows(spark):
    df = spark.createDataFrame([("/x/a.docx", bytearray(b"PK\3\4..")), ("/x/b.pdf", bytearray(b"%PDF /Encrypt")), ("/x/c.txt", bytearray(b"t")), ("/x/d.png", bytearray(b"")), ("/x/e.pdf", bytearray(b"zzzz"))], "path string, content binary")
    got = {r["path"][-5:]: (r["reader"], r["error"], r["code"]) for r in corpus.checked(df).collect()}
    assert got == {"a.docx"[-5:]: ("docx", None, None), "b.pdf"[-5:]: ("pdf", "encrypted", 20), "c.txt"[-5:]: (None, "unsupported", 11), "d.png"[-5:]: ("image", "empty", 21), "e.pdf"[-5:]: ("pdf", "unreadable", 12)}


def test_paths(spark):
    df = spark.createDataFrame([("/in/a.b.docx", "/out/"), ("/in/a.docx", "/out/r.json"), ("/in/a.docx", "/out/dir")], "p string, t string")
    got = [tuple(r) for r in df.select(corpus.output_path(F.col("p"), F.col("t")).alias("o")).select("o", corpus.artifact_folder(F.col("o"))).collect()]
    assert got == [("/out/a.b.json", "/out/a.b"), ("/out/r.json", "/out/r"), ("/out/dir/a.json", "/out/dir/a")]


def test_evidence_files(spark, tmp_path):
    ev = spark.createDataFrame([("d", "skills", "x")], "doc_id string, section string, text string")
    output.write_evidence(ev, str(tmp_path / "ev"))
    assert [p.name for p in (tmp_path / "ev").iterdir() if p.is_dir()] == ["section=skills"]
