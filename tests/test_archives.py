"""One archive of many tasks, and the structure of Word files."""

import io
import zipfile

from corpusmill.functions import word_files
from corpusmill.sources import archives


def test_an_archive_of_many_tasks_reads_like_any_other(spark, tmp_path):
    rows = [(f"m/{i:03d}-é.txt", "ab\n" * i * 50) for i in range(60)] + [("same", "1"), ("same", "2"), (None, "nameless"), ("none", None)]
    table = spark.createDataFrame(rows, "name string, content string").repartition(5)
    manifest = archives.write_archive(table, f"file://{tmp_path}/one.zip")
    with zipfile.ZipFile(tmp_path / "one.zip") as z:
        assert z.testzip() is None
        got = sorted((i.filename, z.read(i).decode()) for i in z.infolist())
        assert [i.filename for i in z.infolist()] == sorted(i.filename for i in z.infolist())
    assert got == sorted((n or "", c or "") for n, c in rows)
    back = archives.read_members(manifest, f"file://{tmp_path}/one.zip").collect()
    assert sorted((r["name"], r["content"].decode()) for r in back) == got
    assert archives.write_archive(table.limit(0), f"{tmp_path}/none.zip").count() == 0
    with zipfile.ZipFile(tmp_path / "none.zip") as z:
        assert z.namelist() == []


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TYPES = '<Types><Override ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'


def package(body, **parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in {"[Content_Types].xml": TYPES, "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **parts}.items():
            z.writestr(name, content)
    return bytearray(buffer.getvalue())


def p(text, style=None):
    return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_blocks_of_word_files(spark):
    cell = lambda *inner: f"<w:tc>{''.join(inner)}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell(p('deep'))}</w:tr></w:tbl>"
    body = (
        p("Title", "H1") + p("") + p("Part", "Heading2") + p("one<w:br/>") + f"<w:sdt><w:sdtPr><w:t>no</w:t></w:sdtPr><w:sdtContent>{p('held')}</w:sdtContent></w:sdt>"
        + f"<w:tbl><w:tr>{cell(p('a'), p('b'))}{cell(p(''))}</w:tr><w:tr>{cell(p('c'), nested)}</w:tr></w:tbl>"
        + "<w:p><w:r><w:t>kept</w:t><w:tab/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>" + f"<w:moveFrom>{p('away')}</w:moveFrom><w:odd>{p('strange')}</w:odd>" + p("Last", "H1") + "<w:sectPr/>"
    )
    parts = {
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="-1">{p("line")}</w:footnote><w:footnote w:id="3">{p("a note")}</w:footnote></w:footnotes>',
        "word/comments.xml": f"<w:comments {W}/>", "word/_rels/document.xml.rels": '<Relationships><Relationship TargetMode="External"/></Relationships>',
    }
    bad = {
        "too_large": package(p("x" * 110_000_000)), "unsafe_path": package(p("x"), **{"../x": "x"}), "macros": package(p("x"), **{"word/vbaProject.bin": "x"}), "no_document": package(p("x"), **{"[Content_Types].xml": "<Types/>"}),
        "entities": package(p("x"), **{"word/x.xml": "<!doctype x>"}), "broken_xml": package("<w:p>"), "no_text": package(p(" ")), "not_a_package": bytearray(b"no"), "empty": None,
    }
    files = spark.createDataFrame([("good", package(body, **parts)), *bad.items()], "id string, c binary")
    got = word_files.docx_blocks(files, "c", "id").collect()
    assert {r["id"]: r["status"] for r in got if r["id"] != "good"} == {k: k for k in bad}
    good = [r for r in got if r["id"] == "good"]
    assert [(r["block_id"], r["text"], r["headings"]) for r in good if r["status"] == "ok"] == [
        ("docx-p-00001", "Title", ["Title"]), ("docx-p-00003", "Part", ["Title", "Part"]), ("docx-p-00004", "one", ["Title", "Part"]), ("docx-p-00005", "held", ["Title", "Part"]),
        ("docx-t-0001-r-0001-c-0001", "a\nb", ["Title", "Part"]), ("docx-t-0001-r-0002-c-0001", "c\ndeep", ["Title", "Part"]), ("docx-p-00006", "kept new", ["Title", "Part"]), ("docx-p-00007", "Last", ["Last"]),
        ("docx-footnote-3", "a note", []),
    ]
    assert [r["ordinal"] for r in good if r["status"] == "ok"] == list(range(1, 10)) and good[0]["style"] == "heading 1"
    assert sorted(r["text"] for r in good if r["status"] == "warning") == ["comments", "external_links", "left_out:odd", "revisions"]
