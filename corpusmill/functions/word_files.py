"""Word files as blocks with locators: paragraphs under their headings, table cells, foot- and endnotes."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# What a package may have at most (members, bytes unpacked, and times its size for a member over a
# million bytes), elements that hold blocks, that hide them, and whose text doesn't count, and the forms of ids.
MOST_MEMBERS, MOST_BYTES, MOST_RATIO = 10_000, 100 << 20, 1000
HOLDERS = {"sdt", "sdtContent", "customXml", "ins", "moveTo"}
HIDDEN = {"del", "moveFrom", "sectPr", "sdtPr", "sdtEndPr"}
MUTE = {"del", "commentReference", "drawing", "object"}
WRITTEN = {"tab": "\t", "br": "\n", "cr": "\n"}
PARAGRAPH_ID, CELL_ID, NOTE_ID = "docx-p-{:05d}", "docx-t-{:04d}-r-{:04d}-c-{:04d}", "docx-{}-{}"
MAIN_PART, MAIN_TYPE = "word/document.xml", b"wordprocessingml.document.main+xml"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

BLOCK = StructType([
    StructField("status", StringType()), StructField("ordinal", IntegerType()), StructField("block_id", StringType()), StructField("kind", StringType()), StructField("text", StringType()),
    StructField("headings", ArrayType(StringType())), StructField("style", StringType()), *(StructField(n, IntegerType()) for n in ("paragraph", "table", "row", "cell")), StructField("note_id", StringType()),
])

#: Files that a worker holds parsed at a time.
PORTION = 100


class Refused(Exception):
    """Why a file isn't read."""


def _unpacked(blob: bytes) -> dict[str, bytes]:
    """The members of a package that is safe to read."""
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as archive:
            parts = archive.infolist()
            if len(parts) > MOST_MEMBERS or sum(p.file_size for p in parts) > MOST_BYTES or any(p.file_size > 1_000_000 and p.file_size > MOST_RATIO * max(p.compress_size, 1) for p in parts):
                raise Refused("too_large")
            for p in parts:
                link = (p.external_attr >> 28) == 0o12
                if link or p.filename.startswith("/") or "\\" in p.filename or ".." in p.filename.split("/"):
                    raise Refused("unsafe_path")
                if p.filename.lower().endswith("vbaproject.bin"):
                    raise Refused("macros")
            held = {p.filename: archive.read(p) for p in parts if not p.is_dir()}
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:
        raise Refused("not_a_package") from e
    if MAIN_PART not in held or MAIN_TYPE not in held.get("[Content_Types].xml", b""):
        raise Refused("no_document")
    if any(word in body.upper() for name, body in held.items() if name.endswith((".xml", ".rels")) for word in (b"<!DOCTYPE", b"<!ENTITY")):
        raise Refused("entities")
    return held


def _events(xml: bytes) -> Iterator[tuple[bool, str, ET.Element]]:
    """(whether it opens, name without namespace, element) for each tag."""
    try:
        for event, node in ET.iterparse(io.BytesIO(xml), ("start", "end")):
            yield event == "start", node.tag.rsplit("}", 1)[-1], node
    except ET.ParseError as e:
        raise Refused("broken_xml") from e


class _Text:
    """Collects what a reader sees while tags go by."""

    def __init__(self) -> None:
        self.pieces, self.muted = [], 0

    def take(self, opens: bool, name: str, node: ET.Element) -> None:
        if name in MUTE:
            self.muted += 1 if opens else -1
        elif not self.muted and not opens and name in ("t", "instrText"):
            self.pieces.append(node.text or "")
        elif not self.muted and opens and name in WRITTEN:
            self.pieces.append(WRITTEN[name])
        elif not self.muted and not opens and name == "p":
            self.pieces.append("\n")

    def whole(self) -> str:
        """Lines with their white space collapsed, empty ones left out."""
        lines, self.pieces = "".join(self.pieces).splitlines(), []
        return "\n".join(filter(None, (" ".join(line.split()) for line in lines)))


def _body(xml: bytes) -> Iterator[tuple]:
    """("p", text, style), ("tc", text, row, cell) or ("tbl",) as a table opens, ("other", name) for text elsewhere, ("revised",)."""
    path: list[str] = []
    seen, at, style, row, cell = _Text(), None, None, 0, 0  # at: depth of the block that is open
    for opens, name, node in _events(xml):
        if opens:
            inside = at is not None
            if not inside and path[:2] == ["document", "body"] and all(x in HOLDERS for x in path[2:]) and name not in HOLDERS:
                at, style, row = len(path), None, 0
                seen = _Text()
                if name == "tbl":
                    yield ("tbl",)
            elif inside and path[at] == "tbl" and name == "tr" and len(path) == at + 1:
                row, cell = row + 1, 0
            elif inside and path[at] == "tbl" and name == "tc" and path[at + 1 :] == ["tr"]:
                cell, seen = cell + 1, _Text()
            elif inside and name == "pStyle" and path[at:] == ["p", "pPr"] and style is None:
                style = node.get(f"{_W}val")
            if name in ("ins", "del"):
                yield ("revised",)
            path.append(name)
            seen.take(True, name, node)
            continue
        path.pop()
        seen.take(False, name, node)
        if at is None:
            continue
        if name == "tc" and path[at:] == ["tbl", "tr"]:
            yield "tc", seen.whole(), row, cell
        if len(path) == at:
            if name == "p":
                yield "p", seen.whole(), style
            elif name != "tbl" and name not in HIDDEN and seen.whole():
                yield "other", name
            at = None
            node.clear()


def _notes(xml: bytes, kind: str) -> Iterator[tuple[str, str]]:
    """(id, text) of each note; negative ids are separators."""
    depth, seen = 0, _Text()
    for opens, name, node in _events(xml):
        if opens and depth == 1 and name == kind:
            seen = _Text()
        seen.take(opens, name, node)
        depth += 1 if opens else -1
        if not opens and depth == 1 and name == kind and not (number := node.get(f"{_W}id", "")).startswith("-"):
            yield number, seen.whole()


def _styles(xml: bytes) -> dict[str, str]:
    names, style = {}, None
    for opens, name, node in _events(xml):
        if opens and name == "style":
            style = node.get(f"{_W}styleId")
        elif opens and name == "name" and style and style not in names:
            names[style] = node.get(f"{_W}val", style)
    return names


def _blocks(blob: bytes) -> tuple[list[dict], list[str]]:
    held = _unpacked(blob)
    styles = _styles(held["word/styles.xml"]) if "word/styles.xml" in held else {}
    rows, warnings, headings = [], [], []
    if any(node.get("TargetMode") == "External" for part, body in held.items() if part.endswith(".rels") for opens, name, node in _events(body) if opens and name == "Relationship"):
        warnings.append("external_links")
    warnings += [w for w, found in (("embedded_objects", any(n.startswith("word/embeddings/") for n in held)), ("comments", "word/comments.xml" in held)) if found]

    def add(block_id: str, kind: str, text: str, **where) -> None:
        if text:
            rows.append({"status": "ok", "ordinal": len(rows) + 1, "block_id": block_id, "kind": kind, "text": text, **where})

    paragraph = table = 0
    for what, *said in _body(held[MAIN_PART]):
        if what == "p":
            text, style_id = said
            paragraph, style = paragraph + 1, styles.get(style_id, style_id)
            if text and (style or "").casefold().startswith("heading"):
                level = re.search(r"\d+", style)
                headings = [*headings[: max(0, int(level[0]) - 1 if level else 0)], text]
            add(PARAGRAPH_ID.format(paragraph), "docx_paragraph", text, headings=headings, style=style, paragraph=paragraph)
        elif what == "tbl":
            table += 1
        elif what == "tc":
            text, row, cell = said
            add(CELL_ID.format(table, row, cell), "docx_table_cell", text, headings=headings, table=table, row=row, cell=cell)
        else:
            warnings.append("revisions" if what == "revised" else f"left_out:{said[0]}")
    for kind in ("footnote", "endnote"):
        for number, text in _notes(held[f"word/{kind}s.xml"], kind) if f"word/{kind}s.xml" in held else ():
            add(NOTE_ID.format(kind, number or len(rows) + 1), f"docx_{kind}", text, headings=[], note_id=number or None)
    if not rows:
        raise Refused("no_text")
    return rows, list(dict.fromkeys(warnings))


def docx_blocks(files: DataFrame, content: str, *keys: str) -> DataFrame:
    """keys and the blocks of Word files with text, as they read in the end: deleted runs left out, inserted ones kept.

    kind: docx_paragraph (with its number, style and the headings above it, itself included), docx_table_cell (table, row,
    cell; nested tables are part of their cell), docx_footnote or docx_endnote. Blocks are whole, however long; ordinals
    count from 1. ``status`` is ok; a row of status warning names in ``text`` what was left out or not followed:
    external_links, embedded_objects, comments, revisions, left_out:<element>. A file that is refused has one row whose
    status says why: empty, not_a_package, too_large, unsafe_path, macros, no_document, entities, broken_xml or no_text.
    """

    def one(blob: bytes | None) -> list[dict]:
        bare = dict.fromkeys(BLOCK.names)
        try:
            if not blob:
                raise Refused("empty")
            rows, warnings = _blocks(blob)
        except Refused as why:
            return [bare | {"status": str(why)}]
        return [bare | r for r in rows] + [bare | {"status": "warning", "text": w} for w in warnings]

    kinds = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    blocks = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in BLOCK.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PORTION):
                batch = whole.slice(at, PORTION)
                found = [one(blob) for blob in batch.column(0).to_pylist()]
                owner = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                flat = pa.RecordBatch.from_pylist([r for rows in found for r in rows], blocks)
                yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[1:]), *flat.columns], [*keys, *blocks.names])

    rows = files.select(F.col(content).alias("_content"), *keys)
    return rows.mapInArrow(run, StructType([*rows.schema.fields[1:], *BLOCK.fields]))
