"""Parsers of documents: HTML, plain text, sections and chunks. They need Python; each works on Arrow batches of texts."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate, groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusmill.operators.audit import range_sections

SKIPPED = ("script", "style", "noscript", "nav", "header", "footer", "svg")
HEADINGS = ("h1", "h2", "h3", "h4")
TARGET_CHARS, MOST_CHARS, MOST_BYTES = 2500, 3000, 7500
#: Texts whose parts a worker holds at a time.
PORTION = 100


class _Sections(HTMLParser):
    """Lines of visible text, cut at headings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.sections: list[tuple[str | None, list[str]]] = [(None, [])]
        self.hidden, self.heading = 0, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.hidden += 1
        elif tag in HEADINGS and not self.hidden:
            self.heading = []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in HEADINGS and self.heading is not None:
            self.sections.append((" ".join(self.heading), []))
            self.heading = None

    def handle_data(self, data: str) -> None:
        line = " ".join(data.split())
        if line and not self.hidden:
            (self.sections[-1][1] if self.heading is None else self.heading).append(line)


def html_sections(html: str | None) -> list[tuple[str | None, str]]:
    """(heading, text) of each part of a page that has text; the part before the first heading has none."""
    parser = _Sections()
    parser.feed(html or "")
    parser.close()
    return [(h, "\n".join(lines)) for h, lines in parser.sections if lines]


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text of a page, a line per piece."""
    return pages.map(lambda p: None if p is None else "\n".join(x for h, t in html_sections(p) for x in (h, t) if x))


SECTION = StructType([StructField("ordinal", IntegerType()), StructField("heading", StringType()), StructField("text", StringType())])


def page_sections(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """A row for each headed section of a page."""

    return parts_of(pages, html, keys, SECTION, lambda p: [(i, h, t) for i, (h, t) in enumerate(html_sections(p))])


def in_portions(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType], parse: Callable[[str | None], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The other columns of each row beside every part of its last one, so many rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, PORTION):
            batch = whole.slice(at, PORTION)
            owner, parts = [], []
            for i, text in enumerate(batch.columns[-1].to_pylist()):
                found = parse(text)
                owner += [i] * len(found)
                parts += found
            columns = [pa.array([part[j] for part in parts], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(owner, pa.int64())) for c in batch.columns[:-1]), *columns], names)


def parts_of(rows: DataFrame, text: str, keys: tuple[str, ...], part: StructType, parse: Callable[[str | None], list[tuple]]) -> DataFrame:
    """keys and the fields of ``part``, a row for each part that ``parse`` finds in a text. A worker holds those of ``PORTION`` texts, not of a batch."""
    kept = rows.select(*keys)
    kinds = [pa.int32() if f.dataType == IntegerType() else pa.string() for f in part]
    names = [*kept.columns, *part.names]
    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(lambda batches: in_portions(batches, names, kinds, parse), StructType([*kept.schema, *part]))


def _pieces(text: str | None) -> Iterator[tuple[int, str]]:
    """Paragraphs with their numbers from 1; one over the limits comes in parts that no encoding makes too heavy."""
    paragraphs = filter(None, map(str.strip, (text or "").split("\n")))
    width = min(TARGET_CHARS, MOST_BYTES // 4)
    for n, paragraph in enumerate(paragraphs, 1):
        fits = len(paragraph) <= MOST_CHARS and len(paragraph.encode()) <= MOST_BYTES
        parts = [paragraph] if fits else map(str.strip, re.findall(rf"(?s).{{1,{width}}}", paragraph))
        yield from ((n, part) for part in parts if part)


def pack(text: str | None) -> list[tuple[str, int, int]]:
    """(text, first paragraph, last paragraph) of each chunk: as many pieces, joined by line ends, as stay within the targets."""

    def place(state: tuple, piece: tuple[int, str]) -> tuple:
        """The piece's chunk with the characters and bytes in it so far; a new chunk if it doesn't fit."""
        chunk, chars, octets, _ = state
        more, weight = len(piece[1]), len(piece[1].encode())
        if chunk and chars + 1 + more <= TARGET_CHARS and octets + 1 + weight <= MOST_BYTES:
            return chunk, chars + 1 + more, octets + 1 + weight, piece
        return chunk + 1, more, weight, piece

    placed = islice(accumulate(_pieces(text), place, initial=(0, 0, 0, None)), 1, None)
    out = []
    for _, members in groupby(placed, lambda s: s[0]):
        pieces = [m[3] for m in members]
        out.append(("\n".join(t for _, t in pieces), pieces[0][0], pieces[-1][0]))
    return out


def chunked(docs: DataFrame, text: str, *keys: str) -> DataFrame:
    """A row for each chunk of a text: keys, ordinal, text, paragraph_start, paragraph_end."""
    part = StructType([StructField("ordinal", IntegerType()), StructField("chunk", StringType()), StructField("paragraph_start", IntegerType()), StructField("paragraph_end", IntegerType())])
    return parts_of(docs, text, keys, part, lambda t: [(i, *chunk) for i, chunk in enumerate(pack(t), 1)])


def split_at(docs: DataFrame, text: str, header: str, *keys: str) -> DataFrame:
    """Sections that start at lines which match ``header`` (group 1: the section's name); text before the first is left out.

    Lines are exploded within the row and put together again by array functions, so nothing is shuffled.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    starts = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(header), i)), lambda i: i.isNotNull())
    spans = F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines))), lambda a, z: F.struct(a.alias("a"), (F.coalesce(z, F.size(lines)) - a).alias("n")))
    named = F.transform(F.filter(spans, lambda s: s["a"].isNotNull()), lambda s: F.struct(F.regexp_extract(F.get(lines, s["a"]), header, 1).alias("section"), F.array_join(F.slice(lines, s["a"] + 1, s["n"]), "\n").alias("body")))
    return docs.select(*keys, F.posexplode(named).alias("ordinal", "s")).select(*keys, "ordinal", "s.section", "s.body")


def best_section(sections: DataFrame, *keys: str) -> DataFrame:
    """Of sections with one name the best: fewest contents lines, most full stops in the first line, longest text."""
    lines = F.split("body", "\n")
    contents = F.size(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x.rlike(r"^\d+(?:-[A-Za-z]+|[A-Za-z])?\.\s+\S+")))
    stops = F.length(lines[0]) - F.length(F.replace(lines[0], F.lit("."), F.lit("")))
    quality = F.struct(-contents, stops, F.length("body"), -F.col("ordinal"))
    return sections.groupBy(*keys, "section").agg(F.max_by("body", quality).alias("body"), F.min("ordinal").alias("ordinal"))


def hash_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic bag-of-words vector of length 1, for tests without a model; a text without words has zeros.

    The first byte of a word's hash names its slot, the next two its weight.
    """

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}

        def one(value: str | None) -> list[float] | None:
            if value is None:
                return None
            out = np.zeros(dimension)
            for word in value.lower().split():
                if word not in known:
                    slot, high, low = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()[:3]
                    known[word] = (slot % dimension, (high * 256 + low) / 65535 + 0.01)
                out[known[word][0]] += known[word][1]
            norm = np.linalg.norm(out)
            return (out / norm if norm else out).tolist()

        return texts.map(one)

    return embed(text)


@F.pandas_udf(ArrayType(DoubleType()))
def decode_vector(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats -> numbers; null for a blob of broken length or with values that aren't finite."""

    def one(blob: bytes | None) -> list[float] | None:
        if blob is None or len(blob) % 4:
            return None
        v = np.frombuffer(blob, dtype="<f4").astype(float)
        return v.tolist() if np.isfinite(v).all() else None

    return blobs.map(one)


def checked_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """``rows`` with vector and fault: what is stored as bytes, decoded, or why it can't be used. All but decoding is done on the bytes.

    ``rows``: vector_bytes, dimension, dtype, normalized, checksum and more. Faults: not_normalized, dtype, dimension,
    checksum, not_finite.
    """
    fault = (
        F.when(~F.coalesce("normalized", F.lit(False)), "not_normalized")
        .when(~F.col("dtype").eqNullSafe("float32-le"), "dtype")
        .when((F.col("dimension") != dimension) | (F.coalesce(F.length("vector_bytes"), F.lit(-1)) != 4 * dimension), "dimension")
        .when(~F.sha2("vector_bytes", 256).eqNullSafe(F.col("checksum")), "checksum")
    )
    found = rows.withColumn("fault", fault).withColumn("vector", decode_vector(F.when(F.col("fault").isNull(), F.col("vector_bytes"))))
    return found.withColumn("fault", F.when(F.col("fault").isNull() & F.col("vector").isNull(), "not_finite").otherwise(F.col("fault")))


@F.pandas_udf(BinaryType())
def encode_vector(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def xml_sections(archives: DataFrame, content: str, *keys: str) -> DataFrame:
    """Sections of the XML members of ZIP archives: LEVEL elements of style Section, their heading and paragraphs.

    ``status`` is ok for each of them. What can't be read has one row without text, whose status says why: empty,
    not_a_package or too_large for an archive, broken_member or broken_xml for one of its members.
    """
    kind = ArrayType(StructType([StructField(n, StringType()) for n in ("status", "member", "heading", "text")]))

    def refused(why: str, member: str | None = None) -> dict:
        return {"status": why, "member": member, "heading": None, "text": None}

    def member(archive: zipfile.ZipFile, name: str) -> list[dict]:
        try:
            body = ET.fromstring(archive.read(name))
        except ET.ParseError:
            return [refused("broken_xml", name)]
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            return [refused("broken_member", name)]
        out = []
        for level in body.iter("LEVEL"):
            if level.get("style-name") == "Section":
                heading = " ".join(" ".join(h.itertext()) for h in level.iter("HEADING"))
                paragraphs = [" ".join("".join(p.itertext()).split()) for p in level.iter("PARA")]
                out.append({"status": "ok", "member": name, "heading": " ".join(heading.split()), "text": "\n".join(p for p in paragraphs if p)})
        return out

    def one(blob: bytes | None) -> list[dict]:
        if not blob:
            return [refused("empty")]
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                if sum(i.file_size for i in archive.infolist()) > INFLATION * max(len(blob), SMALL_PACKAGE):
                    return [refused("too_large")]
                return [row for name in sorted(n for n in archive.namelist() if n.lower().endswith(".xml")) for row in member(archive, name)]
        except zipfile.BadZipFile:
            return [refused("not_a_package")]

    @F.pandas_udf(kind)
    def parse(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return archives.select(*keys, F.inline(parse(F.col(content))))


def archive_range(archives: DataFrame, content: str, first: str, last: str) -> DataFrame:
    """Sections of the XML in archives whose number lies between two numbers, both included: citation, title, text, in order.

    A heading reads like "§ 26-501 Title."; of sections with one number the longest text stays, and broken XML gives none.
    """
    rows = xml_sections(archives, content).filter("status = 'ok'")
    number = F.regexp_extract("heading", r"(\d+-\d+(?:\.\d+)*)", 1)
    title = F.regexp_replace("heading", r"^.*?\d+-\d+(?:\.\d+)*\s*", "")
    named = rows.filter(number != "").select(number.alias("citation"), title.alias("title"), "text", F.monotonically_increasing_id().alias("place"))
    return range_sections(named, first, last).select("citation", "title", "text")


def batches_by_budget(rows: DataFrame, text: str, most_rows: int, most_chars: int) -> DataFrame:
    """Rows numbered by greedy batches within each partition: at most so many rows and, unless alone, characters."""
    schema = StructType([*rows.schema.fields, StructField("batch", IntegerType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = n = chars = 0
        for frame in frames:
            ids = []
            for size in frame[text].fillna("").str.len():
                if n and (n >= most_rows or chars + size > most_chars):
                    batch, n, chars = batch + 1, 0, 0
                n, chars = n + 1, chars + size
                ids.append(batch)
            yield frame.assign(batch=pd.Series(ids, index=frame.index, dtype="int32"))

    return rows.mapInPandas(run, schema)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


#: A package whose parts add up to more than so many times its size, or this size if it is smaller, is refused.
INFLATION, SMALL_PACKAGE = 200, 1 << 16


def docx_paragraphs(files: DataFrame, content: str, *keys: str) -> DataFrame:
    """Paragraphs of Word files as they read in the end: deleted runs left out, inserted ones kept; with their style.

    ``status`` is ok for each of them. A file that is refused has one row without text, whose status says why: empty,
    not_a_package, too_large, no_document or broken_xml; one without paragraphs has a row with no_text.
    """
    kind = ArrayType(StructType([StructField("status", StringType()), StructField("ordinal", IntegerType()), StructField("style", StringType()), StructField("text", StringType())]))

    def refused(why: str) -> list[dict]:
        return [{"status": why, "ordinal": None, "style": None, "text": None}]

    def one(blob: bytes | None) -> list[dict]:
        if not blob:
            return refused("empty")
        try:
            with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                if sum(i.file_size for i in archive.infolist()) > INFLATION * max(len(blob), SMALL_PACKAGE):
                    return refused("too_large")
                body = ET.fromstring(archive.read("word/document.xml"))
        except zipfile.BadZipFile:
            return refused("not_a_package")
        except KeyError:
            return refused("no_document")
        except ET.ParseError:
            return refused("broken_xml")
        out = []
        for p in body.iter(f"{_W}p"):
            gone = {id(t) for d in p.iter(f"{_W}del") for t in d.iter()}
            style = p.find(f"{_W}pPr/{_W}pStyle")
            text = "".join(t.text or "" for t in p.iter(f"{_W}t") if id(t) not in gone).strip()
            if text:
                out.append({"status": "ok", "ordinal": len(out), "style": None if style is None else style.get(f"{_W}val"), "text": text})
        return out or refused("no_text")

    @F.pandas_udf(kind)
    def parse(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return files.select(*keys, F.inline(parse(F.col(content))))
