"""Text of files: plain text, zipped XML documents and sheets. One Arrow batch at a time; a bad file gives an error, not a failure."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

# Bytes of plain text that are read, characters kept, cells and characters of a sheet, and extensions by reader.
PLAIN_BYTES, MOST_CHARACTERS, MOST_CELLS, SHEET_CHARACTERS = 262_144, 12_000, 500_000, 256_000
ARCHIVES = {".docx": r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$", ".pptx": r"ppt/(slides|notesSlides)/[^/]+\.xml$", ".hwpx": r"Contents/section\d+\.xml$", ".odt": r"content\.xml$", ".ods": r"content\.xml$", ".odp": r"content\.xml$"}
SHEETS = (".xlsx", ".xlsm", ".xltx", ".xltm")


def decode(raw: bytes) -> str | None:
    """By byte order mark, as strict UTF-8, else as CP949; None for binary data."""
    raw = raw[:PLAIN_BYTES]
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    head = raw[:4096]
    if b"\0" in head or sum(b < 9 or 13 < b < 32 for b in head) > len(head) * 0.1:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start >= len(raw) - 3 and len(raw) == PLAIN_BYTES:  # a letter cut in two at the end
            return raw[: e.start].decode("utf-8")
        return raw.decode("cp949", "replace")


def archive_text(raw: bytes, extension: str) -> str:
    """The text nodes of the parts that hold text, in the order of their names' numbers."""
    number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    out, size = [], 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted((n for n in z.namelist() if re.search(ARCHIVES[extension], n)), key=number):
            for _, node in ET.iterparse(z.open(name)):
                if node.text and node.text.strip():
                    out.append(node.text.strip())
                    size += len(out[-1])
                node.clear()
                if size > MOST_CHARACTERS:
                    return " ".join(out)
    return " ".join(out)


def sheet_text(raw: bytes) -> str:
    """Sheet names and distinct cell values in order of first use."""
    seen: dict[str, None] = {}
    tag = lambda n: n.tag.rpartition("}")[2]
    cells = size = 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        if "xl/workbook.xml" in names:
            for node in ET.parse(z.open("xl/workbook.xml")).iter():
                if tag(node) == "sheet" and node.get("name"):
                    seen[node.get("name")] = None
        shared = []
        if "xl/sharedStrings.xml" in names:
            for _, node in ET.iterparse(z.open("xl/sharedStrings.xml")):
                if tag(node) == "si":
                    shared.append("".join(t.text or "" for t in node.iter() if tag(t) == "t"))
                    node.clear()
        for name in sorted((n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]):
            for _, node in ET.iterparse(z.open(name)):
                if tag(node) != "c":
                    continue
                cells += 1
                value = next((c.text or "" for c in node.iter() if tag(c) in ("v", "t")), "").strip()
                if node.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)].strip()
                node.clear()
                if value and value not in seen:
                    seen[value] = None
                    size += len(value) + 1
                if cells >= MOST_CELLS or size >= SHEET_CHARACTERS:
                    return " ".join(seen)[:SHEET_CHARACTERS]
    return " ".join(seen)[:SHEET_CHARACTERS]


def extract(raw: bytes | None, extension: str) -> tuple[str | None, str | None, bool, str | None]:
    """(text, source, was truncated, error). White space is single; sheets may be longer than other texts."""
    try:
        if raw is None:
            return None, None, False, "no content"
        if extension in SHEETS:
            text, source, most = sheet_text(raw), "Spreadsheet", SHEET_CHARACTERS
        elif extension in ARCHIVES:
            text, source, most = archive_text(raw, extension), "ArchiveDocument", MOST_CHARACTERS
        else:
            text, source, most = decode(raw), "PlainText", MOST_CHARACTERS
        if text is None:
            return None, None, False, "binary"
        text = " ".join(text.split())
        return text[:most], source, len(text) > most, None
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
        return None, None, False, f"{type(e).__name__}: {e}"[:200]


def read_texts(files: DataFrame, most_bytes: int = 48 << 20) -> DataFrame:
    """files: path_key, full_path, extension, modified, size_bytes. With text, source, was_truncated, error: each file is opened
    where its row is. Larger files, and those that have gone, have an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, extension, size in zip(*(b.column(c).to_pylist() for c in ("full_path", "extension", "size_bytes")), strict=True):
                if size is not None and size > most_bytes:
                    found.append((None, None, False, "too large"))
                    continue
                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as f:
                        found.append(extract(f.read(most_bytes + 1), extension or ""))
                except OSError as e:
                    found.append((None, None, False, f"{type(e).__name__}: {e}"[:200]))
            columns = list(zip(*found, strict=True)) or [[]] * 4
            arrays = [b.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "source", "was_truncated", "error"])

    keep = ["path_key", "extension", "modified", "size_bytes"]
    return files.select(*keep, "full_path").mapInArrow(read, "path_key string, extension string, modified long, size_bytes long, text string, source string, was_truncated boolean, error string")


def extract_text(files: DataFrame) -> DataFrame:
    """files: path_key, extension, modified, size_bytes, content. With text, source, was_truncated, error, without content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [extract(c.as_py(), e.as_py() or "") for c, e in zip(b.column("content"), b.column("extension"), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            arrays = [b.column(c) for c in keep] + [pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "source", "was_truncated", "error"])

    keep = ["path_key", "extension", "modified", "size_bytes"]
    return files.select(*keep, "content").mapInArrow(read, "path_key string, extension string, modified long, size_bytes long, text string, source string, was_truncated boolean, error string")
