"""Office files as page rows: a batch data source that plans its own partitions.

``spark.read.format("office_pages").option("path", folder)`` gives (path, kind, page, title, text, problem): a row for each
page of a DOCX, each slide of a PPTX and each ``ROWS`` rows of a sheet of an XLSX, ready for the page operators of
``operators/chunking.py``. Files are listed on the driver and packed into partitions by size, largest first; tasks read
them with the standard library, part by part, and XML as it streams, so that a task holds a page (and a workbook's shared
strings). Files that can't be read, parts that are missing or over ``MOST`` bytes unpacked are rows with ``problem``; pages
before the break stay. With the option ``pushFilters`` (and spark.sql.python.filterPushdown.enabled) filters on
``kind`` and ``path`` leave out files before they are opened. The file system must be one that pyarrow opens.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

ROWS, MOST, PART_BYTES = 500, 1 << 30, 64 << 20
KINDS = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class Broken(Exception):
    pass


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Limited:
    """A part of an archive that ends with an error after ``MOST`` bytes."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        try:
            self.file, self.left, self.name = archive.open(name), MOST, name
        except KeyError:
            raise Broken(f"{name} is missing") from None

    def read(self, n: int = -1) -> bytes:
        data = self.file.read(n if n >= 0 else self.left + 1)
        self.left -= len(data)
        if self.left < 0:
            raise Broken(f"{self.name} has over {MOST} bytes")
        return data


def elements(archive: zipfile.ZipFile, name: str):
    """(event, element) of a part; what has ended and isn't part of an open paragraph or row is let go."""
    yield from ElementTree.iterparse(Limited(archive, name), ("start", "end"))


def related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relationship id -> name of the part it leads to."""
    folder, _, file = part.rpartition("/")
    out = {}
    for event, e in elements(archive, f"{folder}/_rels/{file}.rels"):
        if event == "end" and local(e.tag) == "Relationship":
            target = e.get("Target", "")
            out[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return out


def document_pages(archive: zipfile.ZipFile) -> Iterator[tuple[str | None, str]]:
    """Pages of a text document, which end at page breaks, as (title, text) with a line for each paragraph."""
    lines, now, filled = [], [], False
    for event, e in elements(archive, KINDS["docx"]):
        tag = local(e.tag)
        if event == "start":
            if tag == "lastRenderedPageBreak" or (tag == "br" and any(local(k) == "type" and v == "page" for k, v in e.attrib.items())):
                lines.append("".join(now))
                now, text = [], "\n".join(x for x in lines if x)
                lines, filled = [], True
                yield None, text
            elif tag in ("tab", "br", "cr"):
                now.append("\t" if tag == "tab" else "\n")
        elif tag == "t":
            now.append(e.text or "")
        elif tag == "p":
            lines.append("".join(now))
            now = []
            e.clear()
        elif tag == "tbl":
            e.clear()
    text = "\n".join(x for x in lines if x)
    if text or not filled:
        yield None, text


def slides(archive: zipfile.ZipFile) -> Iterator[tuple[str | None, str]]:
    """Slides in their order: the first line as title, a line for each paragraph."""
    parts = related(archive, KINDS["pptx"])
    order = [e.get(REL) for event, e in elements(archive, KINDS["pptx"]) if event == "end" and local(e.tag) == "sldId"]
    for rel in order:
        if rel not in parts:
            raise Broken(f"slide {rel} has no part")
        lines, now = [], []
        for event, e in elements(archive, parts[rel]):
            tag = local(e.tag)
            if event == "end" and tag == "t":
                now.append(e.text or "")
            elif event == "end" and tag == "p":
                lines.append("".join(now).strip())
                now = []
        lines = [x for x in lines if x]
        yield (lines[0] if lines else None), "\n".join(lines)


def column_of(reference: str | None) -> int | None:
    """The number of a cell's column, from 0."""
    letters = re.match(r"[A-Z]+", reference or "")
    if letters is None:
        return None
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out, now = [], []
    for event, e in elements(archive, "xl/sharedStrings.xml"):
        tag = local(e.tag)
        if event == "end" and tag == "t":
            now.append(e.text or "")
        elif event == "end" and tag == "rPh":  # readings of characters aren't text
            now = now[: -sum(local(x.tag) == "t" for x in e)] if len(e) else now
        elif event == "end" and tag == "si":
            out.append("".join(now))
            now = []
            e.clear()
    return out


def sheet_pages(archive: zipfile.ZipFile) -> Iterator[tuple[str | None, str]]:
    """Sheets in their order, ``ROWS`` rows a page: the sheet's name as title, cells parted by tabs."""
    parts, strings = related(archive, KINDS["xlsx"]), shared_strings(archive)
    sheets = [(e.get("name"), e.get(REL)) for event, e in elements(archive, KINDS["xlsx"]) if event == "end" and local(e.tag) == "sheet"]
    for name, rel in sheets:
        if rel not in parts:
            raise Broken(f"sheet {name} has no part")
        lines, filled = [], False
        for event, e in elements(archive, parts[rel]):
            if event != "end" or local(e.tag) != "row":
                continue
            cells: list[str] = []
            for c in e:
                at = column_of(c.get("r"))
                cells += [""] * ((at if at is not None else len(cells)) - len(cells))
                value = next((x.text or "" for x in c if local(x.tag) == "v"), "")
                if c.get("t") == "s":
                    if not value.isdigit() or int(value) >= len(strings):
                        raise Broken(f"sheet {name} has no string {value[:20]}")
                    value = strings[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(x.text or "" for x in c.iter() if local(x.tag) == "t")
                elif c.get("t") == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                cells.append(value.replace("\t", " ").replace("\n", " "))
            e.clear()
            if any(cells):
                lines.append("\t".join(cells))
            if len(lines) == ROWS:
                yield name, "\n".join(lines)
                lines, filled = [], True
        if lines or not filled:
            yield name, "\n".join(lines)


READERS = {"docx": document_pages, "pptx": slides, "xlsx": sheet_pages}


def pages_of(file, kind: str) -> Iterator[tuple[int, str | None, str | None, str | None]]:
    """(page, title, text, problem) of an office file that is open for reading."""
    page = 0
    try:
        with zipfile.ZipFile(file) as archive:
            for title, text in READERS[kind](archive):
                yield page, title, text, None
                page += 1
    except (Broken, zipfile.BadZipFile, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError, OSError, ValueError) as e:
        yield page, None, None, f"{type(e).__name__}: {e}"[:500]
    except Exception as e:  # zlib's own error has no common base
        yield page, None, None, f"{type(e).__name__}: {e}"[:500]


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class OfficeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.size = schema.fieldNames(), options["path"], int(options.get("partbytes", PART_BYTES))
        self.kinds, self.paths = set(KINDS), None

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = self._store()
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        kept = [(f.size or 0, f.path, f.extension.lower()) for f in found if f.type == fs.FileType.File and f.extension.lower() in self.kinds and (self.paths is None or f.path in self.paths)]
        parts, room = [], 0
        for size, path, kind in sorted(kept, key=lambda k: (-k[0], k[1])):
            if not parts or room < size:
                parts.append([])
                room = self.size
            parts[-1].append((path, kind))
            room -= size
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for path, kind in partition.files:
            try:
                with store.open_input_file(path) as file:
                    for page, title, text, problem in pages_of(file, kind):
                        yield self._row(path, kind, page, title, text, problem)
            except OSError as e:
                yield self._row(path, kind, 0, None, None, f"can't be opened: {e}"[:500])

    def _row(self, *values) -> tuple:
        row = dict(zip(("path", "kind", "page", "title", "text", "problem"), values, strict=True))
        return tuple(row[n] for n in self.names)


class FilteredReader(OfficeReader):
    """A reader that leaves out files by filters on kind and path."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("kind",):
                self.kinds &= values
            elif values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                yield f


class OfficePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office_pages"

    def schema(self) -> str:
        return "path string, kind string, page int, title string, text string, problem string"

    def reader(self, schema: StructType) -> OfficeReader:
        return (FilteredReader if self.options.get("pushfilters", "").lower() == "true" else OfficeReader)(schema, self.options)
