"""Small office files, books, tables and code of a title and lines, as an exporter would write them."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
FORMATS = ("docx", "epub", "pptx", "xlsx", "odt", "py", "csv")


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def file_of(kind: str, title: str, lines: list[str]) -> bytes:
    """A file with a title and a text of lines, in the way of its kind."""
    if kind in ("py", "csv"):
        return "\n".join([f"# {title}" if kind == "py" else title, *lines]).encode()
    title, text = escape(title), [escape(x) for x in lines]
    if kind == "docx":
        body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text)
        return zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>{title}</w:t></w:r></w:p>{body}</w:body></w:document>'})
    if kind == "epub":
        page = lambda inner: f'<html xmlns="http://www.w3.org/1999/xhtml"><body>{inner}</body></html>'
        package = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="one" href="z%20first.xhtml"/><item id="two" href="a.xhtml"/></manifest><spine><itemref idref="one"/><itemref idref="two"/></spine></package>'
        container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book/package.opf"/></rootfiles></container>'
        return zipped({"META-INF/container.xml": container, "book/package.opf": package, "book/a.xhtml": page("".join(f"<p>{x}</p>" for x in text)), "book/z first.xhtml": page(f"<h1>{title}</h1>")})
    if kind == "pptx":
        shape = lambda ph, inner: f'<p:sp><p:nvSpPr><p:nvPr><p:ph{ph}/></p:nvPr></p:nvSpPr><p:txBody>{inner}</p:txBody></p:sp>'
        line = lambda x: f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>"
        slides = (shape(' type="title"', line(title)), shape("", "".join(map(line, text))))
        return zipped({f"ppt/slides/slide{n}.xml": f"<p:sld {A}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>" for n, s in zip((2, 10), slides, strict=True)})
    if kind == "xlsx":
        cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
        sheet = lambda rows: f"<worksheet {S}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>"
        book = f'<workbook {S}><sheets><sheet name="Head"/><sheet name="Body"/></sheets></workbook>'
        return zipped({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet([cell(title)]), "xl/worksheets/sheet2.xml": sheet([cell(x) + f"<c><v>{k}</v></c>" for k, x in enumerate(text, 1)])})
    paragraphs = "".join(f'<p xmlns="urn:oasis:names:tc:opendocument:xmlns:text:1.0">{x}</p>' for x in (title, *text))
    return zipped({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<content>{paragraphs}</content>"})


def write_files(docs: DataFrame, folder: str) -> int:
    """Writes (name, kind, title, lines), a file for each row in the shared folder; returns their number.

    Each file is written under another name and then moved, so that a task tried again leaves no half of one.
    """
    where = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(where)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, kind, title, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = file_of("docx", title, lines)[:-30] if kind == "broken" else file_of(kind, title, lines)
                draft = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(data)
                system.move(draft, f"{base}/{name}.{'docx' if kind == 'broken' else kind}")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], type=pa.int64())})

    return docs.select("name", "kind", "title", "lines").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
