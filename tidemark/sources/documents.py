"""Files and pages as rows: type detection, decoding, and blocks of Markdown, HTML and office files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of formats, and types of extensions.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "1F8B": "gzip", "49492A00": "tiff"}
EXTENSIONS = {"md": "markdown", "html": "html", "htm": "html", "json": "json", "csv": "csv", "xml": "xml", "txt": "text", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "epub": "epub", "py": "code", "rs": "code"}
BLOCK = "block_idx int, block_type string, level int, language string, rows int, cols int, text string"


def scan_directory(spark: SparkSession, folder: str, indexed: DataFrame | None = None, pattern: str = "*") -> DataFrame:
    """Files of a folder (path, name, content, modificationTime) whose name isn't in `indexed` (name)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named if indexed is None else named.join(indexed.select("name"), "name", "left_anti")


def snapshot(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(source, timestamp, text) of every matching file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("source"), F.col("modificationTime").alias("timestamp"), decoded(F.col("content")).alias("text"))


def content_type(content: Column, name: Column) -> Column:
    """By first bytes, then extension, then the share of bytes that no text has in the first 8 KiB."""
    head = F.hex(F.substring(content, 1, 8))
    kind = None
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    for magic, value in MAGIC.items():
        found = F.when(extension.isin("docx", "pptx", "xlsx", "epub"), extension).otherwise(value) if value == "zip" else F.lit(value)
        kind = F.when(F.startswith(head, F.lit(magic)), found) if kind is None else kind.when(F.startswith(head, F.lit(magic)), found)
    for ext, value in EXTENSIONS.items():
        kind = kind.when(extension == ext, value)
    start = F.hex(F.substring(content, 1, 8192))
    odd = F.length(F.regexp_replace(start, "(..)", "$1 ")) - F.length(F.regexp_replace(F.regexp_replace(start, "(..)", "$1 "), "(?:0[0-8BEF]|1[0-9A-F]|7F) ", ""))
    return kind.when(odd / 3 <= 0.05 * F.greatest(F.length(start) / 2, F.lit(1)), "text").otherwise("binary")


def decoded(content: Column) -> Column:
    """UTF-8 where it is valid, UTF-16 by its byte order mark, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    plain = F.when(head == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content)
    return (
        F.when(F.startswith(head, F.lit("FFFE")), F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE"))
        .when(F.startswith(head, F.lit("FEFF")), F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
        .when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def per_document(df: DataFrame, key: str, column: str, parse) -> DataFrame:
    """The blocks that `parse` finds in each value; a null has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(f.split()[0] for f in BLOCK.split(", "))]
        for b in batches:
            rows = [(k, i, *block) for k, value in zip(b[key], b[column], strict=True) if value is not None for i, block in enumerate(parse(value))]
            yield pd.DataFrame(rows, columns=names).astype({"level": "Int32", "rows": "Int32", "cols": "Int32"})

    return df.select(key, column).mapInPandas(run, f"{key} long, {BLOCK}")


def markdown_blocks(text: str) -> Iterator[tuple]:
    """(type, level, language, rows, cols, text): fenced code, headings, pipe tables (ruler rows dropped), other text."""
    held: list[str] = []
    fence, language, table = "", None, []

    def flush() -> Iterator[tuple]:
        if table:
            yield "table", None, None, len(table), table[0].strip().strip("|").count("|") + 1, "\n".join(table)
            table.clear()
        if body := "\n".join(held).strip():
            yield "text", None, None, None, None, body
        held.clear()

    for line in text.split("\n"):
        bare = line.strip()
        if fence:
            if bare.startswith(fence):
                yield "code", None, language or None, None, None, "\n".join(held)
                held.clear()
                fence = ""
            else:
                held.append(line)
        elif bare[:3] in ("```", "~~~"):
            yield from flush()
            fence, language = bare[:3], bare[3:].strip()
        elif m := re.match(r"(#{1,6}) +(.*)", bare):
            yield from flush()
            yield "heading", len(m[1]), None, None, None, m[2]
        elif bare.startswith("|"):
            if held:
                yield from flush()
            if not re.fullmatch(r"[|:\- ]+", bare):
                table.append(bare)
        else:
            if table:
                yield from flush()
            if bare:
                held.append(line)
            else:
                yield from flush()
    if fence:
        yield "code", None, language or None, None, None, "\n".join(held)
    else:
        yield from flush()


class _Html(HTMLParser):
    """Collects blocks: headings, code, tables, and runs of other text; script, style and head are left out."""

    DROPPED = ("script", "style", "head")
    BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "table", "p", "div", "li", "ul", "article", "section", "nav", "body", "br")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.text: list[str] = []
        self.dropped, self.kind = 0, "text"

    def flush(self) -> None:
        if body := " ".join("".join(self.text).split()):
            level = int(self.kind[1]) if re.fullmatch("h[1-6]", self.kind) else None
            name = "heading" if level else {"pre": "code", "code": "code", "table": "table"}.get(self.kind, "text")
            self.blocks.append((name, level, None, 0 if name == "table" else None, 0 if name == "table" else None, body))
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag in self.DROPPED:
            self.dropped += 1
        elif tag in self.BLOCKS and self.kind != "table":
            self.flush()
            self.kind = tag
        elif self.kind == "table":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in self.DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in self.BLOCKS and (self.kind != "table" or tag == "table"):
            self.flush()
            self.kind = "text"

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


def html_blocks(html: str) -> list[tuple]:
    parser = _Html()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def _texts(node: ElementTree.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}" + tag))


def office_blocks(content: bytes) -> Iterator[tuple]:
    """Blocks of a word-processing, slide, sheet or book file, by what its archive holds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            for node in ElementTree.fromstring(z.read("word/document.xml"))[0]:
                if node.tag.endswith("}tbl"):
                    rows = [" | ".join(_texts(c, "t") for c in r if c.tag.endswith("}tc")) for r in node if r.tag.endswith("}tr")]
                    yield "table", None, None, len(rows), rows[0].count(" | ") + 1 if rows else 0, "\n".join(rows)
                elif body := _texts(node, "t").strip():
                    style = next((v for n in node.iter() if n.tag.endswith("}pStyle") for k, v in n.attrib.items() if k.endswith("}val")), "")
                    m = re.match(r"Heading([1-6])|(Title)|(Subtitle)", style)
                    yield ("heading" if m else "text"), (int(m[1]) if m and m[1] else 1 if m and m[2] else 2 if m else None), None, None, None, body
        elif any(n.startswith("ppt/slides/slide") for n in names):
            for n in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
                yield from _slide(ElementTree.fromstring(z.read(n)))
        elif "xl/workbook.xml" in names:
            yield from _sheets(z, names)
        elif "content.xml" in names:
            yield "text", None, None, None, None, " ".join(" ".join(ElementTree.fromstring(z.read("content.xml")).itertext()).split())
        else:
            for n in _chapters(z, names):
                yield from html_blocks(z.read(n).decode("utf-8", "replace"))


def _all(node: ElementTree.Element, tag: str) -> list[ElementTree.Element]:
    return [n for n in node.iter() if n.tag.rpartition("}")[2] == tag]


def _slide(slide: ElementTree.Element) -> Iterator[tuple]:
    """A block for each shape with text: titles are headings, paragraphs of a shape its lines."""
    for shape in _all(slide, "sp"):
        lines = ["".join("\n" if n.tag.endswith("}br") else n.text or "" for n in p.iter() if n.tag.endswith(("}t", "}br"))) for p in _all(shape, "p")]
        if body := "\n".join(lines).strip():
            title = any(n.get("type") in ("title", "ctrTitle", "subTitle") for n in _all(shape, "ph"))
            yield ("heading", 1, None, None, None, body) if title else ("text", None, None, None, None, body)


def _sheets(z: zipfile.ZipFile, names: list[str]) -> Iterator[tuple]:
    """A table for each sheet with cells, in the workbook's order; where there are several, each under a line with its name."""
    shared = [_texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    titles = [s.get("name", "") for s in _all(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]
    for k, n in enumerate(files):
        rows = []
        for row in _all(ElementTree.fromstring(z.read(n)), "row"):
            cells = [shared[int(_texts(c, "v"))] if c.get("t") == "s" else _texts(c, "v") or _texts(c, "t") for c in row]
            if any(c.strip() for c in cells):
                rows.append("\t".join(cells))
        if rows:
            name = [f"[Sheet: {titles[k] if k < len(titles) else n}]"] if len(files) > 1 else []
            yield "table", None, None, len(rows), rows[0].count("\t") + 1, "\n".join([*name, *rows])


def _chapters(z: zipfile.ZipFile, names: list[str]) -> list[str]:
    """A book's pages in the order of its spine; in that of the archive where it has none."""
    pages = [n for n in names if n.endswith((".xhtml", ".html", ".htm"))]
    if "META-INF/container.xml" not in names:
        return pages
    root = next((n.get("full-path") for n in _all(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")), None)
    if root not in names:
        return pages
    package, base = ElementTree.fromstring(z.read(root)), root.rpartition("/")[0]
    places = {i.get("id"): posixpath.normpath(posixpath.join(base, unquote(i.get("href", "")))) for i in _all(package, "item")}
    spine = [places[i.get("idref")] for i in _all(package, "itemref") if places.get(i.get("idref")) in names]
    return spine or pages
