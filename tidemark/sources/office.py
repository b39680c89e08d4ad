"""A data source of documents: office files, books, pages, tables and code of a folder as rows of blocks, errors as rows too.

    spark.dataSource.register(Documents)
    spark.read.format("documents").option("path", folder).load()

Files are shared out to partitions by their sizes; a file is read and taken apart in one task. The folder may lie in any
store that Arrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.documents import html_blocks, markdown_blocks, office_blocks

SCHEMA = "path string, block_idx int, block_type string, level int, language string, rows int, cols int, text string, error string"
OFFICE = ("docx", "pptx", "xlsx", "ods", "odt", "epub")
PLAIN = ("txt", "csv", "json", "xml")
#: Languages of code files.
CODE = {"py": "python", "rs": "rust", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "cpp": "cpp", "h": "c", "rb": "ruby", "sh": "bash", "sql": "sql", "yaml": "yaml", "yml": "yaml", "toml": "toml"}
KINDS = (*OFFICE, *PLAIN, *CODE, "md", "html", "htm")
PARTITION_BYTES = 32 << 20


def blocks_of(name: str, content: bytes) -> Iterator[tuple]:
    """(type, level, language, rows, cols, text) of a file's blocks, by its extension; code is one block, as is plain text."""
    kind = name.rpartition(".")[2].lower()
    if kind in OFFICE:
        yield from office_blocks(content)
        return
    text = content.decode("utf-8", "replace")
    if kind == "md":
        yield from markdown_blocks(text)
    elif kind in ("html", "htm"):
        yield from html_blocks(text)
    elif text.strip():
        yield ("code", None, CODE[kind], None, None, text) if kind in CODE else ("text", None, None, None, None, text)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        """Files of known kinds below the folder, none hidden, in partitions of about `most` bytes."""
        system, base = fs.FileSystem.from_uri(self.folder)
        found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if f.is_file]
        named = sorted((f.path, f.size) for f in found if not f.base_name.startswith((".", "_")) and f.extension.lower() in KINDS)
        out, held = [Files([])], 0
        for path, size in named:
            if held and held + size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            k = -1
            try:
                with system.open_input_file(path) as file:
                    content = file.read()
                for k, block in enumerate(blocks_of(path, content)):
                    yield (path, k, *block, None)
            except Exception as error:  # a file of any kind of damage is a row, not the end of the job
                yield (path, k + 1, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:500])


class Documents(DataSource):
    """Options: path, a folder's URI or local path; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        folder = self.options["path"]
        return Reader(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_documents(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Blocks (see `SCHEMA`) of all files of known kinds below a folder; a file that can't be read gives a row with its error after the blocks it gave."""
    spark.dataSource.register(Documents)
    return spark.read.format("documents").option("path", folder).option("partitionBytes", str(partition_bytes)).load()
