"""Folders of files as Spark data sources: raw pages beside their manifest, and markdown with front matter, in batch and as streams.

    spark.dataSource.register(PageFolder)
    spark.read.format("attesta_pages").option("only", '{"page_id": [7, 9]}').load(folder)
    spark.readStream.format("attesta_markdown").load(folder)

A page folder has ``manifest.jsonl``, a line for each page (page_id, url, file, sha256 and what else was noted), and the files it names.  The
manifest is read first, and only the files of the rows that ``only`` leaves are opened.  (Filters that Spark itself pushes into a Python source
stay with its reader for later actions on the same DataFrame, which then miss rows; measured on 4.1.2.  So the choice is an option.)  A manifest
grows at its end: a stream's offset is the number of its lines.  A markdown folder's rows come from its files in the order of their names; its stream's
offset is the last name read, so new files are named behind the old ones, as with dates or running numbers.

Folders may lie wherever pyarrow's file systems reach; every executor opens its own files.  A file that the manifest names and the folder lacks fails
the job, and so does one whose bytes have another hash than the manifest says.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Files of one partition.
FILES = 64


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _read(folder: str, name: str) -> bytes:
    system, root = _fs(folder)
    with system.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
        return f.read()


@dataclass
class Files(InputPartition):
    """Some rows to make, each with the file it comes from."""

    rows: list[dict]

    def __post_init__(self):
        super().__init__(None)


def _dealt(rows: list[dict]) -> list[InputPartition]:
    return [Files(rows[i : i + FILES]) for i in range(0, len(rows), FILES)] or [Files([])]


class _Chosen:
    """What the option ``only`` leaves: a JSON object of columns that are known before a file is opened, and their values."""

    known: tuple[str, ...] = ()

    def __init__(self, options: dict):
        self.folder, self.only = options["path"], json.loads(options.get("only", "{}"))
        if other := set(self.only) - set(self.known):
            raise ValueError(f"not known before a file is opened: {sorted(other)}")

    def holds(self, row: dict) -> bool:
        return all(row.get(c) in values for c, values in self.only.items())


def manifest_rows(folder: str, start: int = 0, end: int | None = None) -> list[dict]:
    """The manifest's whole lines from ``start``; a last line without its end is still being written."""
    lines = _read(folder, "manifest.jsonl").decode().split("\n")[:-1]
    return [json.loads(x) for x in lines[start:end]]


class _Pages(_Chosen):
    known = ("page_id", "url", "file", "sha256")

    def read(self, partition: Files) -> Iterator[tuple]:
        for r in partition.rows:
            raw = _read(self.folder, r["file"])
            if r.get("sha256") and hashlib.sha256(raw).hexdigest() != r["sha256"]:
                raise ValueError(f"{r['file']} is not what the manifest says")
            yield (r.get("page_id"), r.get("url"), r["file"], r.get("sha256"), raw.decode("utf-8", "replace"))


class _PageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt([r for r in manifest_rows(self.folder) if self.holds(r)])


class _PageStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"lines": 0}

    def latestOffset(self) -> dict:
        return {"lines": len(manifest_rows(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt([r for r in manifest_rows(self.folder, start["lines"], end["lines"]) if self.holds(r)])

    def commit(self, end: dict) -> None:
        pass


class PageFolder(DataSource):
    """page_id, url, file, sha256 and html of the pages of a folder with a manifest."""

    @classmethod
    def name(cls) -> str:
        return "attesta_pages"

    def schema(self) -> str:
        return "page_id long, url string, file string, sha256 string, html string"

    def reader(self, schema):
        return _PageReader(self.options)

    def streamReader(self, schema):
        return _PageStream(self.options)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """(keys and values, body) of markdown that begins with a block between ``---`` lines; without one, nothing and the text."""
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, text
    for i, line in enumerate(lines[1:], 1):
        if line.rstrip() == "---":
            pairs = (x.split(":", 1) for x in lines[1:i] if ":" in x and not x.startswith((" ", "#")))
            return {k.strip(): v.strip().strip('"') for k, v in pairs}, "\n".join(lines[i + 1 :]).lstrip("\n")
    return {}, text


def markdown_files(folder: str) -> list[str]:
    from pyarrow import fs

    system, root = _fs(folder)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(".md"))


class _Markdown(_Chosen):
    known = ("file",)

    def read(self, partition: Files) -> Iterator[tuple]:
        for r in partition.rows:
            meta, body = front_matter(_read(self.folder, r["file"]).decode("utf-8", "replace"))
            yield (r["file"], meta, body)


class _MarkdownReader(_Markdown, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return _dealt([r for f in markdown_files(self.folder) if self.holds(r := {"file": f})])


class _MarkdownStream(_Markdown, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(markdown_files(self.folder), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt([r for f in markdown_files(self.folder) if start["last"] < f <= end["last"] and self.holds(r := {"file": f})])

    def commit(self, end: dict) -> None:
        pass


class MarkdownFolder(DataSource):
    """file, meta (the front matter) and body of the markdown files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "attesta_markdown"

    def schema(self) -> str:
        return "file string, meta map<string,string>, body string"

    def reader(self, schema):
        return _MarkdownReader(self.options)

    def streamReader(self, schema):
        return _MarkdownStream(self.options)
