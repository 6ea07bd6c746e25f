"""Members of zip archives as a data source: one partition per member, read as a stream.

The planner reads each archive's directory only.  A task opens one member and gives its
records in bounded batches: the cells of tab-separated lines, or the text of each element
of a name.  Neither an archive nor a member is ever held as a whole; memory is bounded by
a batch, or by one record.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 22
CHUNK = 1 << 20


def opened(path: str):
    """A seekable stream of a file on any store that the executors reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    if "://" not in path:
        return open(path, "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


@dataclass
class Member(InputPartition):
    path: str
    name: str


def lines(stream, columns: list[str]) -> Iterator[list[str | None]]:
    """Cells of the named columns, found by the member's own header line; a column it lacks is
    None, and lines shorter than the header are left out."""
    rows = (x.rstrip("\r\n").split("\t") for x in io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace"))
    header = next(rows, [])
    at = [header.index(n) if n in header else None for n in columns]
    return ([None if i is None else x[i] for i in at] for x in rows if len(x) >= len(header))


def elements(stream, tag: str) -> Iterator[str]:
    """Text of every element ``tag``, its own tags included; elements of that name do not nest.  One
    that is cut off by the end of the stream is left out."""
    begin = re.compile(rb"<" + re.escape(tag.encode()) + rb"(?=[\s>/])")
    end = re.compile(rb"</" + re.escape(tag.encode()) + rb"\s*>")
    longest, held, inside, first, seen = len(tag) + 64, b"", False, 0, 0
    while True:
        m = (end if inside else begin).search(held, seen)
        if m is None:
            chunk = stream.read(CHUNK)
            if not chunk:
                return
            # a tag may lie across two chunks; what is done with goes once a chunk, not once an element
            seen = max(first, len(held) - longest)
            first = first if inside else seen
            held, seen, first = held[first:] + chunk, seen - first, 0
        elif inside:
            yield held[first : m.end()].decode("utf-8", "replace")
            inside, first, seen = False, m.end(), m.end()
        else:
            inside, first, seen = True, m.start(), m.start()


class MemberReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.pattern = re.compile(options["members"])
        self.columns = json.loads(options.get("columns", "{}"))
        self.tag = options.get("tag")

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            with opened(path) as fh, zipfile.ZipFile(fh) as z:
                found += [Member(path, n) for n in z.namelist() if self.pattern.fullmatch(n.rsplit("/", 1)[-1])]
        return found

    def read(self, part: Member) -> Iterator[pa.RecordBatch]:
        base = part.name.rsplit("/", 1)[-1]
        with opened(part.path) as fh, zipfile.ZipFile(fh) as z, z.open(part.name) as raw:
            stream = gzip.GzipFile(fileobj=io.BufferedReader(raw)) if part.name.endswith(".gz") else raw
            if self.tag:
                yield from self._batches(part, base, ((None, e) for e in elements(stream, self.tag)))
            else:
                yield from self._batches(part, base, ((c, None) for c in lines(stream, self.columns[base])))

    def _batches(self, part: Member, base: str, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        while True:
            held, size = [], 0
            for record in islice(records, BATCH_ROWS):
                held.append(record)
                size += sum(map(len, filter(None, record[0]))) if record[0] else len(record[1] or "")
                if size > BATCH_CHARS:
                    break
            if not held:
                return
            columns = [[part.path] * len(held), [base] * len(held), [c for c, _ in held], [e for _, e in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["path", "member", "cells", "element"])


class ArchiveMembers(DataSource):
    """Options: ``paths`` (JSON list), ``members`` (pattern of base names), and either ``columns``
    (JSON, base name to column names) or ``tag``."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "path string, member string, cells array<string>, element string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))
