"""WARC archives: writing, gzip normalisation with an offset index, and reading back.

Archives as they come are often one gzip stream over the whole file, which can't be
entered in the middle.  The normaliser inflates such a stream once, in bounded memory,
rewrites every record as a gzip member of its own, and writes a sidecar index of the
members' offsets next to the file.  With the index any record is one seek away.
Files lie in a folder that all executors share; Spark deals out pages, archives and
index rows, and every task handles one archive at a time as a stream.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder
from ..sources.staging import stage

EOL = b"\r\n"
GZIP = 16 + zlib.MAX_WBITS
CHUNK = 1 << 20
ARCHIVE_BYTES = 64 << 20
# Names of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# ------------------------------------------------------------------ files


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a shared folder, local or remote."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    parts = urlsplit(uri)
    if parts.scheme == "file":
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_file(store: fs.FileSystem, path: str, fill: Callable) -> None:
    """Write under a name of this attempt's own, then move it into place."""
    context = TaskContext.get()
    attempt = f"{path}.{context.taskAttemptId() if context else os.getpid()}"
    with store.open_output_stream(attempt, compression=None) as out:
        fill(out)
    store.move(attempt, path)


# ------------------------------------------------------------------ records


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record(kind: str, key: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One uncompressed record.  A revisit holds the head only; its digest and length are
    those of the payload it stands for."""
    body = HTTP_HEAD + (payload if kind == "response" else b"")
    head = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{key}>", "WARC-Date": date, "WARC-Target-URI": _line(uri),
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload)),
    }
    if kind == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE}
        if refers_to is not None:
            head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items()), b""]
    return EOL.join(lines) + EOL + body + EOL + EOL


def parse_head(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    version, *lines = raw.split(EOL)
    if not version.startswith(b"WARC/"):
        raise ValueError(f"no record starts here: {version[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip stream of one or more members, in pieces of bounded size."""
    engine = zlib.decompressobj(GZIP)
    for chunk in chunks:
        while chunk:
            if engine.eof:
                chunk = chunk.lstrip(b"\0")  # padding between members
                if not chunk:
                    break
                engine = zlib.decompressobj(GZIP)
            yield engine.decompress(chunk, CHUNK)
            chunk = engine.unused_data if engine.eof else engine.unconsumed_tail
    while not engine.eof and (more := engine.flush(CHUNK)):
        yield more
    if not engine.eof:
        raise EOFError("the gzip stream ends early")


def split_records(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytearray]]:
    """``(header fields, raw header, body)`` of each record of an uncompressed stream.

    A page's bytes are gathered once, so memory is bounded by the longest record.
    """
    buffer = bytearray()

    def more() -> bool:
        piece = next(data, None)
        if piece is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        while buffer[:2] == EOL:
            del buffer[:2]
        if len(buffer) < 2:
            if more():
                continue
            if buffer:
                raise EOFError("the archive ends within a record")
            return
        while (stop := buffer.find(EOL + EOL)) < 0:
            if not more():
                raise EOFError("the archive ends within a header")
        raw = bytes(buffer[: stop + 4])
        fields = parse_head(raw[:-4])
        size = int(fields["content-length"])
        while len(buffer) < len(raw) + size:
            if not more():
                raise EOFError("the archive ends within a record")
        body = buffer[len(raw) : len(raw) + size]
        del buffer[: len(raw) + size]
        yield fields, raw, body


def chunks_of(stream) -> Iterator[bytes]:
    while data := stream.read(CHUNK):
        yield data


# ------------------------------------------------------------------ jobs


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``_role`` and ``_refers``: of equal payloads of at least ``min_bytes`` bytes the one
    with the smallest ``page_id`` is the response and others revisit it.

    Null ids come last.  Rows that repeat a payload and its smallest id are told apart by
    address; the first is the response.  Which payloads are equal is settled on digests:
    minima are partial aggregates, and no window runs over a group of copies.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.withColumn("_digest", F.sha1(payload)).withColumn("_size", F.length(payload))
    least = keyed.filter(F.col("_size") >= min_bytes).groupBy("_digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_copies"),
        # how often the smallest id, and a missing id, occur
        F.min(F.struct(F.col("page_id").isNull(), "page_id", F.coalesce("url", F.lit("")))).alias("_least"),
    )
    copied = stage(least.filter("_copies > 1").select("_digest", "_first", "_least"), "warc-copies")
    rows = keyed.join(copied, "_digest", "left")
    here = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.coalesce("url", F.lit("")))
    leads = F.col("_least").isNull() | here.eqNullSafe(F.col("_least"))
    rows = rows.withColumn("_leads", leads)
    # exact repeats of a leading row: rare, and the only rows that are numbered
    twins = stage(
        rows.filter("_least IS NOT NULL AND _leads").groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("_digest"), "warc-twins",
    )
    if not twins.isEmpty():
        marked = rows.join(twins.withColumn("_twin", F.lit(True)), "_digest", "left")
        again = F.row_number().over(Window.partitionBy("_digest", "page_id", "url").orderBy(F.lit(0))) > 1
        split = marked.filter("_twin AND _leads").withColumn("_leads", ~again)
        rows = marked.filter("_twin IS NULL OR NOT _leads").unionByName(split).drop("_twin")
    return (
        rows.withColumn("_role", F.when(F.col("_leads"), "response").otherwise("revisit"))
        .withColumn("_refers", F.when(~F.col("_leads"), F.col("_first")))
        .drop("_digest", "_size", "_first", "_least", "_leads")
    )


def write_monolithic(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``page_id, url, html, _role, _refers`` as archives that are one gzip stream each;
    one row ``(archive, records)`` per file."""

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        rows = ((r for frame in it for r in frame.itertuples(index=False, name=None)))
        number, pending = 0, next(rows, None)
        while pending is not None:
            name = f"pages-{context.partitionId():06d}-{context.taskAttemptId():08d}-{number:04d}.warc.gz"
            count = 0

            def fill(out):
                nonlocal pending, count
                engine, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
                while pending is not None and size < ARCHIVE_BYTES:
                    key, url, html, role, refers = pending
                    payload = (html or "").encode()
                    raw = record(role, "" if pd.isna(key) else str(int(key)), url or "", payload, payload_digest(payload),
                                 None if pd.isna(refers) else str(int(refers)), date)
                    out.write(engine.compress(raw))
                    size += len(raw)
                    count += 1
                    pending = next(rows, None)
                out.write(engine.flush())

            write_file(store, f"{root}/{name}", fill)
            yield pd.DataFrame({"archive": [name], "records": [count]})
            number += 1

    source = pages.select("page_id", "url", "html", "_role", "_refers")
    return stage(source.mapInPandas(write, "archive string, records long"), "warc-written")


INDEX = "archive string, offset long, size long, record_type string, record_id string, target_uri string"


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite each of ``archives(archive)`` in ``source`` with one gzip member per record in
    ``target``, beside a sidecar ``<archive>.idx`` of JSON lines; returns the index rows."""

    def rewrite(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (store, root), (_, goal) = open_store(source), open_store(target)
        store.create_dir(goal, recursive=True)
        for frame in it:
            for name in frame["archive"]:
                rows: list[tuple] = []

                def fill(out):
                    at = 0
                    with store.open_input_stream(f"{root}/{name}", compression=None) as raw:  # noqa: B023
                        for fields, head, body in split_records(inflate(chunks_of(raw))):
                            engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                            member = b"".join([engine.compress(head), engine.compress(body), engine.compress(EOL + EOL), engine.flush()])
                            out.write(member)
                            rows.append((name, at, len(member), fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri")))  # noqa: B023
                            at += len(member)

                write_file(store, f"{goal}/{name}", fill)
                index = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                lines = "".join(json.dumps(r) + "\n" for r in index.to_dict("records"))
                write_file(store, f"{goal}/{name}.idx", lambda out: out.write(lines.encode()))  # noqa: B023
                yield index

    parts = max(1, archives.count())
    one_each = archives.select("archive").repartitionByRange(min(parts, 100_000), "archive")
    return stage(one_each.mapInPandas(rewrite, INDEX), "warc-index")


RECORDS = "page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"


def _key(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Read every indexed record by its offset and check it: the digest of a response is
    recomputed from its payload.  Rows of an archive are read in file order."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        name, source = None, None
        for frame in it:
            made = []
            for archive, offset, size in zip(frame["archive"], frame["offset"], frame["size"], strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{root}/{archive}")
                source.seek(int(offset))
                (fields, _, body), = split_records(inflate(iter([source.read(int(size))])))
                payload = bytes(body[body.find(EOL + EOL) + 4 :])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                length = int(fields["x-payload-length"])
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != length):
                    raise ValueError(f"{archive} at {offset}: the payload is not the one that was written")
                made.append((_key(fields["warc-record-id"]), kind, _key(fields.get("warc-refers-to")), fields["warc-target-uri"],
                             length, digest, payload if payloads and kind == "response" else None))
            out = pd.DataFrame(made, columns=[c.split()[0] for c in RECORDS.split(", ")])
            yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return index.select("archive", "offset", "size").sortWithinPartitions("archive", "offset").mapInPandas(read, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write ``pages`` as archives, normalise them, and return their index and its folder.

    A null ``html`` is an empty payload, a null ``url`` an empty address, a null ``page_id`` an
    empty key that reads back as null.  Repeated rows are records of their own.  An
    empty table writes no archive.  Other columns are not archived.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = revisits(pages.select("page_id", "url", "html"), min_bytes)
    written = write_monolithic(rows, f"{folder}/whole")
    return normalise(written, f"{folder}/whole", f"{folder}/members"), f"{folder}/members"


def digests(index: DataFrame, folder: str) -> DataFrame:
    """What each record says of its payload, read back from the archives."""
    return read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )

