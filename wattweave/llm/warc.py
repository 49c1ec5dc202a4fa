"""WARC archives: monolithic gzip in, one gzip member for each record out, with an index.

``write_archives`` writes pages as WARC/1.1 files, each one gzip stream over the
whole file, as many crawls come. ``normalise_archives`` inflates each such
stream once, writes every record again as a gzip member of its own, and beside
the archive a tab-separated index of the members: offset, length, record id,
type. ``read_archives`` reads records back by that index.

A task writes its files under names of its own attempt and then renames them, so
that a lost executor or a second attempt leaves no half file behind. Files go
through pyarrow's file systems to the shared folder. Memory holds an Arrow batch
of payloads (``BATCH`` rows) when writing, one record when normalising. A stream
that ends before its gzip trailer, or a record shorter than its Content-Length,
is an error.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, settings, stored

HEAD = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
EPOCH = "1970-01-01T00:00:00Z"
BLOCK = 1 << 16
#: Bytes of records after which a task begins a new archive, and rows of an Arrow batch of whole payloads.
ARCHIVE, BATCH = 1 << 28, 500


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id) -> str:
    return "urn:x-page:" + ("" if page_id is None else str(int(page_id)))


def page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rsplit(":", 1)[1]
    return int(tail) if tail else None


def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, is_revisit: bool) -> bytes:
    """One WARC record; a revisit carries no payload, but the digest and length of what it would hold."""
    block = HTTP % size + (b"" if is_revisit else payload)
    head = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<{record_id(page_id)}>"),
        ("WARC-Date", EPOCH),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(digest)}"),
        ("WARC-Payload-Length", str(size)),
    ]
    if is_revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{record_id(refers_to)}>"),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return HEAD + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to of each page.

    Pages with equal payloads of ``least`` bytes or more refer to the largest
    page_id among them; null where the page is that one, or is alone. Payloads
    are equal when their sizes, SHA-1 and SHA-256 are.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"), F.unhex(F.sha2("payload", 256)).alias("content")
    )
    shared = stored(
        full.where(F.col("size") >= least)
        .groupBy("digest", "size", "content")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "payloads",
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull()
    return full.join(shared.hint("merge"), ["digest", "size", "content"], "left").select(
        "page_id", "url", "payload", "size", "digest", F.when(other, F.col("first_id")).alias("refers_to")
    )


class _Named:
    """A file that gets its name when it is whole."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.draft = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out = fs.open_output_stream(self.draft, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def _write(root: str, archive_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _files(root)
        file = packer = None
        n = size = 0

        def close() -> pd.DataFrame:
            file.out.write(packer.flush())
            file.close()
            return pd.DataFrame({"archive": [f"{root}/{name}"], "records": [n]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if file is None:
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    file, packer, n, size = _Named(fs, f"{base}/{name}"), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                ref = None if pd.isna(row.refers_to) else row.refers_to
                page = None if pd.isna(row.page_id) else row.page_id
                raw = record(page, row.url, row.payload, row.digest, row.size, ref, ref is not None)
                file.out.write(packer.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    yield close()
                    file = None
        if file is not None:
            yield close()

    return write


def write_archives(pages: DataFrame, root: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Monolithic archives of about ``archive_bytes`` of records at most, one at least for each partition, below ``root``: archive, records.

    Names are random, and only archives in the returned table count, so a
    second attempt of a task does no harm.
    """
    with settings(pages.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        return stored(
            decide(pages).drop("content").mapInPandas(_write(root, archive_bytes), "archive string, records long"), "archives"
        )


def _records(raw: io.BufferedIOBase) -> Iterator[bytes]:
    """Records of an inflated stream, cut by their Content-Length."""
    held, done = b"", False
    while True:
        while b"\r\n\r\n" not in held and not done:
            more = raw.read(BLOCK)
            held, done = held + more, not more
        if not held.strip():
            return
        head, mark, rest = held.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length: *(\d+)", head)
        if not mark or length is None:
            raise ValueError("a record without a whole head")
        size = int(length[1])
        parts, got = [rest], len(rest)
        while got < size + 4 and not done:
            more = raw.read(max(BLOCK, size + 4 - got))
            parts.append(more)
            got, done = got + len(more), not more
        rest = b"".join(parts)
        if len(rest) < size:
            raise ValueError(f"a record of {size} bytes ends after {len(rest)}")
        yield head + b"\r\n\r\n" + rest[:size] + b"\r\n\r\n"
        held = rest[size + 4 :]


class _Inflated(io.RawIOBase):
    """A whole-file gzip stream, inflated as it is read."""

    def __init__(self, source):
        self.source, self.inflate, self.pending, self.inside = source, zlib.decompressobj(31), b"", True

    def read(self, n: int = BLOCK) -> bytes:
        while True:
            self.pending = self.pending or self.source.read(BLOCK)
            if not self.inside:
                self.pending = self.pending.lstrip(b"\0")  # padding between members
                if self.pending:
                    self.inside = True
                    continue
            if not self.pending:
                more = self.source.read(BLOCK)
                if more:
                    self.pending = more
                    continue
                if self.inside:
                    raise EOFError("a gzip stream ends before its trailer")
                return b""
            out = self.inflate.decompress(self.pending, n)
            if self.inflate.eof:  # a further member may follow
                self.pending = self.inflate.unused_data
                self.inflate, self.inside = zlib.decompressobj(31), False
            else:
                self.pending = self.inflate.unconsumed_tail
            if out:
                return out


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for archive in batch["archive"]:
            fs, path = _files(archive)
            base = path.removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}"
            members, index = _Named(fs, f"{base}.members.warc.gz"), _Named(fs, f"{base}.index.tsv")
            at = n = 0
            with fs.open_input_stream(path, compression=None) as source:
                for raw in _records(_Inflated(source)):
                    fields, _ = parse(raw)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(raw) + packer.flush()
                    members.out.write(data)
                    index.out.write(f"{at}\t{len(data)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
                    at, n = at + len(data), n + 1
            members.close()
            index.close()
            head = archive[: len(archive) - len(path)] if archive.endswith(path) else ""
            yield pd.DataFrame({"members": [f"{head}{members.path}"], "index": [f"{head}{index.path}"], "records": [n]})


def _one_each(files: DataFrame, name: str) -> DataFrame:
    """As many partitions as ``files`` has rows: a task opens a file or two."""
    return files.repartitionByRange(max(1, files.count()), name)


def normalise_archives(archives: DataFrame) -> DataFrame:
    """members, index, records for each archive; a task inflates one archive at a time."""
    return stored(_one_each(archives.select("archive"), "archive").mapInPandas(_normalise, "members string, index string, records long"), "members")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for members, index in zip(batch["members"], batch["index"], strict=True):
            fs, path = _files(members)
            with fs.open_input_stream(_files(index)[1], compression=None) as f:
                entries = [line.split("\t") for line in f.read().decode().splitlines()]
            rows = []
            with fs.open_input_file(path) as f:
                for offset, length, name, kind in entries:
                    raw = zlib.decompress(f.read_at(int(length), int(offset)), 31)
                    fields, block = parse(raw)
                    if (fields["warc-record-id"], fields["warc-type"]) != (name, kind):
                        raise ValueError(f"{index}: the member at {offset} holds another record")
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(fields["warc-payload-length"])
                    payload = None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    refers = fields.get("warc-refers-to")
                    rows.append((page_of(name), fields["warc-target-uri"], payload, size, digest, kind, None if refers is None else page_of(refers)))
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(members: DataFrame) -> DataFrame:
    """Every record of the normalised archives, found by the index; digests of responses are computed anew."""
    return _one_each(members, "members").mapInPandas(_read, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back: a record for each row of ``pages``.

    Null html is an empty payload, a null url an empty target, line ends in a
    url spaces. A null page_id is kept; it is never referred to unless every
    equal page has one, and then each is a response. Rows that share the
    referred page_id are responses all. An empty table writes no archive and
    gives no record. Other columns aren't read.
    """
    root = scratch_path(pages.sparkSession, "warc")
    return read_archives(normalise_archives(write_archives(pages, root)))
