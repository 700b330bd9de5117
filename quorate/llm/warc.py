"""WARC archives as a chunked record table: written, and read back, without whole records in memory."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.llm.common import scratch_path, settle

_MANIFEST = "path string, records long, bytes long"
_CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk_no long, offset long, length long, digest_so_far string, last boolean"
_BLOCK = 1 << 16


def record_plan(pages: DataFrame, least_bytes: int = 0, most_sent: int = 500_000) -> DataFrame:
    """Pages with the record each becomes: of those with equal payloads of at least ``least_bytes``
    bytes the one with the largest page_id is a response and the others are revisits of it. Returns
    page_id, url, record_type, refers_to, sha1, size, payload (null for a revisit).

    Only digests that repeat are joined, and only with page ids, so revisits are found without their
    payloads, and a payload that fills a third of the table is pre-aggregated to one row. Responses
    are the pages that are no revisits: where these are ``most_sent`` at most, of 28 bytes each, they are
    sent to the tasks and no payload moves; else a merge join, whose skewed partitions adaptive
    execution splits, moves each payload once."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    paid = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    paid = paid.select("page_id", "url", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"), "payload")
    keys = paid.select("page_id", "url", "sha1", "size")
    heads = keys.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    heads = settle(heads.where("n > 1 and head is not null").select("sha1", "size", "head"), "warc-heads")
    revisits = keys.join(heads.hint("merge"), ["sha1", "size"]).where(~F.col("page_id").eqNullSafe(F.col("head")))
    revisits = settle(revisits.select("page_id", "url", F.lit("revisit").alias("record_type"), F.col("head").alias("refers_to"), "sha1", "size"), "warc-revisits")
    drop = revisits.select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"))
    drop = F.broadcast(drop) if revisits.count() <= most_sent else drop.hint("merge")
    responses = paid.join(drop, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left_anti")
    responses = responses.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "sha1", "size", "payload")
    return responses.unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


class _Writer:
    """Writes records to an archive, a gzip member each, from their chunks in order."""

    def __init__(self, path: str) -> None:
        self.path, self.records, self.bytes, self._out, self._squeeze = path, 0, 0, None, None

    def chunk(self, row: dict, data: memoryview | None) -> None:
        if row["chunk_no"] == 0:
            self._begin(row)
        if data is not None:
            self._put(data)
        if row["last"]:
            self._put(b"\r\n\r\n")
            self.bytes += self._out.write(self._squeeze.flush())
            self.records += 1

    def _put(self, data) -> None:
        self.bytes += self._out.write(self._squeeze.compress(data))

    def _begin(self, row: dict) -> None:
        self._out = self._out or _opened(self.path)
        self._squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
        lines = [
            "WARC/1.1",
            f"WARC-Type: {row['record_type']}",
            f"WARC-Record-ID: {_record_id(row['page_id'])}",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(row['sha1']).decode()}",
            "Content-Type: text/html; charset=utf-8",
        ]
        if row["url"] is not None:
            lines.append("WARC-Target-URI: " + row["url"].encode("unicode_escape").decode())
        if row["refers_to"] is not None:
            lines += [f"WARC-Refers-To: {_record_id(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines.append(f"Content-Length: {row['size'] if row['record_type'] == 'response' else 0}")
        self._put(("\r\n".join(lines) + "\r\n\r\n").encode())

    def close(self) -> None:
        if self._out is not None:
            self._out.close()


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _opened(path: str):
    store, at = _at(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at)


def chunked(records: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The chunked record table to be written: a row for each (record, chunk number), cut before any of
    it goes to Python. A record's chunks follow each other in one task; a revisit has one, without
    data."""
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1), lambda i: F.struct((i + 1 == F.coalesce(n, F.lit(1))).alias("last"), F.substring(F.col("payload"), i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")))
    fixed = ["page_id", "url", "record_type", "refers_to", "sha1", "size"]
    return records.select(*fixed, F.posexplode(pieces).alias("chunk_no", "piece")).select(*fixed, "chunk_no", "piece.last", "piece.data")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write a .warc.gz for each task to a shared folder; return the written table of their paths.

    Payloads come in chunks and are written as they come, so no task holds a whole record in Python. A
    task that is run again writes another file; only files of finished tasks are in the table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        for batch in batches:
            plain = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(plain, batch.column("data")):
                out.chunk(row, memoryview(data.as_buffer()) if data.is_valid else None)
        out.close()
        if out.records:
            yield pa.RecordBatch.from_pydict({"path": [out.path], "records": [out.records], "bytes": [out.bytes]})

    return settle(chunked(records).mapInArrow(write, _MANIFEST), "warc-manifest")


class _Members:
    """Reads the inflated bytes of a gzip file with many members, block by block."""

    def __init__(self, source) -> None:
        self._source, self._raw, self._inflate, self._ready, self._ended = source, b"", zlib.decompressobj(31), b"", False

    def _fill(self) -> bool:
        while not self._ended:
            if not self._raw:
                self._raw = self._source.read(_BLOCK)
                if not self._raw:
                    self._ended = True
                    break
            more = self._inflate.decompress(self._raw, _BLOCK)
            if self._inflate.eof:
                self._raw, self._inflate = self._inflate.unused_data, zlib.decompressobj(31)
            else:
                self._raw = self._inflate.unconsumed_tail
            if more:
                self._ready += more
                return True
        return False

    def headers(self) -> dict[str, str] | None:
        """Those of the next record; None at the end."""
        while b"\r\n\r\n" not in self._ready or self._ready.startswith(b"\r\n"):
            if self._ready.startswith(b"\r\n"):  # what ended the record before
                self._ready = self._ready[2:]
            elif not self._fill():
                if self._ready:
                    raise ValueError("the archive ends within a header")
                return None
        head, _, self._ready = self._ready.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}

    def blocks(self, length: int, most: int) -> Iterator[bytes]:
        """The next ``length`` bytes, in chunks of ``most``."""
        while length:
            want = min(length, most)
            while len(self._ready) < want:
                if not self._fill():
                    raise ValueError("the archive ends within a record")
            chunk, self._ready = self._ready[:want], self._ready[want:]
            length -= want
            yield chunk


def read_chunks(manifest: DataFrame, chunk_bytes: int = 1 << 20, with_data: bool = False) -> DataFrame:
    """The chunked record table: a row for each (record, chunk number), at least one for a record,
    with the digest of the payload up to the end of the chunk. ``with_data`` adds the bytes; joined
    in the order of chunk_no they are the payload. No more than one chunk is held at a time."""
    names = [c.split()[0] for c in _CHUNKS.split(", ")]
    schema = _CHUNKS + (", data binary" if with_data else "")

    def page(value: str | None) -> int | None:
        number = (value or "").removeprefix("<urn:page:").rstrip(">")
        return int(number) if number and number != "none" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path in (p.as_py() for batch in batches for p in batch.column("path")):
            store, at = _at(path)
            with store.open_input_stream(at) as source:
                members = _Members(source)
                while (head := members.headers()) is not None:
                    url = head.get("warc-target-uri")
                    fixed = (page(head["warc-record-id"]), url and url.encode().decode("unicode_escape"), head["warc-type"], page(head.get("warc-refers-to")))
                    length, digest, offset, number = int(head["content-length"]), hashlib.sha1(), 0, 0
                    stated = head["warc-payload-digest"].removeprefix("sha1:")
                    if not length:
                        rows.append((*fixed, 0, 0, 0, stated, True, *([b""] if with_data else [])))
                    for chunk in members.blocks(length, chunk_bytes):
                        digest.update(chunk)
                        ends = offset + len(chunk) == length
                        so_far = _base32(digest)
                        if ends and so_far != stated:
                            raise ValueError(f"payload digest of {fixed[0]} is {so_far}, the header has {stated}")
                        rows.append((*fixed, number, offset, len(chunk), so_far, ends, *([chunk] if with_data else [])))
                        offset, number, held = offset + len(chunk), number + 1, held + len(chunk) * with_data
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
        if rows:
            yield batch_of(rows)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kind = [*kinds, pa.binary()] if with_data else kinds
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kind)], names=[*names, "data"] if with_data else names)

    # A task for each archive: a stated number of partitions, as adaptive execution merges small ones.
    archives = manifest.select("path").repartitionByRange(max(1, manifest.count()), "path")
    return archives.mapInArrow(read, schema)


def archive_digests(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC records to ``folder`` (by default in the shared folder), read the
    archives back, and return for each page what they say of its payload.

    A null html is an empty payload. Rows that repeat a page_id are records each; those with the
    largest page_id of their payload are responses. A null page_id is smaller than all others.
    Payloads of any length are read in chunks. An empty table gives an empty result. Columns besides
    page_id, url and html are ignored.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to; of a revisit the first
    two are those of the response it refers to."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    chunks = read_chunks(write_archives(record_plan(pages, least_bytes), folder))
    records = settle(
        chunks.where("last").select("page_id", (F.col("offset") + F.col("length")).alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"),
        "warc-records",
    )
    heads = settle(
        records.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes")),
        "warc-responses",
    )
    revisits = records.where("record_type = 'revisit'").join(heads.hint("merge"), (records["refers_to"] == heads["refers_to"]) & (records["payload_digest"] == heads["of_digest"]), "left")
    return records.where("record_type = 'response'").unionByName(
        revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", records["refers_to"])
    )
