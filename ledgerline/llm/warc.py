"""WARC archives with a two-level capture index.

Records are written by tasks as gzip members into files of the shared folder. Captures are sorted by
reversed-host URL key into compressed blocks (the index proper); each index file ends with a sparse directory of its
blocks, and the first keys of the files form the fence list the driver hands to tasks. A lookup
binary-searches the fences, the directory and the block, then range-reads one record.

Files get names of their own per attempt, and only the rows a finished task returned name files: a
repeated or lost attempt leaves an unused file, never a half record in the index.

Edge cases: NULL payload is empty, NULL URL has the key of an empty URL. Records below
``min_bytes`` are never revisits. Repeated rows (equal id and payload) are all of the type their id has. A row without an id is a
response and never referred to. An empty table gives no files and no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.stages import materialize, partitions, scratch_path

FILE_BYTES = 256 << 20
BLOCK_LINES = 1_000
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, file string, offset long, length long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if ":" in path.split("/")[0]:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


# --- records -----------------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query``: hosts of one domain lie next to each other."""
    rest = (url or "").partition("://")[2] or (url or "")
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:] or "/"
    return quote(",".join(reversed(host.split("."))) + ")" + path, safe="/?&=,.:;)(*~!$'@+%-_")


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key and capture id; ids are written so that text order is number order."""
    return f"{url_key(url)} {(-(1 << 63) if page_id is None else page_id) + (1 << 63):020d}"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response, or a revisit without payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:capture:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe='/?&=,.:;)(*~!$@+%-_#')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """Headers, type, ids and payload of one gzip member; the digest of a response is checked."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _capture_id(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": fields["WARC-Type"],
        "bytes": size, "digest": digest, "refers_to": _capture_id(fields.get("WARC-Refers-To")), "payload": payload,
    }


def _capture_id(text: str | None) -> int | None:
    found = (text or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(found) if found not in ("", "None") else None


# --- writing -----------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 1_000) -> DataFrame:
    """Adds payload, digest and ``refers_to``: of equal large payloads the largest id stays a
    response. Only ids and digests are grouped; a digest shared by very many pages is one
    counter per task, and payloads move at most once."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    winners = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    winners = winners.where("n > 1").drop("n")
    revisits = large.join(winners, "digest").where("page_id < refers_to").distinct()
    return rows.join(materialize(revisits, "revisits"), ["page_id", "digest"], "left")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes one record per row; returns the captures (key, file, offset, length), stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(name, compression=None)
                data = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                out.write(data)
                rows.append((capture_key(r["url"], r["page_id"]), name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CAPTURES), "captures")


# --- the index ---------------------------------------------------------------------------


@dataclass(frozen=True)
class CaptureIndex:
    """``fences``: first key and name of every index file, in key order."""

    fences: tuple[tuple[str, str], ...]
    folder: str


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures into index files; one fence per file comes to the driver."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(folder)
        where.create_dir(base, recursive=True)
        out, name, at, directory, block = None, "", 0, [], []

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(block).encode())
            out.write(packed)
            directory.append((block[0].split("\t", 1)[0], at, len(packed)))
            at += len(packed)
            block.clear()

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.idx"
                    out = where.open_output_stream(name, compression=None)
                block.append(f"{r['key']}\t{r['file']}\t{r['offset']}\t{r['length']}")
                if len(block) >= block_lines:
                    flush()
        if out is not None:
            if block:
                flush()
            packed = zlib.compress(json.dumps(directory).encode())
            out.write(packed)
            out.write(len(packed).to_bytes(8, "little"))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], ["first_key", "file"])

    # CAPTURES by name, so that further columns of the input do no harm
    ordered = captures.select("key", "file", "offset", "length").repartitionByRange(partitions(spark), "key")
    files = materialize(ordered.sortWithinPartitions("key").mapInArrow(run, "first_key string, file string"), "fences")
    rows = files.collect()  # one row per index file
    return CaptureIndex(tuple(sorted((r["first_key"], r["file"]) for r in rows)), folder)


class IndexReader:
    """Lookups by binary search on three levels; keeps the last block it read."""

    def __init__(self, index: CaptureIndex) -> None:
        self.where, _ = filesystem(index.folder)
        self.fences = index.fences
        self.firsts = [k for k, _ in index.fences]
        self.at = self.block_at = None

    def _open(self, i: int) -> None:
        if i != self.at:
            self.file = self.where.open_input_file(self.fences[i][1])
            size = self.file.size()
            n = int.from_bytes(self.file.read_at(8, size - 8), "little")
            self.directory = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))
            self.starts = [d[0] for d in self.directory]
            self.at, self.block_at = i, None

    def _load(self, j: int) -> None:
        if j != self.block_at:
            _, offset, length = self.directory[j]
            lines = zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")
            self.lines = [line.split("\t") for line in lines]
            self.keys = [line[0] for line in self.lines]
            self.block_at = j

    def scan(self, low: str, high: str) -> Iterator[tuple[str, str, int, int]]:
        """Captures with ``low <= key <= high``, in key order."""
        i = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while i < len(self.fences) and self.firsts[i] <= high:
            self._open(i)
            j = max(0, bisect.bisect_left(self.starts, low) - 1)
            while j < len(self.directory) and self.starts[j] <= high:
                self._load(j)
                for k in range(bisect.bisect_left(self.keys, low), bisect.bisect_right(self.keys, high)):
                    key, file, offset, length = self.lines[k]
                    yield key, file, int(offset), int(length)
                j += 1
            i += 1

    def captures_of(self, url: str) -> list[tuple[str, str, int, int]]:
        """All captures of one URL."""
        return list(self.scan(url_key(url) + " ", url_key(url) + " ~"))


RECORD = "page_id long, url string, type string, bytes long, digest string, refers_to long"


def fetch(spark: SparkSession, index: CaptureIndex, keys: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the wanted capture keys, each key looked up in the index and its record
    read by range. Keys are sorted first, so a task walks through neighbouring blocks."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, open_files = IndexReader(index), {}
        where = reader.where
        for batch in batches:
            rows, held = [], 0
            for key in batch.column(0).to_pylist():
                for _, file, offset, length in reader.scan(key, key):
                    if file not in open_files:
                        if len(open_files) >= 64:
                            open_files.pop(next(iter(open_files))).close()
                        open_files[file] = where.open_input_file(file)
                    rows.append(parse_record(open_files[file].read_at(length, offset)))
                    held += rows[-1]["bytes"]
                    if len(rows) >= 2_000 or held >= 16 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, names)

    wanted = keys.select("key").distinct()
    ordered = wanted.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, schema)


def _batch(rows: Sequence[dict], names: Sequence[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], list(names))


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 1_000) -> tuple[CaptureIndex, DataFrame]:
    """Writes and indexes all pages; returns the index and the stored captures."""
    folder = scratch_path(spark, "warc")
    captures = write_archives(with_revisits(pages, min_bytes), f"{folder}/archives")
    return build_index(captures, f"{folder}/index"), captures
