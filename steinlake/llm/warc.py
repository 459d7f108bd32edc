"""WARC archives as seekable Zstandard bundles.

A record is a WARC/1.1 response, or a revisit where another row has the same payload. Records are gathered into independent
Zstandard frames of about FRAME bytes; a bundle ends with a skippable frame that holds the seek table (compressed and plain
size of every frame), so a reader can decompress one frame without the others. The manifest maps each record to its bundle,
frame, and offset and length within the frame. Each task writes its own bundles under new names; only those in the manifest,
which Spark commits, are ever read, so a lost or repeated task leaves nothing wrong.

Cases: a null html is an empty payload; payloads under MIN_REVISIT bytes are always responses; of equal larger payloads the
record with the largest page_id is the response (rows that share that page_id too), a null id is smaller than any; an empty
table gives no bundle. Only page_id, url and html are read. A null url leaves the target header out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fields, join_spread, new_path, prepared, stored
from .files import open_folder, write_new

MIN_REVISIT, FRAME, BUNDLE, RECORDS = 1000, 1 << 20, 64 << 20, 4_000
#: Fixed values of the seekable format: the skippable frame's magic number and the seek table's.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = fields("page_id long, bundle string, frame int, at long, length long, frame_at long, frame_bytes long")


def _line(value: str) -> str:
    """A header value: control characters would end the line, so they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record; refers_to None makes a response, whose block is the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    head["X-Payload-Length"] = str(size)
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    block = payload if refers_to is None else b""
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and the block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    named = dict(x.split(": ", 1) for x in lines)
    size = int(named["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return named, rest[:size]


class BundleWriter:
    """Frames in one file, then the seek table."""

    def __init__(self, store, path: str):
        self.path, self.out, self.at, self.frames = path, write_new(store, path), 0, []
        self.zip = zstandard.ZstdCompressor(level=3)

    def frame(self, plain: bytes) -> tuple[int, int, int]:
        """(number, offset, bytes) of a new frame."""
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.at += len(packed)
        return len(self.frames) - 1, self.at - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed bytes, plain bytes) of each frame, from a bundle's last bytes."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    found, at = [], 0
    for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        found.append((at, packed, plain))
        at += packed
    return found


def with_kinds(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest and refers_to (null for responses).

    Payloads are equal if their SHA-256 are (SHA-1 collisions are public). Only ids and digests are grouped, pre-aggregated
    before the shuffle; the join back brings each repeated payload's response to its copies, and a hot payload's by broadcast.
    """
    payload = F.coalesce(pages["html"].cast("binary"), F.lit("").cast("binary"))
    all_rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"))
    large = F.col("payload_bytes") >= MIN_REVISIT
    repeated = all_rows.filter(large).groupBy(F.sha2(F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")), 256).alias("same")).agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stored(repeated, "repeated")
    # Small payloads equal none; a key of their own spreads them.
    own = F.hex(F.xxhash64("page_id", "url"))
    keyed = all_rows.withColumn("same", F.when(large, F.sha2(F.col("html").cast("binary"), 256)).otherwise(own))
    joined = join_spread(keyed, repeated, ["same"], "response_id", "n", F.xxhash64("page_id", "url"))
    other = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(other, F.col("response_id")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, frame_bytes: int = FRAME, bundle_bytes: int = BUNDLE) -> DataFrame:
    """Writes the bundles and returns the committed manifest (page_id, bundle, frame, at, length, frame_at, frame_bytes)."""
    prepared(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        out, part, waiting, size, written, done = None, [], [], 0, 0, []

        def frame() -> None:
            nonlocal out, size, written
            if out is None:
                out = BundleWriter(store, f"{root}/{uuid.uuid4().hex}.warc.zst")
            number, at, packed = out.frame(b"".join(part))
            done.extend((i, out.path.rpartition("/")[2], number, a, n, at, packed) for i, a, n in waiting)
            part.clear()
            waiting.clear()
            written, size = written + packed, 0
            if written >= bundle_bytes:
                out.close()
                out, written = None, 0

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, x, strict=True)) for x in done], schema=pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), *((n, pa.int64()) for n in MANIFEST.names[3:])]))
            done.clear()
            return batch

        for batch in batches:
            for page_id, url, html, n_bytes, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = warc_record(page_id, url, (html or "").encode(), digest, n_bytes, refers_to)
                waiting.append((page_id, size, len(raw)))
                part.append(raw)
                size += len(raw)
                if size >= frame_bytes:
                    frame()
            if done:
                yield told()
        if part:
            frame()
        if out is not None:
            out.close()
        if done:
            yield told()

    return stored(with_kinds(pages).mapInArrow(run, MANIFEST), "manifest")


def read_warc(folder: str, manifest: DataFrame) -> DataFrame:
    """Reads every record of the manifest back by its frame and offset: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html.

    A response's size and digest are computed from the payload read; a revisit's come from its headers, and its html is null.
    """
    prepared(manifest.sparkSession)
    schema = fields("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
    # The rows are small but each stands for a record to decompress, so the number of tasks follows their count, not their bytes.
    dealt = manifest.repartition(max(1, -(-manifest.count() // RECORDS)), "bundle", "frame")
    one = dealt.groupBy("bundle", "frame", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("at", "length")).alias("records"))

    def number(urn: str | None) -> int | None:
        text = (urn or "None").removeprefix("<urn:page:").removesuffix(">")
        return None if text == "None" else int(text)

    def make():
        store, root = open_folder(folder)
        unzip = zstandard.ZstdDecompressor()

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['bundle']}") as f:
                    if seek_table(f)[row["frame"]][:2] != (row["frame_at"], row["frame_bytes"]):
                        raise ValueError("seek table and manifest differ")
                    f.seek(row["frame_at"])
                    plain = unzip.decompress(f.read(row["frame_bytes"]))
                cols: list[list] = [[] for _ in schema.names]
                for r in row["records"]:
                    head, block = read_record(plain[r["at"] : r["at"] + r["length"]])
                    full = head["WARC-Type"] == "response"
                    digest = hashlib.sha1(block).hexdigest() if full else head["WARC-Payload-Digest"].removeprefix("sha1:")
                    values = (number(head["WARC-Record-ID"]), len(block) if full else int(head["X-Payload-Length"]), digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), head.get("WARC-Target-URI"), block.decode() if full else None)
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema.names)

        return each

    return arrow_map(one, make, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes the pages to new bundles in the shared folder and reads them all back."""
    folder = new_path(prepared(pages.sparkSession), "warc")
    return read_warc(folder, write_warc(pages, folder))
