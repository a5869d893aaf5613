"""WARC archives of individually compressed records with a shared Zstandard dictionary.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame a record, so any
record can be read from its offset. The dictionary is trained on a bounded sample of
the records to be archived. Equal payloads are stored once: one record is the response, the others
are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import materialise, only, parts, slices

# Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Records that the dictionary is trained on, about, the most bytes of payload that one of them gives (from a place that its hash picks), and the dictionary's size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 32_768, 65_536
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 16 << 20
_KIND = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record. payload None: a revisit."""
    body = _HTTP + payload if payload is not None else _HTTP
    fields = {
        "WARC-Type": "response" if payload is not None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{payload is None}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Payload-Length": str(size),
        "WARC-Page-ID": None if page_id is None else str(page_id),
        "WARC-Profile": _PROFILE if payload is None else None,
        "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}:False')}>" if payload is None else None,
        "WARC-Refers-To-Page-ID": str(refers_to) if payload is None and refers_to is not None else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record, and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its block")
    return fields, rest[:n]


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", _SKIPPABLE, len(dictionary)) + dictionary


def dictionary_of(raw: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary at an archive's head, if there is one, and where its records begin."""
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == _SKIPPABLE:
        n = struct.unpack_from("<I", raw, 4)[0]
        return zstandard.ZstdCompressionDict(raw[8 : 8 + n]), 8 + n
    return None, 0


def records(raw: bytes, at: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of an archive, from offset at on if it is given."""
    known, first = dictionary_of(raw)
    at = first if at is None else at
    plain = zstandard.ZstdDecompressor(dict_data=known)
    view = memoryview(raw)
    while at < len(raw):
        reader = plain.decompressobj()
        parts_, here = [reader.decompress(view[at : at + 65_536])], at + 65_536
        while not reader.eof:
            if here >= len(raw):
                raise ValueError("an archive ends within a record")
            parts_.append(reader.decompress(view[here : here + 65_536]))
            here += 65_536
        end = min(here, len(raw)) - len(reader.unused_data)
        yield at, b"".join(parts_)
        at = end


def train_dictionary(pages: DataFrame, date: str, samples: int = SAMPLES) -> bytes:
    """A dictionary from about this many of the records to be archived, chosen by a hash of id and payload; empty where there are too few."""
    total = pages.count()
    if not total:
        return b""
    share = min(1.0, samples / total)
    draw = pages.where(F.pmod(F.xxhash64("page_id", "digest"), F.lit(1 << 30)) < int(share * (1 << 30)))
    begin = f"cast(1 + pmod(xxhash64(digest), greatest(octet_length(html) - {SAMPLE_BYTES}, 0) + 1) as int)"
    got = draw.select("page_id", "url", "digest", F.octet_length("html").alias("size"), F.expr(f"substring(encode(html, 'UTF-8'), {begin}, {SAMPLE_BYTES})").alias("html")).limit(2 * samples).collect()
    made = sorted(record(r["page_id"], r["url"], bytes(r["html"]), r["size"], base32(r["digest"]), None, date) for r in got)
    if len(made) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, made)) // 8)), made).as_bytes()
    except zstandard.ZstdError:  # the samples have too little in common
        return b""


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Archives all rows of pages (page_id, url, html) as .warc.zst files under path; a row each: archive, records, bytes.

    The payload is html in UTF-8, a null one empty. Of records with equal payloads of at least `least` bytes
    the one with the largest page_id is the response (the first of repeated rows with that id) and the others are
    revisits that refer to its page_id; smaller payloads are all responses. A null url leaves the target out, a null page_id the
    page's id, which counts as the smallest. Other columns are not read. path must be a folder that
    executors share, in any file system that pyarrow knows. A task writes under a name of its own and renames
    at its end, so a task run again replaces what it wrote before.
    """
    spark = pages.sparkSession
    base = only(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # who is response: sizes and digests alone decide, so payloads aren't gathered by digest
    slim = base.select("page_id", "digest", F.octet_length("html").alias("size"))
    heads = slim.groupBy("digest", "size").agg(F.max("page_id").alias("head"))
    kinds = slim.join(heads, ["digest", "size"]).groupBy(F.col("page_id").alias("p"), F.col("digest").alias("d")).agg(F.max("head").alias("head"), F.max("size").alias("size"))
    known = spark.sparkContext.broadcast(train_dictionary(base, date))

    def compressor() -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(known.value) if known.value else None, write_checksum=True)

    def compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row as the response that it would be: only compressed bytes move from here."""
        one = compressor()
        for batch in batches:
            for piece in slices(batch, "html", 8 << 20):
                frames = []
                for r in piece.to_pylist():
                    raw = r["html"].encode()
                    frames.append(one.compress(record(r["page_id"], r["url"], raw, len(raw), base32(r["digest"]), None, date)))
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), piece.column("digest"), pa.array(frames, pa.binary())], ["page_id", "url", "digest", "frame"])

    frames = base.mapInArrow(compress, "page_id long, url string, digest string, frame binary")
    rows = frames.join(kinds, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))).drop("p", "d")
    first = F.col("page_id").eqNullSafe(F.col("head")) | (F.col("size") < least)
    rows = rows.select("page_id", "url", "digest", "head", F.col("size").cast("long").alias("size"), F.when(first, F.col("frame")).alias("frame"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        task, number, one = TaskContext.get().partitionId(), 0, compressor()
        head = skippable(known.value) if known.value else b""
        held, size, done, last = [head], len(head), [], None

        def close() -> None:
            nonlocal held, size, number
            name = f"part-{task:05d}-{number:04d}.warc.zst"
            part = f"{root}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part, compression=None) as f:
                f.write(b"".join(held))
            fs.move(part, f"{root}/{name}")
            done.append((name, len(held) - 1, size))
            held, size, number = [head], len(head), number + 1

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for r in batch.slice(at, 512).to_pylist():
                    same = (r["page_id"], r["digest"])
                    whole = r["frame"] is not None and not (same == last and r["size"] >= least)
                    last = same
                    held.append(r["frame"] if whole else one.compress(record(r["page_id"], r["url"], None, r["size"], base32(r["digest"]), r["head"], date)))
                    size += len(held[-1])
                    if size >= ARCHIVE_BYTES:
                        close()
        if len(held) > 1:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["archive", "records", "bytes"])

    fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    fs.create_dir(root, recursive=True)
    out = rows.repartition(parts(spark), "page_id", "digest").sortWithinPartitions("page_id", "digest").mapInArrow(write, "archive string, records long, bytes long")
    return materialise(out, "archives")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row each record of the archives under path: page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload: bytes, null in revisits).

    A payload is checked against its digest.
    """
    kind = _KIND + ", payload binary" * payload

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for _, raw in records(content.as_buffer().to_pybytes()):
                    fields, block = parse(raw)
                    number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                    digest, body = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if fields["WARC-Type"] == "response":
                        body = block[len(_HTTP) :]
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest or len(body) != number("WARC-Payload-Length"):
                            raise ValueError("a payload does not match its digest")
                    rows.append((number("WARC-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"], number("WARC-Payload-Length"), digest, number("WARC-Refers-To-Page-ID"), *[body] * payload))
                    held += len(raw)
                    if len(rows) == 4096 or payload and held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * payload]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in kind.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content")
    return files.mapInArrow(read, kind)


#: What the archives of pages say, read back. Forty hexadecimal digits are eight groups of twenty bits, each four base32 letters.
ORACLE = """
with d as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as h from pages),
g as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::int, 5))::bigint) as v from d),
b as (select page_id, payload_bytes, array_to_string(list_transform(v, lambda x:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (x >> 15) % 32)::int, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (x >> 10) % 32)::int, 1) ||
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + (x >> 5) % 32)::int, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + x % 32)::int, 1)), '') as payload_digest from g),
m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as head, row_number() over (partition by payload_digest, payload_bytes order by page_id desc nulls last) as place from b)
select page_id, payload_bytes, payload_digest, case when place = 1 then 'response' else 'revisit' end as record_type, case when place > 1 then head end as refers_to
from m
"""
