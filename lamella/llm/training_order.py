"""Training-order materialisation: token sequences in a keyed random order, as shards of fixed stride.

Texts become ids with a 0 after each, and each task's ids in a row are cut into sequences of one length; only
a task's last one is padded. Sequence i of all n goes to slot P(i), P being a keyed Feistel network over
the next even number of bits, walked until it falls below n: a permutation that needs no table and can
be inverted. Slots are dealt in contiguous ranges, each writer gets its slots in order, and slot s of a
data set is found at a fixed place, so that reading is sequential and can go on anywhere.

Numbers come from a first pass that only counts, so the texts are tokenised twice but never stored as
ids in between. The second pass must see the same partitions; it checks count and checksum of each, and
fails if they differ.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import binary_array, materialise, only, text_slices
from lamella.llm.tokens import word_tokens
from lamella.llm.wordhash import mix

_U = np.uint64
_MAGIC, _HEADER = b"TOKSHARD", 64
ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1 over arrays."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
        self.mask = _U((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(key & 0xFFFFFFFFFFFFFFFF))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> _U(self.half), x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & self.mask)
        return (left << _U(self.half)) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.int64).astype(np.uint64), keys, back)
        while len(beyond := np.flatnonzero(out >= _U(self.n))):
            out[beyond] = self._once(out[beyond], keys, back)
        return out.astype(np.int64)

    def slot(self, i: np.ndarray) -> np.ndarray:
        return self._walk(i, self.keys, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1], True)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _write(path: str, name: str, blobs: list[bytes]) -> None:
    """Under a name of its own first, so that a task run again replaces a whole file."""
    fs, root = _fs(path)
    part = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        for b in blobs:
            f.write(b)
    fs.move(part, f"{root}/{name}")


def _streams(batches: Iterable[pa.RecordBatch], vocabulary: str, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[int]]]]:
    """The task's sequences in turn, some at a time: ids (padded with 0), how many are real, and the doc_ids in each."""
    tokens = word_tokens(vocabulary)
    held, owners = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # owners: rows of `names`
    names: list[int] = []

    def cut(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        n = -(-len(ids) // length)
        real = np.full(n, length, np.int64)
        real[-1:] -= n * length - len(ids)
        change = np.ones(len(own), bool)
        change[1:] = (own[1:] != own[:-1]) | (np.arange(1, len(own)) % length == 0)
        at = np.flatnonzero(change)
        docs: list[list[int]] = [[] for _ in range(n)]
        for i, o in zip((at // length).tolist(), own[at].tolist(), strict=True):
            if names[o] is not None:
                docs[i].append(names[o])
        return np.pad(ids, (0, n * length - len(ids))).reshape(n, length), real, docs

    for piece, data, offsets in text_slices(batches):
        ids, bounds = tokens.encode(data, offsets)
        counts = np.diff(bounds) + 1
        full = np.zeros(len(ids) + len(counts), np.uint32)
        keep = np.ones(len(full), bool)
        keep[np.cumsum(counts) - 1] = False
        full[keep] = ids
        names = [names[o] for o in np.unique(owners).tolist()] + piece.column("doc_id").to_pylist()
        owners = np.unique(owners, return_inverse=True)[1] if len(owners) else owners
        base = int(owners[-1]) + 1 if len(owners) else 0
        held = np.concatenate([held, full])
        owners = np.concatenate([owners, np.repeat(np.arange(len(counts)) + base, counts)])
        whole = len(held) // length * length
        if whole:
            yield cut(held[:whole], owners[:whole])
            held, owners = held[whole:], owners[whole:]
    if len(held):
        yield cut(held, owners)


def write_shards(docs: DataFrame, path: str, vocabulary: str, length: int = 1024, key: int = 7, shard_rows: int = 8192) -> DataFrame:
    """Writes docs (doc_id, text) as shards under path; slot, shard, place, sequence, n_tokens, ids_crc32, doc_ids of every sequence.

    place is the byte in the shard where the sequence's record begins. A null or empty text is the 0 alone; repeated rows are written as
    often as they occur; a null doc_id is left out of doc_ids. Other columns are not read. An empty table gives no
    shard. path must be a folder that executors share, in a file system that pyarrow knows.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, crc = 0, 0
        for ids, _, _ in _streams(batches, vocabulary, length):
            n, crc = n + len(ids), zlib.crc32(ids.tobytes(), crc)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([crc])], ["task", "n", "crc"])

    tasks = sorted(tuple(r) for r in docs.mapInArrow(count, "task long, n long, crc long").collect())  # a row a task
    total = sum(n for _, n, _ in tasks)
    starts, at = {}, 0
    for task, n, crc in tasks:
        starts[task] = (at, n, crc)
        at += n
    width = 2 if len(word_tokens(vocabulary).closing) <= 1 << 16 else 4
    stride = 4 + width * length
    shards = -(-total // shard_rows)
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)
    known = spark.sparkContext.broadcast(starts)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, crc = known.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        order, seen, sum_ = Feistel(total, key), 0, 0
        for ids, real, names in _streams(batches, vocabulary, length):
            sum_ = zlib.crc32(ids.tobytes(), sum_)
            slots = order.slot(base + seen + np.arange(len(ids)))
            rows = [struct.pack("<I", k) + r.tobytes() for k, r in zip(real.tolist(), ids.astype(f"<u{width}"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(base + seen + np.arange(len(ids))), binary_array(rows), pa.array(names, pa.list_(pa.int64()))], ["slot", "sequence", "record", "doc_ids"])
            seen += len(ids)
        if (seen, sum_) != (n, crc):
            raise ValueError("the rows' partitions changed between the passes; write them to a table first")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        rows: list[tuple] = []
        here, expected = None, None

        def close() -> None:
            head = _MAGIC + struct.pack("<IIIIQQ", 1, width, length, stride, here * shard_rows, len(held))
            _write(path, f"shard-{here:07d}.bin", [head.ljust(_HEADER, b"\0"), *held])

        for batch in batches:
            for slot, sequence, rec, names in zip(*(batch.column(c).to_pylist() for c in ("slot", "sequence", "record", "doc_ids")), strict=True):
                if here != slot // shard_rows:
                    if here is not None:
                        close()
                    here, held, expected = slot // shard_rows, [], slot // shard_rows * shard_rows
                if slot != expected:
                    raise ValueError(f"slot {slot} where {expected} is due")
                expected += 1
                held.append(rec)
                n = struct.unpack_from("<I", rec)[0]
                rows.append((slot, here, _HEADER + (slot - here * shard_rows) * stride, sequence, n, zlib.crc32(np.frombuffer(rec, f"<u{width}", n, 4).astype("<u4").tobytes()), names))
            yield index(rows)
            rows = []
        if here is not None:
            close()

    def index(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["slot", "shard", "place", "sequence", "n_tokens", "ids_crc32", "doc_ids"])

    kind = "slot long, shard long, place long, sequence long, n_tokens long, ids_crc32 long, doc_ids array<long>"
    meta = {"sequences": total, "length": length, "width": width, "stride": stride, "shard_rows": shard_rows, "header": _HEADER, "key": key}
    if not total:
        _write(path, "meta.json", [json.dumps(meta).encode()])
        return spark.createDataFrame([], kind)
    dealt = docs.mapInArrow(number, "slot long, sequence long, record binary, doc_ids array<long>")
    out = materialise(dealt.repartitionById(shards, F.expr(f"cast(slot div {shard_rows} as int)")).sortWithinPartitions("slot").mapInArrow(write, kind), "slots")
    _write(path, "meta.json", [json.dumps(meta).encode()])
    return out


class ShardReader:
    """Sequences of a data set in training order, from any slot on."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.root = _fs(path)
        with self.fs.open_input_stream(f"{self.root}/meta.json", compression=None) as f:
            self.meta = json.loads(f.read())
        self.order = Feistel(max(1, self.meta["sequences"]), self.meta["key"])

    def __len__(self) -> int:
        return self.meta["sequences"]

    def read(self, start: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(slot, ids) from slot start on; the next call may begin where this one stopped."""
        m = self.meta
        end = len(self) if count is None else min(len(self), start + count)
        while start < end:
            shard, row = divmod(start, m["shard_rows"])
            take = min(end - start, m["shard_rows"] - row)
            with self.fs.open_input_file(f"{self.root}/shard-{shard:07d}.bin") as f:
                f.seek(m["header"] + row * m["stride"])
                for i in range(take):
                    rec = f.read(m["stride"])
                    if len(rec) != m["stride"]:
                        raise ValueError(f"shard {shard} ends before slot {start + i}")
                    n = struct.unpack_from("<I", rec)[0]
                    yield start + i, np.frombuffer(rec, f"<u{m['width']}", n, 4).astype(np.uint32)
            start += take


def read_slots(spark: SparkSession, path: str) -> DataFrame:
    """slot, n_tokens, ids_crc32, sequence: every record of the data set, read from its shards; sequence is found by the inverse permutation."""
    reader = ShardReader(path)
    rows, total = reader.meta["shard_rows"], len(reader)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                own = ShardReader(path)
                got = [(s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for s, ids in own.read(shard * rows, rows)]
                slots = np.array([g[0] for g in got], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array(own.order.index(slots))], ["slot", "n_tokens", "ids_crc32", "sequence"])

    shards = -(-total // rows)
    return spark.range(0, shards, 1, max(1, shards)).mapInArrow(run, "slot long, n_tokens long, ids_crc32 long, sequence long")
