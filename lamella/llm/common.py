"""What the operators of this folder share: the shared scratch folder, Arrow text access, group streaming."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of text that one round of array work handles; a longer text is a round of its own.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without it gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="scratch")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: the lineage ends and a lost executor costs no rework."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., whatever names they had, twice or in two cases."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> int:
    """The place of the column of exactly this name, else of one that differs in case only."""
    for same in (lambda x: x == name, lambda x: x.lower() == name.lower()):
        found = [i for i, x in enumerate(df.columns) if same(x)]
        if found:
            return found[0]
    raise ValueError(f"column {name!r} is missing; there are {df.columns}")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns of any name can't clash with the operator's own."""
    return numbered(df).select(*[F.col(f"c{place(df, x)}").alias(x) for x in names])


def text_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most limit bytes in that column, or of a single row."""
    _, offsets = text_parts(batch.column(name))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def free_unused() -> None:
    """Gives memory that this process has freed back to the system, where its C library can: workers live on between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(batches: Iterable[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for piece in slices(batch, name):
            yield piece, *text_parts(piece.column(name))
    free_unused()


def binary_array(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary array whose row i holds the bytes of values[bounds[i]:bounds[i + 1]], 2 GiB at most."""
    if len(bounds) and int(bounds[-1]) * values.itemsize > 0x7FFFFFFF:
        raise ValueError("more bytes than 32-bit offsets can tell apart")
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def grouped(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The groups of a sorted stream, one table each. Only the group at hand is held."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(n)[i].as_py() for n in names)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for n in names:
            codes = batch.column(n).dictionary_encode()
            ids = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= ids[1:] != ids[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = batch.slice(a, b - a)
            if held and key(held[-1], held[-1].num_rows - 1) != key(piece, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1; the smallest member names its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up = self.up = nxt


def bitmap_of(df: DataFrame, position: Column, bits: int) -> np.ndarray:
    """A bit for each position (from 0) that occurs, packed in bytes, little bit first. Its size is fixed, whatever the rows.

    Spark's bitmap functions count from 1."""
    got = (
        df.select((position + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m"))
    )
    out = np.zeros(bits // 8 + 8192, np.uint8)
    for b, m in got.collect():  # bits / 32768 rows of 4096 bytes at most
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def maybe_in(keys: DataFrame, position: Column, bits: int = 1 << 26):
    """A function of such positions: false where keys surely holds none, and true where it may. What it knows has a fixed size, whatever the rows."""
    known = keys.sparkSession.sparkContext.broadcast(bitmap_of(keys, position, bits))

    @F.arrow_udf("boolean")
    def picked(spot: pa.Array) -> pa.Array:
        at = spot.to_numpy(zero_copy_only=False)
        return pa.array(((known.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return picked


def without(df: DataFrame, gone: DataFrame, key: str, bits: int = 1 << 26) -> DataFrame:
    """The rows of df whose key is not among gone's. Only rows that a filter of fixed size can't clear meet gone in a join, so the others stay where they are.
    A null key is never among them, and repeated keys in gone count once."""
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    picked = maybe_in(gone, spot, bits)
    return df.where(~picked(spot)).unionByName(df.where(picked(spot)).join(gone.select(key), key, "left_anti").select(*df.columns))


def summed_array(df: DataFrame, per_task, length: int, dtype: type = np.int64, cuts: int = 128) -> np.ndarray:
    """The sum over all tasks of the array of this length that per_task(batches) makes in each.

    Arrays travel in compressed cuts and are added in two rounds, at most a sixteenth of the tasks'
    cuts in each first sum; the driver gets one array.
    """
    import zlib

    step = -(-length // cuts)
    kind = "cut int, part int, cells binary"

    def rows(cut: list[int], part: int, arrays: list[np.ndarray]) -> pa.RecordBatch:
        blobs = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in arrays]
        return pa.RecordBatch.from_arrays([pa.array(cut, pa.int32()), pa.array([part] * len(cut), pa.int32()), binary_array(blobs)], ["cut", "part", "cells"])

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = np.zeros(cuts * step, dtype)
        whole[:length] = per_task(batches)
        if whole.any():
            yield rows(list(range(cuts)), TaskContext.get().partitionId() % 16, list(whole.reshape(cuts, step)))

    def add(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            total = np.zeros(step, dtype)
            for blob in group["cells"]:
                total += np.frombuffer(zlib.decompress(blob.as_py()), dtype)
            yield rows([group["cut"][0].as_py()], group["part"][0].as_py(), [total])

    n = parts(df.sparkSession)
    half = df.mapInArrow(make, kind).repartition(min(n, 64), "cut", "part").sortWithinPartitions("cut", "part").mapInArrow(lambda b: add(b, ["cut", "part"]), kind)
    out = np.zeros((cuts, step), dtype)
    for row in half.repartition(min(n, 16), "cut").sortWithinPartitions("cut").mapInArrow(lambda b: add(b, ["cut"]), kind).collect():  # one row a cut
        out[row["cut"]] = np.frombuffer(zlib.decompress(bytes(row["cells"])), dtype)
    return out.ravel()[:length]
