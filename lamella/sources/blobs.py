"""Files of self-describing blobs as a Spark data source, and scans over files of several versions.

A file holds one frame or several of one schema, whose fingerprint is part of its name: a scan lists names, reads one head a schema
on the driver and everything else in tasks. A task reads a file's heads and then the bytes of the columns that are
wanted, nothing else. Spark hands the source the columns it should
give only where a schema is named, so scan() names the columns that a reader needs.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import defaultdict
from collections.abc import Collection, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from lamella.errors import LamellaError, SchemaMismatch, UnexpectedEof
from lamella.operators.decode import bounded, counts, decode, decode_columns, wanted_columns
from lamella.operators.encode import Batch
from lamella.operators.reconcile import Options, evolve, written
from lamella.plans.schema import Node, Struct, from_spark, struct_type
from lamella.sources.frame import fingerprint, frame, peek_schema, split_frames

FORMAT, SUFFIX = "lamella", ".blob"
ROWS_PER_BLOB = 100_000
#: A task goes on to another file once one has so many bytes.
FILE_BYTES = 256 << 20
#: Bytes read to see a file's schema; more where the schema is longer.
_PEEK = 1 << 16


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The blob files under a path, or the one file it names."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [root]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and f.path.endswith(SUFFIX) and _TEMPORARY not in f.path[len(root) :])


_TEMPORARY = "_temporary"
_TAG = re.compile(r"-s([0-9a-f]{16})" + re.escape(SUFFIX) + "$")


class _Window:
    """The bytes of an open file from some place on, read as they are asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.size, self.data = file, at, file.size(), memoryview(b"")

    def parsed(self, parse):
        """What parse makes of the bytes from here on, of as few of them as it needs."""
        ask = _PEEK
        while True:
            if len(self.data) < min(ask, self.size - self.at):
                self.file.seek(self.at)
                self.data = memoryview(self.file.read(ask))
            try:
                return parse(self.data)
            except UnexpectedEof:
                if self.at + len(self.data) >= self.size:
                    raise
                ask *= 8


def file_frames(file: pa.NativeFile) -> Iterator[tuple[Node, int, list[int], int]]:
    """Schema, row count, column lengths and place of the first column of each frame in a file; only heads are read."""
    at, size = 0, file.size()

    def head(data: memoryview) -> tuple[Node, int, list[int], int]:
        node, blob = peek_schema(data)
        rows, lengths, used = counts(node, blob)
        return node, rows, lengths, len(data) - len(blob) + used

    while at < size or not at:
        node, rows, lengths, used = _Window(file, at).parsed(head)
        bounded("row count", rows, lengths)
        end = at + used + sum(lengths)
        if end > size:
            raise UnexpectedEof
        yield node, rows, lengths, at + used
        at = end


def read_file(fs: pafs.FileSystem, name: str, fields: Collection[str] | None, strict: bool) -> Iterator[tuple[Node, pa.Array]]:
    """The rows of each frame of a file. Without strict, only the bytes of the columns that fields need are read."""
    nothing = np.zeros(0, np.uint8)
    with fs.open_input_file(name) as file:
        for node, rows, lengths, at in file_frames(file):
            want = [True] * len(lengths) if strict else wanted_columns(node, fields)
            cols, k = [nothing] * len(lengths), 0
            while k < len(lengths):  # columns that lie side by side are one read
                end = k
                while end < len(lengths) and want[end] == want[k]:
                    end += 1
                size = sum(lengths[k:end])
                if want[k]:
                    data, used = np.frombuffer(file.read_at(size, at), np.uint8), 0
                    if len(data) < size:
                        raise UnexpectedEof
                    for i in range(k, end):
                        cols[i] = data[used : used + lengths[i]]
                        used += lengths[i]
                at, k = at + size, end
            yield node, decode_columns(node, rows, cols, fields if isinstance(node, Struct) else None, strict)


def schema_of(path: str, name: str) -> Node:
    """The schema in a file's head; the data is not read."""
    fs, _ = file_system(path)
    size = _PEEK
    while True:
        with fs.open_input_stream(name, compression=None) as f:
            head = f.read(size)
        try:
            return peek_schema(head)[0]
        except UnexpectedEof:
            if len(head) < size:
                raise
            size *= 8


def batches_of(node: Node, array: pa.Array, schema: T.StructType, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Record batches of the columns of schema."""
    if not isinstance(node, Struct):
        whole = pa.RecordBatch.from_arrays([array], ["value"])
    else:
        whole = pa.RecordBatch.from_struct_array(array) if array.type.num_fields else None
    if whole is None or not schema.fields:
        yield pa.RecordBatch.from_struct_array(pa.StructArray.from_buffers(pa.struct([]), len(array), [None]))
        return
    whole = whole.select([f.name for f in schema.fields])
    for at in range(0, max(whole.num_rows, 1), rows):
        yield whole.slice(at, rows)


@dataclass
class File(InputPartition):
    name: str

    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class BlobReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, strict: bool, tag: str, names: list[str], permissive: bool):
        self.path, self.schema, self.strict, self.tag, self.names, self.permissive = path, schema, strict, tag, names, permissive

    def partitions(self) -> list[InputPartition]:
        found = self.names or [f for f in files(self.path) if not self.tag or (m := _TAG.search(f)) and m[1] == self.tag]
        return [File(f) for f in found] or [File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, _ = file_system(self.path)
        fields = [f.name for f in self.schema.fields]
        try:
            for node, array in read_file(fs, partition.name, fields, self.strict):
                have = {f.name: f.dataType for f in struct_type(node).fields}
                for f in self.schema.fields:
                    if f.name not in have or have[f.name] != f.dataType and have[f.name].simpleString() != f.dataType.simpleString():
                        raise SchemaMismatch(f"{f.name} {f.dataType.simpleString()}", f"{have.get(f.name, T.NullType()).simpleString()} in {partition.name}; read files of other versions with scan()")
                yield from batches_of(node, array, self.schema)
        except (LamellaError, pa.ArrowInvalid):
            if not self.permissive:
                raise


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer:
    """Tasks write under names of their own; the driver gives the files their names when all are there."""

    def __init__(self, path: str, node: Node, overwrite: bool, rows: int, run: str = ""):
        self.path, self.node, self.overwrite, self.rows = path, node, overwrite, rows
        self.run, self.tag = run or uuid.uuid4().hex, fingerprint(node)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        batch, out, task, mine = Batch(self.node), [], TaskContext.get(), f"{root}/{_TEMPORARY}/{self.run}"
        fs.create_dir(mine, recursive=True)
        file: pa.NativeFile | None = None

        def flush() -> None:
            nonlocal file
            if file is None:
                part = f"{mine}/{uuid.uuid4().hex}"
                file = fs.open_output_stream(part, compression=None)
                out.append((part, f"part-{self.run}-{task.partitionId():05d}-{len(out):04d}-s{self.tag}{SUFFIX}"))
            file.write(frame(self.node, batch.finish()))
            if file.tell() >= FILE_BYTES:
                file.close()
                file = None

        try:
            for b in iterator:
                for at in range(0, b.num_rows, self.rows):
                    rows = b.slice(at, self.rows)
                    batch.push(pa.array(rows.to_struct_array()) if isinstance(self.node, Struct) else rows.column(0))
                    if batch.rows >= self.rows:
                        flush()
            if batch.rows:
                flush()
        finally:
            if file is not None:
                file.close()
        return Written(out)

    def publish(self, messages: list, replaced: list[str]) -> None:
        """Gives the files their names, and takes away those that they replace once all are there."""
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        new = set()
        for m in messages:
            for part, name in m.files if m else ():
                fs.move(part, f"{root}/{name}")
                new.add(f"{root}/{name}")
        if not new and not set(files(self.path)) - set(replaced):  # an empty table has a schema too
            name = f"{root}/part-{self.run}-00000-0000-s{self.tag}{SUFFIX}"
            with fs.open_output_stream(name, compression=None) as f:
                f.write(frame(self.node, Batch(self.node).finish()))
            new.add(name)
        for old in replaced:
            if old not in new:
                fs.delete_file(old)
        self.clear()

    def clear(self) -> None:
        """Removes what this run left; parts of other runs on the same path stay."""
        fs, root = file_system(self.path)
        if fs.get_file_info(f"{root}/{_TEMPORARY}/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{_TEMPORARY}/{self.run}")


class BlobWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        run = f"part-{self.run}-"  # a run of a given name replaces what it wrote before
        self.publish(messages, [f for f in files(self.path) if self.overwrite or f.rsplit("/", 1)[-1].startswith(run)])

    def abort(self, messages: list) -> None:
        self.clear()


class BlobStreamWriter(_Writer, DataSourceStreamArrowWriter):
    """Files are named for the stream and the micro-batch: a batch that runs again replaces its own files, so rows are there once."""

    def __init__(self, path: str, node: Node, rows: int, stream: str):
        super().__init__(path, node, False, rows)
        self.stream = hashlib.sha256(stream.encode()).hexdigest()[:12]

    def commit(self, messages: list, batchId: int) -> None:
        run = batch_run(self.stream, batchId)
        named = [Written([(part, name.replace(self.run, run, 1)) for part, name in m.files]) for m in messages if m]
        done = [f for f in files(self.path) if f.rsplit("/", 1)[-1].startswith(f"part-{run}-")]
        if named and any(m.files for m in named) or done:
            self.publish(named, done)
        self.clear()

    def abort(self, messages: list, batchId: int) -> None:
        self.clear()


def batch_run(stream: str, batch: int) -> str:
    return f"{stream}.{batch:010d}"


class BlobSource(DataSource):
    """Options: path; strict (columns left out are checked too, true unless "false"); mode ("permissive": files end at their first frame that can't be read,
    "failfast": such files fail the job, which is the default); schema (the writer's, as JSON); rowsPerBlob; run (a name: what was
    written under it before is replaced); fingerprint and files (what scan() reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        found = files(self.options["path"])
        if not found:
            raise SchemaMismatch(f"*{SUFFIX} files", "none", self.options["path"])
        return struct_type(schema_of(self.options["path"], found[0]))

    def reader(self, schema: T.StructType) -> BlobReader:
        o = self.options
        return BlobReader(o["path"], schema, o.get("strict", "true").lower() != "false", o.get("fingerprint", ""), json.loads(o.get("files", "[]")), o.get("mode", "").lower() == "permissive")

    def _node(self, schema: T.StructType) -> Node:
        text = self.options.get("schema")
        return Node.from_json(text) if text else from_spark(schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options["path"], self._node(schema), overwrite, int(self.options.get("rowsPerBlob", ROWS_PER_BLOB)), self.options.get("run", ""))

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> BlobStreamWriter:
        return BlobStreamWriter(self.options["path"], self._node(schema), int(self.options.get("rowsPerBlob", ROWS_PER_BLOB)), self.options.get("checkpointLocation", self.options["path"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlobSource)


def write(df: DataFrame, path: str, node: Struct | None = None, mode: str = "append", rows_per_blob: int = ROWS_PER_BLOB, run: str = "") -> None:
    """df as blob files of this schema (or the one that its types give). run: a name under which a second write replaces the first."""
    register(df.sparkSession)
    node = node or from_spark(df.schema)
    written(df, node).write.format(FORMAT).option("schema", node.to_json()).option("rowsPerBlob", rows_per_blob).option("run", run).mode(mode).save(path)


def writer_schemas(path: str) -> dict[Node, list[str]]:
    """The files under a path by the schema they were written with. One head a fingerprint is read, and those of files whose names have none."""
    tagged, plain = defaultdict(list), []
    for f in files(path):
        tagged[m[1]].append(f) if (m := _TAG.search(f)) else plain.append(f)
    out: dict[Node, list[str]] = defaultdict(list)
    for names in tagged.values():
        out[schema_of(path, names[0])] += names
    with ThreadPoolExecutor(32) as pool:
        for f, node in zip(plain, pool.map(lambda f: schema_of(path, f), plain), strict=True):
            out[node].append(f)
    return dict(out)


def _decoder(node: Node, fields: Collection[str] | None, strict: bool, schema: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for own, blob in split_frames(content.as_buffer()):
                    if own != node:
                        raise SchemaMismatch(node.describe(), own.describe())
                    yield from batches_of(node, decode(node, blob, fields, strict), schema)

    return run


def decoded(contents: DataFrame, node: Node, fields: Collection[str] | None = None, strict: bool = True) -> DataFrame:
    """The rows of frames in a column `content`, all written with this schema. Works on streams as well."""
    schema = struct_type(node)
    if fields is not None and isinstance(node, Struct):
        schema = T.StructType([f for f in schema.fields if f.name in fields])
    return contents.select("content").mapInArrow(_decoder(node, fields, strict, schema), schema)


def scan(spark: SparkSession, path: str, reader: Struct | None = None, strict: bool = False, options: Options = Options(), exact: bool = False, permissive: bool = False) -> DataFrame:
    """All files under a path as the reader asks for them, whatever version wrote each.

    Files of one version are one scan, which reads only the columns that the reader needs, and one compiled projection;
    the versions are put together by name. strict: columns left out and rows whatever is selected are checked too.
    exact: files of any other schema than the reader's are refused instead of reconciled. permissive: a file that can't be read ends where
    it can't, without an error; claimed_rows() tells how many rows there should be.
    """
    register(spark)
    found = writer_schemas(path)
    if not found:
        raise SchemaMismatch(f"*{SUFFIX} files", "none", path)
    reader = reader or next(iter(found))
    for node in found if exact else ():
        if node != reader:
            raise SchemaMismatch(reader.describe(), node.describe(), path)
    out: DataFrame | None = None
    for node, names in found.items():
        known = {n for f in reader.fields for n in f.names}
        fields = [f.name for f in node.fields if f.name in known]
        schema = T.StructType([f for f in struct_type(node).fields if f.name in fields])
        load = spark.read.format(FORMAT).schema(schema).option("strict", str(strict).lower()).option("mode", "permissive" if permissive else "failfast")
        tags = {m[1] if (m := _TAG.search(f)) else "" for f in names}
        load = load.option("fingerprint", tags.pop()) if len(tags) == 1 and "" not in tags else load.option("files", json.dumps(names))
        here = evolve(load.load(path), Struct(node.name, [f for f in node.fields if f.name in fields]), reader, strict, options)
        out = here if out is None else out.unionByName(here)
    return out


def _heads(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    """row(file name, frame number, schema, row count, column lengths) for every frame under a path, read in tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(name) as file:
                    for k, (node, rows, lengths, _) in enumerate(file_frames(file)):
                        yield row(name, k, node, rows, lengths)

    names = files(path)
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    return listed.repartition(max(1, min(len(names), int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(run, schema)


def claimed_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, frame, rows: how many rows each frame says it has."""
    return _heads(spark, path, "name string, frame int, rows long", lambda name, k, node, rows, lengths: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([rows])], ["name", "frame", "rows"]))


def column_sizes(spark: SparkSession, path: str) -> DataFrame:
    """number, bytes: the size of each physical column over all files, from their heads' lengths alone."""
    each = _heads(spark, path, "number int, bytes long", lambda name, k, node, rows, lengths: pa.RecordBatch.from_arrays([pa.array(range(len(lengths)), pa.int32()), pa.array(lengths, pa.int64())], ["number", "bytes"]))
    return each.groupBy("number").agg(F.sum("bytes").alias("bytes"))


def column_bytes(spark: SparkSession, path: str) -> dict[int, int]:
    """column_sizes by number; a row a column of the schema comes to the driver."""
    return {r["number"]: r["bytes"] for r in column_sizes(spark, path).collect()}
