"""Blobs in streams: files of frames as they arrive, or messages whose value is a frame.

Arriving files are listed by Spark's own file source, whose log has each file once. Files that a stream writes are named for it and the
micro-batch, so a batch that runs again replaces its own.

A stream's columns are fixed when it is planned, so frames of one known writer are decoded in the plan; where versions mix,
each micro-batch is sorted by writer and every version gets its compiled projection.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.encode import Batch
from lamella.operators.reconcile import Options, evolve, written
from lamella.plans.schema import Node, Struct, from_spark
from lamella.sources.blobs import FORMAT, SUFFIX, batch_run, decoded, register, write
from lamella.sources.frame import MAGIC, frame, peek_schema


def contents(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The frames that arrive as files under a path."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"*{SUFFIX}").load(path).select("content")


def read(spark: SparkSession, path: str, writer: Struct, reader: Struct | None = None, options: Options = Options()) -> DataFrame:
    """A stream of rows written with one schema, as the reader asks for them."""
    rows = decoded(contents(spark, path), writer)
    return evolve(rows, writer, reader, options=options) if reader is not None else rows


def versions(frames: DataFrame) -> list[Node]:
    """The schemas among frames in a column `content`; one row a schema comes to the driver."""

    def heads(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([peek_schema(c.as_buffer())[0].to_bytes() for c in batch.column("content")], pa.binary())], ["schema"])

    return [Node.from_bytes(bytes(r["schema"])) for r in frames.select("content").mapInArrow(heads, "schema binary").distinct().collect()]


def read_mixed(frames: DataFrame, reader: Struct, options: Options = Options()) -> DataFrame:
    """The rows of frames of any versions (a batch), as the reader asks for them."""
    found = versions(frames)
    out: DataFrame | None = None
    for node in found:
        head = frame(node, b"")
        own = frames.where(F.substring("content", 1, len(head)) == F.lit(head))
        rows = evolve(decoded(own, node), node, reader, options=options)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return frames.sparkSession.createDataFrame([], evolve_schema(frames.sparkSession, reader))
    return out


def evolve_schema(spark: SparkSession, reader: Struct):
    from lamella.plans.schema import struct_type

    return struct_type(reader)


def for_each_version(frames: DataFrame, reader: Struct, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, options: Options = Options()) -> StreamingQuery:
    """Runs a stream of frames of mixed versions into sink(rows, batch id)."""
    run = frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(read_mixed(df, reader, options), i))
    return (run.trigger(availableNow=True) if available_now else run).start()


def write_blobs(stream: DataFrame, path: str, checkpoint: str, node: Struct | None = None, available_now: bool = True) -> StreamingQuery:
    """A stream of rows into blob files, one set a micro-batch; a batch that runs again replaces its set, so no row is there twice."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    run = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: write(df, path, node, run=batch_run(name, i)))
    return (run.trigger(availableNow=True) if available_now else run).start()


def write_format(stream: DataFrame, path: str, checkpoint: str, node: Struct | None = None, available_now: bool = True) -> StreamingQuery:
    """The same by the source's own stream writer, writeStream.format(...): without a batch job for every micro-batch."""
    register(stream.sparkSession)
    node = node or from_spark(stream.schema)
    run = written(stream, node).writeStream.format(FORMAT).option("checkpointLocation", checkpoint).option("schema", node.to_json()).option("path", path)
    return (run.trigger(availableNow=True) if available_now else run).start()


def to_messages(df: DataFrame, node: Struct, rows: int = 1000) -> DataFrame:
    """Rows as frames in a column `content`, one for every so many rows of a partition."""

    def run(batches):
        batch = Batch(node)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                batch.push(pa.array(b.slice(at, rows).to_struct_array()))
                if batch.rows >= rows:
                    yield pa.RecordBatch.from_arrays([pa.array([frame(node, batch.finish())], pa.binary())], ["content"])
        if batch.rows:
            yield pa.RecordBatch.from_arrays([pa.array([frame(node, batch.finish())], pa.binary())], ["content"])

    return df.select(*[F.col(f"`{f.name}`") for f in node.fields]).mapInArrow(run, "content binary")


def is_frame(content: str = "content"):
    """Whether a column of bytes begins with the magic of a frame."""
    return F.substring(content, 1, 4) == F.lit(MAGIC)
