"""Self-describing blobs: magic bytes, a version, the schema, then one blob."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa

from lamella.errors import Malformed, UnexpectedEof, UnsupportedVersion
from lamella.functions import varint
from lamella.operators.decode import counts, decode
from lamella.operators.encode import encode
from lamella.plans.schema import Node

# Fixed values of the format.
MAGIC = b"CRBN"
FORMAT_VERSION = 1


def is_self_describing(data: bytes) -> bool:
    return bytes(data[:4]) == MAGIC


def frame(node: Node, blob: bytes) -> bytes:
    schema = node.to_bytes()
    return MAGIC + varint.write_one(FORMAT_VERSION) + varint.write_one(len(schema)) + schema + blob


def peek_schema(data: bytes | memoryview) -> tuple[Node, memoryview]:
    """The writer's schema, and the blob behind it, unread."""
    view = memoryview(data).cast("B")
    if not is_self_describing(view):
        raise Malformed("Malformed: the magic bytes are missing")
    version, at = varint.read_one(view, 4)
    if version == 0:
        raise Malformed("Malformed: frame version 0")
    if version > FORMAT_VERSION:
        raise UnsupportedVersion("frame", version, FORMAT_VERSION)
    n, at = varint.read_one(view, at)
    if len(view) - at < n:
        raise UnexpectedEof
    return Node.from_bytes(bytes(view[at : at + n])), view[at + n :]


def fingerprint(node: Node) -> str:
    """Sixteen hexadecimal digits that tell a schema from others, as its bytes do."""
    return hashlib.sha256(node.to_bytes()).hexdigest()[:16]


def split_frames(data: bytes | memoryview) -> Iterator[tuple[Node, memoryview]]:
    """The frames that follow one another in these bytes, one at least. A last frame alone is not measured, so that its decoder tells what is wrong with it."""
    view = memoryview(data).cast("B")
    while True:
        node, blob = peek_schema(view)
        _, lengths, at = counts(node, blob)
        end = at + sum(lengths)
        if len(blob) <= end or not is_self_describing(blob[end : end + 4]):
            yield node, blob
            return
        yield node, blob[:end]
        view = blob[end:]


def to_frame(node: Node, array: pa.Array) -> bytes:
    return frame(node, encode(node, array))


def from_frame(data: bytes) -> tuple[Node, pa.Array]:
    node, blob = peek_schema(data)
    return node, decode(node, blob)
