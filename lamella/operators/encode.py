"""Arrow arrays to the physical columns of a blob, a whole column at a time."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lamella.errors import IncompleteRow, LamellaError, SchemaMismatch
from lamella.functions import varint
from lamella.plans.layout import own_columns, variant_width, width
from lamella.plans.schema import Bytes, Convert, Enum, Map, Newtype, Node, Option, Primitive, Seq, Shared, String, Struct, Tuple, TupleStruct, Unit, UnitStruct, arrow_type, bare, boxed, field_name, logical, nullable

_DTYPES = {"bool": "u1", "i8": "i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "u8": "u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "f32": "<f4", "f64": "<f8", "char": "<u4"}


def dtype(kind: str) -> np.dtype:
    return np.dtype(_DTYPES[kind])


class Batch:
    """Rows of one schema, gathered into columns. A batch of rows that fails leaves the columns as they were."""

    def __init__(self, node: Node):
        self.node = node
        self.columns: list[list[bytes]] = [[] for _ in range(width(node))]
        self.rows = 0

    def push(self, array: pa.Array) -> None:
        """Appends the rows of an array of the schema's column type."""
        array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
        if array.type != arrow_type(self.node):
            array = array.cast(arrow_type(self.node))
        new: list[list[bytes]] = [[] for _ in self.columns]
        _encode(self.node, array, np.arange(len(array)), new, 0, "")
        for have, more in zip(self.columns, new, strict=True):
            have += more
        self.rows += len(array)

    def push_rows(self, values: list) -> None:
        """Appends Python values: dicts for structs and enums, lists for sequences."""
        self.push(pa.array(values, arrow_type(self.node)))

    def reset(self) -> None:
        self.columns = [[] for _ in self.columns]
        self.rows = 0

    def finish(self) -> bytes:
        """The rows as one blob; the batch is empty after it."""
        parts = [b"".join(c) for c in self.columns]
        head = [varint.write_one(self.rows), varint.write_one(len(parts)), *[varint.write_one(len(p)) for p in parts]]
        self.reset()
        return b"".join(head + parts)

    def finish_into(self, out: bytearray) -> None:
        out += self.finish()


def encode(node: Node, array: pa.Array) -> bytes:
    batch = Batch(node)
    batch.push(array)
    return batch.finish()


def _whole(arr: pa.Array, path: str) -> None:
    if arr.null_count:
        raise IncompleteRow(f"IncompleteRow: {path or 'the value'} is null in {arr.null_count} rows, and its schema has no option there")


def integers(arr: pa.Array) -> np.ndarray:
    """The values of an integer or 20-digit decimal array, 64 bits wide."""
    if pa.types.is_decimal(arr.type):
        low = np.frombuffer(arr.buffers()[1], "<u8")[2 * arr.offset : 2 * (arr.offset + len(arr))]
        if (low[1::2] != 0).any():
            raise LamellaError("Message: a value does not fit u64")
        return low[::2]
    return arr.to_numpy(zero_copy_only=False)


def _spans(arr: pa.Array) -> tuple[np.ndarray, bytes]:
    """Lengths and joined bytes of a string or binary array without nulls."""
    _, offs, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.int64), b""
    offsets = np.frombuffer(offs, np.int32)[arr.offset : arr.offset + len(arr) + 1]
    return np.diff(offsets), data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data is not None else b""


def code_points(arr: pa.Array, path: str) -> np.ndarray:
    points = np.frombuffer("".join(arr.to_pylist()).encode("utf-32-le"), "<u4")
    if len(points) != len(arr):
        raise SchemaMismatch("strings of one character", "others", path)
    return points


def _encode(node: Node, arr: pa.Array, row: np.ndarray, out: list[list[bytes]], at: int, path: str) -> None:
    """row: the row that each value belongs to."""
    match node:
        case Newtype() if logical(node):
            return _encode(node.inner, _physical(arr, arrow_type(node.inner)), row, out, at, path)
        case Newtype() | Convert():
            return _encode(node.inner, arr, row, out, at, path)
        case Unit() | UnitStruct():
            return _whole(arr, path)
        case Option():
            valid = np.asarray(arr.is_valid())
            out[at].append(valid.astype(np.uint8).tobytes())
            inner = arr.filter(pa.array(valid))
            return _encode(node.inner, inner.field(0) if boxed(node) else inner, row[valid], out, at + 1, path)
    if not (isinstance(node, Shared) and nullable(node)):
        _whole(arr, path)
    match node:
        case Primitive():
            out[at].append(_primitive(node, arr, path))
        case String() | Bytes():
            lengths, data = _spans(arr)
            out[at].append(varint.write_many(lengths))
            out[at + 1].append(data)
        case Seq():
            lengths = np.asarray(pc.list_value_length(arr)).astype(np.int64)
            out[at].append(varint.write_many(lengths))
            _encode(node.inner, arr.flatten(), np.repeat(row, lengths), out, at + 1, f"{path}[]")
        case Map():
            offsets = np.asarray(arr.offsets)
            lengths = np.diff(offsets).astype(np.int64)
            out[at].append(varint.write_many(lengths))
            first, count = int(offsets[0]) if len(offsets) else 0, int(lengths.sum())
            keys, values = arr.keys, arr.items
            if len(keys) != count:
                keys, values = keys.slice(first, count), values.slice(first, count)
            inside = np.repeat(row, lengths)
            _encode(node.key, keys, inside, out, at + 1, f"{path}.key")
            _encode(node.value, values, inside, out, at + 1 + width(node.key), f"{path}.value")
        case Struct() | Tuple() | TupleStruct():
            for k, f in enumerate(node.fields):
                _encode(f.node, _child(arr, k), row, out, at, f"{path}.{field_name(node, f)}".lstrip("."))
                at += width(f.node)
        case Enum():
            _enum(node, arr, row, out, at, path)
        case Shared():
            keys, first = shared_keys(node, arr, row)
            out[at].append(varint.write_many(keys))
            _encode(node.inner, arr.filter(pa.array(first)), row[first], out, at + own_columns(node), path)


def _physical(arr: pa.Array, base: pa.DataType) -> pa.Array:
    """Dates and times as their numbers, decimals as their 16 bytes."""
    if not pa.types.is_decimal(arr.type):
        return arr.cast(base)
    _whole(arr, "a decimal")
    data = arr.buffers()[1].slice(16 * arr.offset, 16 * len(arr)) if len(arr) else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(arr), [None, pa.py_buffer((np.arange(len(arr) + 1) * 16).astype(np.int32)), data])


def _child(arr: pa.StructArray, k: int) -> pa.Array:
    """A child as long as its parent, whose own nulls are gone already."""
    return arr.field(k)


def _primitive(node: Primitive, arr: pa.Array, path: str) -> bytes:
    kind = node.kind
    if kind in ("i128", "u128"):
        lengths, data = _spans(arr)
        if (lengths != 16).any():
            raise SchemaMismatch("16 bytes", "others", path)
        if node.nonzero and any(data[i : i + 16] == bytes(16) for i in range(0, len(data), 16)):
            raise LamellaError(f"Message: {path} is zero")
        return data
    if kind == "char":
        return code_points(arr, path).tobytes()
    if kind == "bool":
        return np.asarray(arr.cast(pa.uint8())).tobytes()
    values = integers(arr) if node.integer else arr.to_numpy(zero_copy_only=False)
    if node.integer and len(values):
        low, high = node.bounds()
        if int(values.min()) < low or int(values.max()) > high:
            raise LamellaError(f"Message: {path or 'the value'}: a value does not fit {kind}")
        if node.nonzero and (values == 0).any():
            raise LamellaError(f"Message: {path or 'the value'} is zero")
    return values.astype(dtype(kind)).tobytes()


def _enum(node: Enum, arr: pa.StructArray, row: np.ndarray, out: list[list[bytes]], at: int, path: str) -> None:
    tags = arr.field(0)
    _whole(tags, f"{path}.tag")
    number = pc.index_in(tags, pa.array([v.name for v in node.variants], pa.string()))
    if number.null_count:
        strange = tags.filter(number.is_null())[0].as_py()
        raise SchemaMismatch(f"a variant of {node.name}", repr(strange), path)
    number = np.asarray(number).astype(np.int64)
    out[at].append(varint.write_many(number))
    at += 1
    child = 1
    for i, v in enumerate(node.variants):
        if v.payload is not None:
            mine = number == i
            _encode(v.payload, arr.field(child).filter(pa.array(mine)), row[mine], out, at, f"{path}.{v.name}".lstrip("."))
            child += 1
        at += variant_width(v)


def codes_of(node: Node, arr: pa.Array) -> np.ndarray:
    """A number for each value, equal for equal values; floats by their bits."""
    inner = bare(node)
    if isinstance(inner, Primitive) and inner.float and not arr.null_count:
        return np.unique(arr.to_numpy(zero_copy_only=False).view(f"u{inner.width}"), return_inverse=True)[1]
    if isinstance(inner, Primitive | String | Bytes):
        return np.asarray(arr.dictionary_encode().indices.fill_null(-1)).astype(np.int64)
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(pickle.dumps(v.as_py()), len(seen)) for v in arr), np.int64, len(arr))


def shared_keys(node: Shared, arr: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value's key in its row's dictionary, in order of first occurrence, and which values are such."""
    if not len(arr):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    codes = codes_of(node.inner, arr) + 1
    pair = row.astype(np.int64) * (int(codes.max()) + 1) + codes
    _, first_at, which = np.unique(pair, return_index=True, return_inverse=True)
    first = np.zeros(len(arr), bool)
    first[first_at] = True
    # firsts are numbered within their row as they come
    number = np.cumsum(first) - 1
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    base = np.repeat(number[starts], np.diff(np.append(starts, len(row))))
    keys = number - base
    return keys[first_at][which], first
