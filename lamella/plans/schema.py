"""Schemas: a tree of nodes with bytes, a JSON form, a description, and Spark and Arrow types.

One tree serves the writer and the reader. What only a reader says (defaults, aliases, names no longer in use,
conversions) lies on the same nodes, takes no part in equality and never reaches the bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from lamella.errors import DepthLimitExceeded, Malformed, SchemaMismatch, TrailingBytes, UnexpectedEof, Unsupported, UnsupportedVersion, Untraceable
from lamella.functions import varint

# Fixed values of the format: version, depth, and the tags of nodes and variants.
SCHEMA_VERSION = 1
MAX_DEPTH = 256
#: name: (tag, bytes, signed for integers else None)
PRIMITIVES: dict[str, tuple[int, int, bool | None]] = {
    "bool": (0, 1, None),
    "i8": (1, 1, True),
    "i16": (2, 2, True),
    "i32": (3, 4, True),
    "i64": (4, 8, True),
    "i128": (5, 16, True),
    "u8": (6, 1, False),
    "u16": (7, 2, False),
    "u32": (8, 4, False),
    "u64": (9, 8, False),
    "u128": (10, 16, False),
    "f32": (11, 4, None),
    "f64": (12, 8, None),
    "char": (13, 4, None),
}
_BY_TAG = {v[0]: k for k, v in PRIMITIVES.items()}
STRING, BYTES, UNIT, OPTION, UNIT_STRUCT, NEWTYPE, SEQ, TUPLE, TUPLE_STRUCT, MAP, STRUCT, ENUM, SHARED = range(14, 27)

MISSING: Any = type("Missing", (), {"__repr__": lambda self: "MISSING"})()


class Node:
    """A type. Subclasses are frozen; equality is structural."""

    def children(self) -> Iterator[Node]:
        return iter(())

    def to_bytes(self) -> bytes:
        return varint.write_one(SCHEMA_VERSION) + self._bytes()

    def _bytes(self) -> bytes:
        raise NotImplementedError

    def to_json(self) -> str:
        """The bytes as a JSON array of numbers."""
        return json.dumps(list(self.to_bytes()))

    @staticmethod
    def from_json(text: str) -> Node:
        return Node.from_bytes(bytes(json.loads(text)))

    @staticmethod
    def from_bytes(data: bytes) -> Node:
        version, at = varint.read_one(data)
        if version == 0:
            raise Malformed("schema version 0")
        if version > SCHEMA_VERSION:
            raise UnsupportedVersion("schema", version, SCHEMA_VERSION)
        reader = _Reader(data, at)
        node = reader.node(0)
        if reader.at != len(data):
            raise TrailingBytes
        return node

    def describe(self) -> str:
        raise NotImplementedError

    def __str__(self) -> str:
        return self.describe()


@dataclass(frozen=True)
class Primitive(Node):
    kind: str
    #: zero is refused on reading and writing
    nonzero: bool = field(default=False, compare=False)

    def __post_init__(self) -> None:
        if self.kind not in PRIMITIVES:
            raise Unsupported(f"there is no primitive {self.kind}")

    @property
    def width(self) -> int:
        return PRIMITIVES[self.kind][1]

    @property
    def signed(self) -> bool | None:
        return PRIMITIVES[self.kind][2]

    @property
    def integer(self) -> bool:
        return self.signed is not None

    @property
    def float(self) -> bool:
        return self.kind in ("f32", "f64")

    def bounds(self) -> tuple[int, int]:
        bits = 8 * self.width
        return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if self.signed else (0, (1 << bits) - 1)

    def _bytes(self) -> bytes:
        return bytes([PRIMITIVES[self.kind][0]])

    def describe(self) -> str:
        return self.kind


@dataclass(frozen=True)
class _Leaf(Node):
    def _bytes(self) -> bytes:
        return bytes([self._tag])

    def describe(self) -> str:
        return self._word


@dataclass(frozen=True)
class String(_Leaf):
    _tag, _word = STRING, "string"


@dataclass(frozen=True)
class Bytes(_Leaf):
    _tag, _word = BYTES, "bytes"


@dataclass(frozen=True)
class Unit(_Leaf):
    _tag, _word = UNIT, "unit"


@dataclass(frozen=True)
class _Wrapper(Node):
    inner: Node

    def children(self) -> Iterator[Node]:
        yield self.inner

    def _bytes(self) -> bytes:
        return bytes([self._tag]) + self.inner._bytes()

    def describe(self) -> str:
        return f"{self._word}<{self.inner.describe()}>"


@dataclass(frozen=True)
class Option(_Wrapper):
    _tag, _word = OPTION, "option"


@dataclass(frozen=True)
class Seq(_Wrapper):
    _tag, _word = SEQ, "seq"
    #: "set": distinct elements; "sorted": distinct in ascending order (as written by this library)
    order: str = field(default="", compare=False)


@dataclass(frozen=True)
class Shared(_Wrapper):
    _tag, _word = SHARED, "shared"


def _name(name: str) -> bytes:
    raw = name.encode()
    return varint.write_one(len(raw)) + raw


@dataclass(frozen=True)
class UnitStruct(Node):
    name: str

    def _bytes(self) -> bytes:
        return bytes([UNIT_STRUCT]) + _name(self.name)

    def describe(self) -> str:
        return f"unit struct {self.name}"


@dataclass(frozen=True)
class Newtype(Node):
    name: str
    inner: Node

    def children(self) -> Iterator[Node]:
        yield self.inner

    def _bytes(self) -> bytes:
        return bytes([NEWTYPE]) + _name(self.name) + self.inner._bytes()

    def describe(self) -> str:
        return f"{self.name}({self.inner.describe()})"


@dataclass(frozen=True)
class Field:
    """A named field. For tuple structs the name is the position."""

    name: str
    node: Node
    default: Any = field(default=MISSING, compare=False)
    aliases: tuple[str, ...] = field(default=(), compare=False)

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)


def _fields(items: Any) -> tuple[Field, ...]:
    return tuple(x if isinstance(x, Field) else Field(*x) for x in items)


def _positions(items: Any) -> tuple[Field, ...]:
    return tuple(Field(str(i), x.node, x.default, x.aliases) if isinstance(x, Field) else Field(str(i), x) for i, x in enumerate(items))


@dataclass(frozen=True)
class _Product(Node):
    def children(self) -> Iterator[Node]:
        for f in self.fields:
            yield f.node

    @property
    def nodes(self) -> tuple[Node, ...]:
        return tuple(f.node for f in self.fields)


def _plain(fields: tuple[Field, ...]) -> bytes:
    return varint.write_one(len(fields)) + b"".join(f.node._bytes() for f in fields)


def _named(fields: tuple[Field, ...]) -> bytes:
    return varint.write_one(len(fields)) + b"".join(_name(f.name) + f.node._bytes() for f in fields)


@dataclass(frozen=True)
class Tuple(_Product):
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", _positions(self.fields))

    def _bytes(self) -> bytes:
        return bytes([TUPLE]) + _plain(self.fields)

    def describe(self) -> str:
        return f"({', '.join(x.describe() for x in self.nodes)})"


@dataclass(frozen=True)
class TupleStruct(_Product):
    name: str
    fields: tuple[Field, ...]
    removed: tuple[int | str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", _positions(self.fields))

    def _bytes(self) -> bytes:
        return bytes([TUPLE_STRUCT]) + _name(self.name) + _plain(self.fields)

    def describe(self) -> str:
        return f"{self.name}({', '.join(x.describe() for x in self.nodes)})"


@dataclass(frozen=True)
class Struct(_Product):
    name: str
    fields: tuple[Field, ...]
    removed: tuple[int | str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", _fields(self.fields))

    def _bytes(self) -> bytes:
        return bytes([STRUCT]) + _name(self.name) + _named(self.fields)

    def describe(self) -> str:
        return f"{self.name} {{{', '.join(f'{f.name}: {f.node.describe()}' for f in self.fields)}}}"


@dataclass(frozen=True)
class Map(Node):
    key: Node
    value: Node

    def children(self) -> Iterator[Node]:
        yield self.key
        yield self.value

    def _bytes(self) -> bytes:
        return bytes([MAP]) + self.key._bytes() + self.value._bytes()

    def describe(self) -> str:
        return f"map<{self.key.describe()}, {self.value.describe()}>"


@dataclass(frozen=True)
class Variant:
    """One case of an enum. kind: unit, newtype, tuple or struct."""

    name: str
    kind: str = "unit"
    fields: tuple[Field, ...] = ()
    aliases: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", _fields(self.fields) if self.kind == "struct" else _positions(self.fields))
        if {"unit": self.fields == (), "newtype": len(self.fields) == 1}.get(self.kind, self.kind in ("tuple", "struct")) is False:
            raise SchemaMismatch(f"the fields of a {self.kind} variant", f"{len(self.fields)} of them", self.name)

    @property
    def names(self) -> tuple[str, ...]:
        return (self.name, *self.aliases)

    @property
    def payload(self) -> Node | None:
        """The payload as a type of its own; None for a unit variant."""
        if self.kind == "unit":
            return None
        if self.kind == "newtype":
            return self.fields[0].node
        return Tuple(self.fields) if self.kind == "tuple" else Struct(self.name, self.fields)

    def _bytes(self) -> bytes:
        if self.kind == "unit":
            return b"\0"
        if self.kind == "newtype":
            return b"\1" + self.fields[0].node._bytes()
        return b"\2" + _plain(self.fields) if self.kind == "tuple" else b"\3" + _named(self.fields)

    def describe(self) -> str:
        if self.kind == "unit":
            return self.name
        inside = ", ".join(f"{f.name}: {f.node.describe()}" if self.kind == "struct" else f.node.describe() for f in self.fields)
        return f"{self.name} {{{inside}}}" if self.kind == "struct" else f"{self.name}({inside})"


@dataclass(frozen=True)
class Enum(Node):
    name: str
    variants: tuple[Variant, ...]
    removed: tuple[int | str, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "variants", tuple(v if isinstance(v, Variant) else Variant(v) for v in self.variants))

    def children(self) -> Iterator[Node]:
        for v in self.variants:
            for f in v.fields:
                yield f.node

    def _bytes(self) -> bytes:
        return bytes([ENUM]) + _name(self.name) + varint.write_one(len(self.variants)) + b"".join(_name(v.name) + v._bytes() for v in self.variants)

    def describe(self) -> str:
        return f"enum {self.name} [{' | '.join(v.describe() for v in self.variants)}]"


@dataclass(frozen=True)
class Convert(Node):
    """A value kept in another representation: read turns the representation's column into the value's, write back.

    Only the representation is on the wire and in equality.
    """

    inner: Node
    read: Any = field(compare=False)
    write: Any = field(compare=False)
    spark: str = field(default="", compare=False)

    def __post_init__(self) -> None:
        if (self.read is None) != (self.write is None):
            raise Unsupported("a conversion needs both directions")

    def children(self) -> Iterator[Node]:
        yield self.inner

    def __eq__(self, other: object) -> bool:
        return self.inner == (other.inner if isinstance(other, Convert) else other)

    def __hash__(self) -> int:
        return hash(self.inner)

    def _bytes(self) -> bytes:
        return self.inner._bytes()

    def describe(self) -> str:
        return self.inner.describe()


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise UnexpectedEof
        self.at += 1
        return self.data[self.at - 1]

    def number(self) -> int:
        value, self.at = varint.read_one(self.data, self.at)
        return value

    def name(self) -> str:
        n = self.number()
        if len(self.data) - self.at < n:
            raise UnexpectedEof
        self.at += n
        try:
            return self.data[self.at - n : self.at].decode()
        except UnicodeDecodeError as e:
            from lamella.errors import InvalidUtf8

            raise InvalidUtf8 from e

    def plain(self, depth: int) -> list[Node]:
        return [self.node(depth) for _ in range(self.number())]

    def named(self, depth: int) -> list[Field]:
        return [Field(self.name(), self.node(depth)) for _ in range(self.number())]

    def node(self, depth: int) -> Node:
        if depth >= MAX_DEPTH:
            raise DepthLimitExceeded
        tag, deeper = self.byte(), depth + 1
        if tag in _BY_TAG:
            return Primitive(_BY_TAG[tag])
        match tag:
            case 14 | 15 | 16:
                return (String, Bytes, Unit)[tag - 14]()
            case 17 | 20 | 26:
                return {OPTION: Option, SEQ: Seq, SHARED: Shared}[tag](self.node(deeper))
            case 18:
                return UnitStruct(self.name())
            case 19:
                return Newtype(self.name(), self.node(deeper))
            case 21:
                return Tuple(self.plain(deeper))
            case 22:
                return TupleStruct(self.name(), self.plain(deeper))
            case 23:
                return Map(self.node(deeper), self.node(deeper))
            case 24:
                return Struct(self.name(), self.named(deeper))
            case 25:
                return Enum(self.name(), [self.variant(deeper) for _ in range(self.number())])
        raise Malformed(f"schema tag {tag}")

    def variant(self, depth: int) -> Variant:
        if depth >= MAX_DEPTH:
            raise DepthLimitExceeded
        name, deeper = self.name(), depth + 1
        match self.byte():
            case 0:
                return Variant(name)
            case 1:
                return Variant(name, "newtype", [self.node(deeper)])
            case 2:
                return Variant(name, "tuple", self.plain(deeper))
            case 3:
                return Variant(name, "struct", self.named(deeper))
        raise Malformed("variant tag")


# Types of columns -----------------------------------------------------------

#: name: (Spark, Arrow). Unsigned types lie in the next wider one; 128-bit integers are 16 little-endian bytes.
_COLUMNS: dict[str, tuple[T.DataType, pa.DataType]] = {
    "bool": (T.BooleanType(), pa.bool_()),
    "i8": (T.ByteType(), pa.int8()),
    "i16": (T.ShortType(), pa.int16()),
    "i32": (T.IntegerType(), pa.int32()),
    "i64": (T.LongType(), pa.int64()),
    "i128": (T.BinaryType(), pa.binary()),
    "u8": (T.ShortType(), pa.int16()),
    "u16": (T.IntegerType(), pa.int32()),
    "u32": (T.LongType(), pa.int64()),
    "u64": (T.DecimalType(20, 0), pa.decimal128(20, 0)),
    "u128": (T.BinaryType(), pa.binary()),
    "f32": (T.FloatType(), pa.float32()),
    "f64": (T.DoubleType(), pa.float64()),
    "char": (T.StringType(), pa.string()),
}


def logical(node: Node) -> tuple[T.DataType, pa.DataType] | None:
    """The Spark and Arrow types of a newtype that stands for a type the model lacks."""
    if isinstance(node, Newtype) and isinstance(node.inner, Primitive):
        if (node.name, node.inner.kind) in _LOGICAL:
            return _LOGICAL[node.name, node.inner.kind]
        if node.inner.kind == "i128" and (m := re.fullmatch(r"decimal\((\d+),(\d+)\)", node.name)):
            return T.DecimalType(int(m[1]), int(m[2])), pa.decimal128(int(m[1]), int(m[2]))
    return None


_LOGICAL = {
    ("date", "i32"): (T.DateType(), pa.date32()),
    ("timestamp_us", "i64"): (T.TimestampType(), pa.timestamp("us", "UTC")),
    ("timestamp_ntz_us", "i64"): (T.TimestampNTZType(), pa.timestamp("us")),
}


def register_logical(name: str, base: str, spark: T.DataType, arrow: pa.DataType) -> None:
    """Gives newtypes of this name over this primitive a column type of their own. Arrow must cast between it and the primitive's
    column type both ways; the bytes stay the primitive's. Register on the driver and on workers (import it from a module)."""
    _LOGICAL[name, base] = (spark, arrow)


def bare(node: Node) -> Node:
    """The node without wrappers that have no columns of their own."""
    while isinstance(node, Newtype | Convert):
        node = node.inner
    return node


def nullable(node: Node) -> bool:
    """Whether null is a value of the node's column."""
    node = bare(node)
    return isinstance(node, Option) or isinstance(node, Shared) and nullable(node.inner)


def boxed(option: Option) -> bool:
    """Whether an option's column wraps its value in a struct, as null already means something inside."""
    return nullable(option.inner)


def field_name(product: Node, f: Field) -> str:
    return f.name if isinstance(product, Struct) else f"_{f.name}"


def spark_type(node: Node) -> T.DataType:
    """The column type. Units are booleans that are always true."""
    match node:
        case Convert():
            return T._parse_datatype_string(node.spark) if node.spark else spark_type(node.inner)
        case Newtype() if known := logical(node):
            return known[0]
        case Newtype() | Shared():
            return spark_type(node.inner)
        case Primitive():
            return _COLUMNS[node.kind][0]
        case String():
            return T.StringType()
        case Bytes():
            return T.BinaryType()
        case Unit() | UnitStruct():
            return T.BooleanType()
        case Option():
            return T.StructType([T.StructField("value", spark_type(node.inner), True)]) if boxed(node) else spark_type(node.inner)
        case Seq():
            return T.ArrayType(spark_type(node.inner), nullable(node.inner))
        case Map():
            return T.MapType(spark_type(node.key), spark_type(node.value), nullable(node.value))
        case Enum():
            return T.StructType([T.StructField("tag", T.StringType(), False)] + [T.StructField(v.name, spark_type(v.payload), True) for v in node.variants if v.payload is not None])
        case Tuple() | TupleStruct() | Struct():
            return T.StructType([T.StructField(field_name(node, f), spark_type(f.node), nullable(f.node)) for f in node.fields])
    raise Unsupported(f"no column type for {node}")


def arrow_type(node: Node) -> pa.DataType:
    match node:
        case Newtype() if known := logical(node):
            return known[1]
        case Newtype() | Shared() | Convert():
            return arrow_type(node.inner)
        case Primitive():
            return _COLUMNS[node.kind][1]
        case String():
            return pa.string()
        case Bytes():
            return pa.binary()
        case Unit() | UnitStruct():
            return pa.bool_()
        case Option():
            return pa.struct([pa.field("value", arrow_type(node.inner))]) if boxed(node) else arrow_type(node.inner)
        case Seq():
            return pa.list_(arrow_type(node.inner))
        case Map():
            return pa.map_(arrow_type(node.key), arrow_type(node.value))
        case Enum():
            return pa.struct([pa.field("tag", pa.string())] + [pa.field(v.name, arrow_type(v.payload)) for v in node.variants if v.payload is not None])
        case Tuple() | TupleStruct() | Struct():
            return pa.struct([pa.field(field_name(node, f), arrow_type(f.node)) for f in node.fields])
    raise Unsupported(f"no column type for {node}")


def struct_type(node: Node) -> T.StructType:
    """The columns of a DataFrame whose rows are this product."""
    node = bare(node)
    if not isinstance(node, Struct | Tuple | TupleStruct):
        return T.StructType([T.StructField("value", spark_type(node), nullable(node))])
    return spark_type(node)


def from_spark(kind: T.DataType, name: str = "Row", required: bool | set[str] = False) -> Node:
    """A schema for data of this Spark type.

    Nullable columns are options. required: True or a set of top-level names that hold no nulls in fact. Types the
    model lacks travel as newtypes named for them over a base: date over i32 days, timestamps over i64 microseconds,
    decimals over i128.
    """

    def build(t: T.DataType, null: bool, depth: int) -> Node:
        if depth >= MAX_DEPTH:
            raise DepthLimitExceeded
        inner = one(t, depth)
        return Option(inner) if null else inner

    def one(t: T.DataType, depth: int) -> Node:
        simple = {T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64"}
        if type(t) in simple:
            return Primitive(simple[type(t)])
        if isinstance(t, T.StringType):
            return String()
        if isinstance(t, T.BinaryType):
            return Bytes()
        if isinstance(t, T.DateType):
            return Newtype("date", Primitive("i32"))
        if isinstance(t, T.TimestampType | T.TimestampNTZType):
            return Newtype("timestamp_us" if isinstance(t, T.TimestampType) else "timestamp_ntz_us", Primitive("i64"))
        if isinstance(t, T.DecimalType):
            return Newtype(f"decimal({t.precision},{t.scale})", Primitive("i128"))
        if isinstance(t, T.ArrayType):
            return Seq(build(t.elementType, t.containsNull, depth + 1))
        if isinstance(t, T.MapType):
            return Map(build(t.keyType, False, depth + 1), build(t.valueType, t.valueContainsNull, depth + 1))
        if isinstance(t, T.StructType):
            if len({f.name for f in t.fields}) < len(t.fields):
                raise Untraceable("two fields of one name")
            return Struct(name if not depth else "", [Field(f.name, build(f.dataType, f.nullable and not (depth == 0 and (required is True or required and f.name in required)), depth + 1)) for f in t.fields])
        raise Untraceable(f"{t.simpleString()} has no place in the model")

    return one(kind, 0)
