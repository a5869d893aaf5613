"""Schemas of common types, and column functions for their values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.plans.schema import Bytes, Enum, Map, Node, Option, Primitive, Seq, String, Struct, Tuple, TupleStruct, Unit, Variant

_PLAIN = {k: Primitive(k) for k in ("bool", "i8", "i16", "i32", "i64", "i128", "u8", "u16", "u32", "u64", "u128", "f32", "f64", "char")}
BOOL, I8, I16, I32, I64, I128, U8, U16, U32, U64, U128, F32, F64, CHAR = _PLAIN.values()
USIZE, ISIZE = U64, I64
STRING, BYTES, UNIT, PATH, PHANTOM = String(), Bytes(), Unit(), String(), Unit()

# The twelve integers that are never zero, on the wire the same as the plain ones.
NONZERO = {f"NonZero{k.upper()}": Primitive(k, nonzero=True) for k in ("u8", "u16", "u32", "u64", "u128", "i8", "i16", "i32", "i64", "i128")} | {"NonZeroUsize": Primitive("u64", nonzero=True), "NonZeroIsize": Primitive("i64", nonzero=True)}


def option(t: Node) -> Node:
    return Option(t)


def sequence(t: Node) -> Node:
    """Vectors, slices, deques, linked lists and heaps, in their own order."""
    return Seq(t)


def hash_set(t: Node) -> Node:
    return Seq(t, order="set")


def sorted_set(t: Node) -> Node:
    return Seq(t, order="sorted")


def array(t: Node, n: int) -> Node:
    """A fixed-size array is a tuple of n."""
    return Tuple([t] * n)


def tuple_of(*ts: Node) -> Node:
    return Tuple(ts)


def mapping(key: Node, value: Node) -> Node:
    return Map(key, value)


def transparent(t: Node) -> Node:
    """References, boxes, counted pointers, copy-on-write and wrapping numbers are what they hold."""
    return t


def value_range(t: Node, inclusive: bool = False) -> Node:
    return Struct("RangeInclusive" if inclusive else "Range", [("start", t), ("end", t)])


def bound(t: Node) -> Node:
    return Enum("Bound", [Variant("Unbounded"), Variant("Included", "newtype", [t]), Variant("Excluded", "newtype", [t])])


def result(ok: Node, err: Node) -> Node:
    return Enum("Result", [Variant("Ok", "newtype", [ok]), Variant("Err", "newtype", [err])])


IPV4, IPV6 = array(U8, 4), array(U8, 16)
IP = Enum("IpAddr", [Variant("V4", "newtype", [IPV4]), Variant("V6", "newtype", [IPV6])])
SOCKET_V4, SOCKET_V6 = Tuple([IPV4, U16]), Tuple([IPV6, U16])
SOCKET = Enum("SocketAddr", [Variant("V4", "newtype", [SOCKET_V4]), Variant("V6", "newtype", [SOCKET_V6])])
DURATION = Struct("Duration", [("secs", U64), ("nanos", U32)])
SYSTEM_TIME = Struct("SystemTime", [("secs_since_epoch", U64), ("nanos_since_epoch", U32)])


# The names of vector, quaternion and matrix types, their component and how many there are, column by column.
_COMPONENTS = {
    "Vec2": (F32, 2), "Vec3": (F32, 3), "Vec3A": (F32, 3), "Vec4": (F32, 4),
    "DVec2": (F64, 2), "DVec3": (F64, 3), "DVec4": (F64, 4),
    "I8Vec2": (I8, 2), "I8Vec3": (I8, 3), "I8Vec4": (I8, 4),
    "U8Vec2": (U8, 2), "U8Vec3": (U8, 3), "U8Vec4": (U8, 4),
    "I16Vec2": (I16, 2), "I16Vec3": (I16, 3), "I16Vec4": (I16, 4),
    "U16Vec2": (U16, 2), "U16Vec3": (U16, 3), "U16Vec4": (U16, 4),
    "IVec2": (I32, 2), "IVec3": (I32, 3), "IVec4": (I32, 4),
    "UVec2": (U32, 2), "UVec3": (U32, 3), "UVec4": (U32, 4),
    "I64Vec2": (I64, 2), "I64Vec3": (I64, 3), "I64Vec4": (I64, 4),
    "U64Vec2": (U64, 2), "U64Vec3": (U64, 3), "U64Vec4": (U64, 4),
    "ISizeVec2": (ISIZE, 2), "ISizeVec3": (ISIZE, 3), "ISizeVec4": (ISIZE, 4),
    "USizeVec2": (USIZE, 2), "USizeVec3": (USIZE, 3), "USizeVec4": (USIZE, 4),
    "BVec2": (BOOL, 2), "BVec3": (BOOL, 3), "BVec4": (BOOL, 4),
    "Quat": (F32, 4), "DQuat": (F64, 4),
    "Mat2": (F32, 4), "Mat3": (F32, 9), "Mat3A": (F32, 9), "Mat4": (F32, 16), "Affine2": (F32, 6), "Affine3": (F32, 12), "Affine3A": (F32, 12),
    "DMat2": (F64, 4), "DMat3": (F64, 9), "DMat4": (F64, 16), "DAffine2": (F64, 6), "DAffine3": (F64, 12),
}
# The orders of three rotations, in the order of their tags.
_ROTATIONS = "ZYX ZXY YXZ YZX XYZ XZY ZYZ ZXZ YXY YZY XYX XZX ZYXEx ZXYEx YXZEx YZXEx XYZEx XZYEx ZYZEx ZXZEx YXYEx YZYEx XYXEx XZXEx".split()

MATH: dict[str, Node] = {name: TupleStruct(name, [kind] * n) for name, (kind, n) in _COMPONENTS.items()} | {"EulerRot": Enum("EulerRot", [Variant(r) for r in _ROTATIONS])}


# Values --------------------------------------------------------------------


_SECOND = 1_000_000_000


def _whole(value: Column, by: int) -> Column:
    """How often a 64-bit number holds another, rounded down; no double comes in."""
    value = value.cast("bigint")
    return F.call_function("div", value - F.pmod(value, F.lit(by).cast("bigint")), F.lit(by).cast("bigint"))


def duration(secs: Column, nanos: Column) -> Column:
    """A duration with nanoseconds below a second; whole seconds carry over, and what exceeds u64 raises."""
    total = secs.cast("decimal(20,0)") + _whole(nanos, _SECOND).cast("decimal(20,0)")
    told = F.raise_error(F.lit("the duration exceeds 64 bits of seconds")).cast("decimal(20,0)")
    return F.struct(F.when(total > F.lit("18446744073709551615").cast("decimal(20,0)"), told).otherwise(total.cast("decimal(20,0)")).alias("secs"), F.pmod(nanos.cast("bigint"), F.lit(_SECOND).cast("bigint")).alias("nanos"))


def system_time(ts: Column, extra_nanos: Column | None = None) -> Column:
    """A timestamp (microseconds) and nanoseconds below one, as time since the epoch; earlier times raise."""
    micros = F.unix_micros(ts)
    secs = F.when(micros < 0, F.raise_error(F.lit("the time is before the epoch")).cast("bigint")).otherwise(_whole(micros, 1_000_000))
    nanos = F.pmod(micros, F.lit(1_000_000)) * 1000 + (extra_nanos if extra_nanos is not None else F.lit(0))
    return F.struct(secs.cast("decimal(20,0)").alias("secs_since_epoch"), nanos.cast("bigint").alias("nanos_since_epoch"))


def timestamp(time: Column) -> Column:
    """The timestamp of a system time; nanoseconds are cut off."""
    return F.timestamp_micros((time["secs_since_epoch"] * 1_000_000).cast("bigint") + _whole(time["nanos_since_epoch"], 1000))


def _octets(values: Column, n: int) -> Column:
    return F.struct(*[F.get(values, F.lit(i)).cast("smallint").alias(f"_{i}") for i in range(n)])


def _refused(what: str, text: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not {what}: "), text))


def ipv4(text: Column) -> Column:
    """Four octets from dotted text; null for null, and other texts raise."""
    fits = text.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:[.](?!\z)|\z)){4}\z")
    got = _octets(F.split(text, r"\."), 4)
    return F.when(fits, got).when(text.isNotNull(), _refused("an IPv4 address", text).cast("struct<_0:smallint,_1:smallint,_2:smallint,_3:smallint>"))


def ipv4_text(ip: Column) -> Column:
    return F.concat_ws(".", *[ip[f"_{i}"].cast("string") for i in range(4)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6(text: Column) -> Column:
    """Sixteen octets from text of eight groups, shortened by :: or not, the last two maybe dotted; null for null, and other texts raise."""
    kind = "struct<" + ",".join(f"_{i}:smallint" for i in range(16)) + ">"

    def undotted(t: Column) -> Column:
        """The text with dotted octets at its end as two groups; octets beyond 255 make it no address."""
        four = F.transform(F.split(F.regexp_extract(t, "[^:]*$", 0), "[.]"), lambda x: x.try_cast("int"))
        pair = lambda f: F.concat(F.hex(F.get(f, F.lit(0)) * 256 + F.get(f, F.lit(1))), F.lit(":"), F.hex(F.get(f, F.lit(2)) * 256 + F.get(f, F.lit(3))))
        tail = _let(four, lambda f: F.when((F.size(f) == 4) & F.forall(f, lambda x: x.between(0, 255)), pair(f)).otherwise("none"))
        return F.when(t.contains("."), F.concat(F.regexp_extract(t, "^(.*:)[^:]*$", 1), tail)).otherwise(t)

    def groups(t: Column) -> Column:
        """The eight groups, zeros in place of ::. Null where the text is no address."""
        some = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
        whole = lambda h, e: F.concat(h, F.array_repeat(F.lit("0"), F.lit(8) - F.size(h) - F.size(e)), e)
        short = _let(some(F.substring_index(t, "::", 1)), lambda h: _let(some(F.regexp_extract(t, "::(.*)$", 1)), lambda e: F.when(F.size(h) + F.size(e) < 8, whole(h, e))))
        odd = t.rlike(r"[^0-9a-fA-F:]|[0-9a-fA-F]{5}|^:[^:]|[^:]:\z|:::|::.*::")
        return F.when(odd, None).when(t.contains("::"), short).otherwise(some(t))

    def packed(g: Column) -> Column:
        octets = F.flatten(F.transform(g, lambda x: _let(F.conv(x, 16, 10).cast("bigint"), lambda v: F.array(_whole(v, 256), F.pmod(v, F.lit(256).cast("bigint"))))))
        return F.when(F.size(g) == 8, _let(octets, lambda o: _octets(o, 16)))

    read = _let(undotted(text), lambda t: _let(groups(t), packed))
    return F.when(text.isNotNull(), F.coalesce(read, _refused("an IPv6 address", text).cast(kind)))


def ipv6_text(ip: Column) -> Column:
    """Eight groups without leading zeros, the first of the longest rows of zero groups as ::."""

    def shortest(groups: Column) -> Column:
        # a group of zeros by a space, so that rows of them are found in one text
        signs = F.array_join(F.transform(groups, lambda g: F.when(g == "0", " ").otherwise("x")), "")
        longest = lambda s: F.array_max(F.transform(F.regexp_extract_all(s, F.lit("( {2,})"), F.lit(1)), F.length))
        joined = lambda n, at: F.concat(F.array_join(F.slice(groups, F.lit(1), at - 1), ":"), F.lit("::"), F.array_join(F.slice(groups, at + n, F.lit(8)), ":"))
        cut = lambda s, n: _let(F.call_function("locate", F.repeat(F.lit(" "), n), s), lambda at: joined(n, at))
        return _let(signs, lambda s: _let(longest(s), lambda n: F.when(n.isNull(), F.array_join(groups, ":")).otherwise(cut(s, n))))

    hexed = lambda x: F.array(*[F.lower(F.hex(x[f"_{2 * i}"].cast("bigint") * 256 + x[f"_{2 * i + 1}"])) for i in range(8)])
    return F.when(ip.isNotNull(), _let(ip, lambda x: _let(hexed(x), shortest)))


def ip_address(text: Column) -> Column:
    """An address of either kind: a variant and its octets."""
    six = text.contains(":")
    return F.when(text.isNotNull(), F.struct(F.when(six, "V6").otherwise("V4").alias("tag"), F.when(~six, ipv4(F.when(~six, text))).alias("V4"), F.when(six, ipv6(F.when(six, text))).alias("V6")))


def socket(ip: Column, port: Column) -> Column:
    """Address (octets of either kind) and port; flow and scope of the longer kind have no place on the wire."""
    return F.struct(ip.alias("_0"), port.cast("int").alias("_1"))


def bound_of(value: Column, kind: Column) -> Column:
    """One end of a range: kind is Included, Excluded or Unbounded, whose value is left out."""
    return F.struct(kind.alias("tag"), F.when(kind == "Included", value).alias("Included"), F.when(kind == "Excluded", value).alias("Excluded"))


def range_of(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def as_set(values: Column, ordered: bool = False) -> Column:
    """Distinct values, in first order or ascending."""
    return F.sort_array(F.array_distinct(values)) if ordered else F.array_distinct(values)
