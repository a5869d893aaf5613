"""More queries: column types through files, refusals, definitions, frames and streams. Registered with those of the catalogue."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.catalogue import _STATUS, _ORDER, _orders_with_lines, _query, _statuses, rows_of, table, through_blobs
from lamella.errors import LamellaError
from lamella.functions import rename, std_types
from lamella.functions.std_types import BOOL, BYTES, CHAR, F32, F64, I8, I16, I32, I64, NONZERO, STRING, U8, U16, U32, U64, UNIT
from lamella.operators import compat
from lamella.operators.decode import decode, single
from lamella.operators.encode import Batch, encode
from lamella.operators.reconcile import evolve, plan_kind, reconcile
from lamella.plans import derive
from lamella.plans.schema import Convert, Enum, Field, Map, Newtype, Node, Option, Seq, Shared, Struct, Tuple, TupleStruct, UnitStruct, Variant, from_spark
from lamella.sources import blobs
from lamella.sources.scratch import scratch
from lamella.streaming import blobs as streams


def _outcome(act: Callable[[], object]) -> str:
    """"ok", or the class of the error that the library raised."""
    try:
        act()
    except LamellaError as e:
        return type(e).__name__
    return "ok"


def _values(rows: list[tuple], *names: str) -> str:
    """SQL for a fixed answer."""
    told = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(told, r)) + ')' for r in rows)}) t({', '.join(names)})"


# Column types through files --------------------------------------------------------------------------------------------------


@_query("select o_orderkey as key, o_totalprice > 100000 as flag, o_custkey::decimal(20, 0) as usize, -o_custkey as isize, true as nothing, o_orderpriority as place, o_custkey as boxed, true as phantom, ascii(substr(o_orderstatus, 1, 1)) as letter, strlen(o_orderpriority)::int as size from orders")
def type_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, sizes, units, paths, pointers, wrapping numbers, phantoms, chars and bytes."""
    t = std_types.transparent
    node = Struct("Row", [("key", I64), ("flag", BOOL), ("usize", std_types.USIZE), ("isize", std_types.ISIZE), ("nothing", UNIT), ("place", Option(std_types.PATH)), ("boxed", t(t(I64))), ("phantom", std_types.PHANTOM), ("letter", CHAR), ("raw", Option(BYTES))])
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"), (F.col("o_totalprice") > 100000).alias("flag"), F.col("o_custkey").cast("decimal(20,0)").alias("usize"), (-F.col("o_custkey")).alias("isize"), F.lit(True).alias("nothing"),
        F.col("o_orderpriority").alias("place"), F.col("o_custkey").alias("boxed"), F.lit(True).alias("phantom"), F.substring("o_orderstatus", 1, 1).alias("letter"), F.col("o_orderpriority").cast("binary").alias("raw"),
    )
    out = through_blobs(df, node, strict=True)
    return out.select("key", "flag", "usize", "isize", "nothing", "place", "boxed", "phantom", F.ascii("letter").alias("letter"), F.octet_length("raw").alias("size"))


_NONZERO = list(NONZERO)


@_query("select o_orderkey as key, 1 + o_orderkey % 100 as n, true as equal from orders")
def type_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve integers that are never zero, of every width, hold the same number."""
    n = 1 + F.col("o_orderkey") % 100
    wide = F.concat(F.unhex(F.lpad(F.hex(n), 2, "0")), F.unhex(F.lit("00" * 15)))
    big = lambda k: k.endswith("128")
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), *[(wide if big(k) else n.cast(_type_of(NONZERO[k]))).alias(k) for k in _NONZERO])
    out = through_blobs(df, Struct("Row", [("key", I64), *[(k, NONZERO[k]) for k in _NONZERO]]), strict=True)
    n_back = F.col("NonZeroI64")
    same = [F.col(k) == (F.concat(F.unhex(F.lpad(F.hex(n_back), 2, "0")), F.unhex(F.lit("00" * 15))) if big(k) else n_back) for k in _NONZERO]
    return out.select("key", n_back.alias("n"), F.forall(F.array(*same), lambda x: x).alias("equal"))


def _type_of(node: Node):
    from lamella.plans.schema import spark_type

    return spark_type(node)


@_query("select l_orderkey as key, l_linenumber::bigint as line, l_quantity as a, l_returnflag as b, l_linenumber::int as c, 2 as size, l_extendedprice as price, l_tax as tax from lineitem")
def type_tuples_and_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples, arrays of fixed length and maps."""
    node = Struct("Row", [("key", I64), ("line", I64), ("t", std_types.tuple_of(F64, STRING, I32)), ("pair", std_types.array(F64, 2)), ("m", std_types.mapping(STRING, F64))])
    amounts = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("tax"), F.col("l_tax"))
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("line"), F.struct(F.col("l_quantity").alias("_0"), F.col("l_returnflag").alias("_1"), F.col("l_linenumber").cast("int").alias("_2")).alias("t"),
        F.struct(F.col("l_tax").alias("_0"), F.col("l_extendedprice").alias("_1")).alias("pair"), amounts.alias("m"),
    )
    out = through_blobs(df, node)
    return out.select("key", "line", F.col("t._0").alias("a"), F.col("t._1").alias("b"), F.col("t._2").alias("c"), F.size("m").alias("size"), F.col("pair._1").alias("price"), F.col("m")["tax"].alias("tax"))


_V6 = "'2001:db8::' || lower(hex(o_custkey % 65535 + 1)) || ':' || lower(hex(o_orderkey % 65535 + 1))"
_V4 = "'10.' || (o_custkey // 256 % 256) || '.' || (o_custkey % 256) || '.' || (o_orderkey % 256)"


@_query(f"select o_orderkey as key, {_V6} as six, case when o_orderkey % 2 = 0 then 'V4' else 'V6' end as kind, case when o_orderkey % 2 = 0 then {_V4} else {_V6} end as any_kind, (o_custkey % 65536)::int as port, {_V6} as peer from orders")
def type_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to octets of both kinds, addresses of either and sockets, through blobs, and back to text."""
    group = lambda c: F.lower(F.hex(F.col(c) % 65535 + 1))
    six = F.concat(F.lit("2001:db8::"), group("o_custkey"), F.lit(":"), group("o_orderkey"))
    long = F.concat(F.lit("2001:0DB8:0:0:0000:0:"), group("o_custkey"), F.lit(":"), group("o_orderkey"))
    four = F.concat_ws(".", F.lit("10"), F.floor(F.col("o_custkey") / 256) % 256, F.col("o_custkey") % 256, F.col("o_orderkey") % 256)
    either = F.when(F.col("o_orderkey") % 2 == 0, four).otherwise(six)
    port = F.col("o_custkey") % 65536
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), std_types.ipv6(long).alias("six"), std_types.ip_address(either).alias("ip"), std_types.socket(std_types.ipv6(six), port).alias("peer"))
    out = through_blobs(df, Struct("Peer", [("key", I64), ("six", std_types.IPV6), ("ip", std_types.IP), ("peer", std_types.SOCKET_V6)]))
    text = F.coalesce(F.when(F.col("ip.tag") == "V4", std_types.ipv4_text(F.col("ip.V4"))), std_types.ipv6_text(F.col("ip.V6")))
    return out.select("key", std_types.ipv6_text(F.col("six")).alias("six"), F.col("ip.tag").alias("kind"), text.alias("any_kind"), F.col("peer._1").alias("port"), std_types.ipv6_text(F.col("peer._0")).alias("peer"))


_SIX = [
    ("::", "::"), ("::1", "::1"), ("1::", "1::"), ("2001:DB8:0:0:1:0:0:1", "2001:db8::1:0:0:1"), ("2001:db8:0:1:1:1:1:1", "2001:db8:0:1:1:1:1:1"), ("::ffff:192.0.2.128", "::ffff:c000:280"),
    ("1:0:0:2:0:0:0:3", "1:0:0:2::3"), ("fe80:0:0:0:0:0:0:0001", "fe80::1"), ("1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8"), ("0:0:1::", "0:0:1::"),
]


@_query(_values(_SIX, "given", "text"))
def ipv6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways to write an address, and the shortest."""
    given = rows_of(spark, [(a,) for a, _ in _SIX], "given string")
    return given.select("given", std_types.ipv6_text(std_types.ipv6(F.col("given"))).alias("text"))


_KINDS = "['Included', 'Excluded', 'Unbounded'][1 + (p_partkey % 3)::int]"


@_query(f"select p_partkey as key, {_KINDS} as kind, case when p_partkey % 3 < 2 then p_size end as bound from part")
def type_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("Included", "Excluded", "Unbounded"))), (1 + F.col("p_partkey") % 3).cast("int"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), std_types.bound_of(F.col("p_size"), kind).alias("b"))
    out = through_blobs(df, Struct("Part", [("key", I64), ("b", std_types.bound(I32))]))
    return out.select("key", F.col("b.tag").alias("kind"), F.coalesce("b.Included", "b.Excluded").alias("bound"))


@_query("select event_id, (epoch_us(ts) // 1000000)::decimal(20, 0) as secs, (epoch_us(ts) % 1000000 * 1000 + 7)::bigint as nanos, epoch_us(ts)::bigint as micros, (event_id + 3)::decimal(20, 0) as span_secs, 250000000::bigint as span_nanos from events")
def type_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System times and durations through blobs, and back to timestamps."""
    t, d = std_types.system_time(F.col("ts").cast("timestamp"), F.lit(7)), std_types.duration(F.col("event_id"), F.lit(3_250_000_000))
    df = table(spark, sf_dir, "events").select("event_id", t.alias("t"), d.alias("d"))
    out = through_blobs(df, Struct("Event", [("event_id", I64), ("t", std_types.SYSTEM_TIME), ("d", std_types.DURATION)]))
    back = F.unix_micros(std_types.timestamp(F.col("t")))
    return out.select("event_id", F.col("t.secs_since_epoch").alias("secs"), F.col("t.nanos_since_epoch").alias("nanos"), back.alias("micros"), F.col("d.secs").alias("span_secs"), F.col("d.nanos").alias("span_nanos"))


@_query("select o_orderkey as key, ((253402300799999999 - o_orderkey) // 1000000)::decimal(20, 0) as secs, ((253402300799999999 - o_orderkey) % 1000000 * 1000)::bigint as nanos, (253402300799999999 - o_orderkey)::bigint as micros, (9223372036854775807 - o_orderkey) // 1000000000 as span_secs, ((9223372036854775807 - o_orderkey) % 1000000000)::bigint as span_nanos from orders")
def times_far_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at the end of the year 9999 and durations of all nanoseconds that 64 bits hold: beyond what doubles tell apart."""
    at = F.timestamp_micros(F.lit(253402300799999999) - F.col("o_orderkey"))
    span = std_types.duration(F.lit(0), F.lit(9223372036854775807) - F.col("o_orderkey"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), std_types.system_time(at).alias("t"), span.alias("d"))
    return df.select("key", F.col("t.secs_since_epoch").alias("secs"), F.col("t.nanos_since_epoch").alias("nanos"), F.unix_micros(std_types.timestamp(F.col("t"))).alias("micros"), F.col("d.secs").cast("bigint").alias("span_secs"), F.col("d.nanos").alias("span_nanos"))


_FLOATS = {k: v for k, v in std_types.MATH.items() if isinstance(v, TupleStruct) and v.fields[0].node in (F32, F64)}
_INTS = {k: v for k, v in std_types.MATH.items() if isinstance(v, TupleStruct) and v.fields[0].node not in (F32, F64, BOOL)}
_TURNS = [v.name for v in std_types.MATH["EulerRot"].variants]
_FLOAT_SUM = " + ".join(f"embedding[{1 + i % 64}]::double" for v in _FLOATS.values() for i in range(len(v.fields)))
_INT_SUM = sum(i + 1 for v in _INTS.values() for i in range(len(v.fields)))


@_query(f"select vec_id as key, round({_FLOAT_SUM}, 4) as floats, {len(_INTS)} * 0 + (vec_id % 7) * {sum(len(v.fields) for v in _INTS.values())} + {_INT_SUM} as ints, vec_id % 2 = 0 as flag, {_TURNS}[1 + (vec_id % {len(_TURNS)})::int] as turn from embeddings")
def type_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, quaternion, matrix and affine type, and the orders of rotation."""
    def value(node: TupleStruct, make: Callable[[int], Column]) -> Column:
        kind = _type_of(node.fields[0].node)
        return F.struct(*[make(i).cast(kind).alias(f"_{i}") for i in range(len(node.fields))])

    floats = [value(v, lambda i: F.get("embedding", F.lit(i % 64))).alias(k) for k, v in _FLOATS.items()]
    ints = [value(v, lambda i: F.col("vec_id") % 7 + i + 1).alias(k) for k, v in _INTS.items()]
    flag = value(std_types.MATH["BVec3"], lambda i: F.col("vec_id") % 2 == 0).alias("BVec3")
    turn = F.struct(F.element_at(F.array(*map(F.lit, _TURNS)), (1 + F.col("vec_id") % len(_TURNS)).cast("int")).alias("tag")).alias("EulerRot")
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), *floats, *ints, flag, turn)
    names = [*_FLOATS, *_INTS, "BVec3", "EulerRot"]
    out = through_blobs(df, Struct("Body", [("key", I64), *[(k, std_types.MATH[k]) for k in names]]))

    def total(kinds: dict[str, TupleStruct], kind: str) -> Column:
        return F.aggregate(F.array(*[F.col(f"{k}._{i}").cast(kind) for k, v in kinds.items() for i in range(len(v.fields))]), F.lit(0).cast(kind), lambda a, x: a + x)

    return out.select("key", F.round(total(_FLOATS, "double"), 4).alias("floats"), total(_INTS, "bigint").alias("ints"), F.col("BVec3._2").alias("flag"), F.col("EulerRot.tag").alias("turn"))


# Evolution: refusals and the rest of the shapes ------------------------------------------------------------------------------------

_POINT = TupleStruct("P", [U32, U32, U32])
_CHANGES: dict[str, tuple[Node, Node, str]] = {
    "field gone": (Struct("S", [("a", U32), ("b", U32)]), Struct("S", [("a", U32)]), "ok"),
    "field without a default": (Struct("S", [("a", U32)]), Struct("S", [("a", U32), ("b", U32)]), "SchemaMismatch"),
    "renamed without an alias": (Struct("S", [("a", U32)]), Struct("S", [("b", U32)]), "SchemaMismatch"),
    "float to integer": (F32, U32, "SchemaMismatch"),
    "string to integer": (STRING, U32, "SchemaMismatch"),
    "integer to string": (U32, STRING, "SchemaMismatch"),
    "boolean to integer": (BOOL, U8, "SchemaMismatch"),
    "integer to boolean": (U8, BOOL, "SchemaMismatch"),
    "char to string": (CHAR, STRING, "SchemaMismatch"),
    "option unwrapped": (Option(U32), U32, "SchemaMismatch"),
    "option to array": (Option(U32), Tuple([U32]), "SchemaMismatch"),
    "sequence to option": (Seq(U32), Option(U32), "SchemaMismatch"),
    "plain to untagged fields": (U32, Struct("S", [Field("id", U32, 0)]), "SchemaMismatch"),
    "unit to a struct of defaults": (UnitStruct("U"), Struct("S", [Field("f", U32, 0)]), "ok"),
    "unit to a struct without": (UnitStruct("U"), Struct("S", [("f", U32)]), "SchemaMismatch"),
    "positions to tagged names": (_POINT, Struct("P", [Field("x", U32, aliases=("0",))]), "ok"),
    "positions to untagged names": (_POINT, Struct("P", [("x", U32), ("y", U32)]), "SchemaMismatch"),
    "names to positions": (Struct("S", [("x", U32)]), TupleStruct("P", [U32]), "SchemaMismatch"),
    "names to a plain value": (Struct("S", [("x", U32)]), Newtype("N", U32), "SchemaMismatch"),
    "tuple struct grows": (TupleStruct("P", [U32]), TupleStruct("P", [U32, Field("", U32, 9)]), "ok"),
    "tuple struct grows without a default": (TupleStruct("P", [U32]), TupleStruct("P", [U32, U32]), "SchemaMismatch"),
    "bare tuple grows": (Tuple([U32]), Tuple([U32, U32]), "SchemaMismatch"),
    "unit variant to a value": (Enum("E", [Variant("A")]), Enum("E", [Variant("A", "newtype", [Field("", U8, 1)])]), "SchemaMismatch"),
    "named variant to a tuple": (Enum("E", [Variant("A", "struct", [("x", U32)])]), Enum("E", [Variant("A", "tuple", [U32])]), "SchemaMismatch"),
    "named variant to a value": (Enum("E", [Variant("A", "struct", [("x", U32)])]), Enum("E", [Variant("A", "newtype", [U32])]), "SchemaMismatch"),
    "value variant to a tuple": (Enum("E", [Variant("A", "newtype", [U8])]), Enum("E", [Variant("A", "tuple", [U8, Field("", U8, 5)])]), "ok"),
    "map to struct": (Map(STRING, U32), Struct("S", [("a", U32)]), "SchemaMismatch"),
    "struct to map": (Struct("S", [("a", U32)]), Map(STRING, U32), "SchemaMismatch"),
    "two names match": (Struct("S", [("a", U32), ("b", U32)]), Struct("S", [Field("a", U32, aliases=("b",))]), "SchemaMismatch"),
}


@_query(_values([(k, v[2]) for k, v in _CHANGES.items()], "change", "outcome"))
def refusal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that could alter meaning in silence are refused when the plan is made, before any row is read."""
    return rows_of(spark, [(k, _outcome(lambda w=w, r=r: reconcile(w, r, F.col("v"), "v"))) for k, (w, r, _) in _CHANGES.items()], "change string, outcome string")


@_query("select status, (count(*) filter (status <> 'P'))::bigint as rows_read, status = 'P' as refused from (select o_orderstatus as status from orders) group by status union all select 'all', 0, count(*) filter (o_orderstatus = 'P') > 0 from orders")
def enum_unknown_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that lacks a variant reads the rows of the others and fails on those that use it; nobody filters them for it."""
    f, o, _ = _STATUS.variants
    reader = Struct("Order", [("o_orderkey", I64), ("status", Enum("Status", [f, o]))])
    df, out = _statuses(spark, sf_dir), []
    for status in [r["tag"] for r in df.select("status.tag").distinct().collect()] + ["all"]:  # a handful of variants
        part = df if status == "all" else df.where(F.col("status.tag") == status)
        try:
            out.append((status, evolve(part, _ORDER, reader, strict=True).count(), False))
        except Exception as e:  # raised in a task, with the library's own words
            out.append((status, 0, "no variant of Status is called P" in str(e)))
    return rows_of(spark, out, "status string, rows_read long, refused boolean")


def _kept(spark: SparkSession, sf_dir: str, name: str, key: str, value: Column, writer: Node, reader: Node) -> DataFrame:
    """A column written with one type and scanned with another."""
    df = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("key"), value.alias("v"))
    return through_blobs(df, Struct("Row", [("key", I64), ("v", writer)]), Struct("Row", [("key", I64), ("v", reader)]))


@_query("select c_custkey as key, 'basic' as plan, 3 as level from customer")
def evolve_unit_to_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = Struct("Plan", [Field("plan", STRING, "basic"), Field("level", I32, 3)])
    return _kept(spark, sf_dir, "customer", "c_custkey", F.lit(True), UnitStruct("Plan"), reader).select("key", "v.plan", "v.level")


@_query("select o_orderkey as key, o_custkey as who, 5 as extra, o_custkey as alone from orders")
def enum_one_field_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value variant read as a grown tuple, and a tuple of one as a value."""
    value = F.struct(F.lit("By").alias("tag"), F.col("o_custkey").alias("By"))
    one = _kept(spark, sf_dir, "orders", "o_orderkey", value, Enum("E", [Variant("By", "newtype", [I64])]), Enum("E", [Variant("By", "tuple", [I64, Field("", I32, 5)])]))
    single_ = F.struct(F.lit("By").alias("tag"), F.struct(F.col("o_custkey").alias("_0")).alias("By"))
    two = _kept(spark, sf_dir, "orders", "o_orderkey", single_, Enum("E", [Variant("By", "tuple", [I64])]), Enum("E", [Variant("By", "newtype", [I64])]))
    return one.select("key", F.col("v.By._0").alias("who"), F.col("v.By._1").alias("extra")).join(two.select("key", F.col("v.By").alias("alone")), "key")


@_query("select l_orderkey as key, l_linenumber as line, l_returnflag as flag from lineitem")
def shared_reader_of_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written without sharing, read by a reader that shares."""
    line = lambda t: Struct("Line", [("line", I32), ("flag", t)])
    df = _orders_with_lines(spark, sf_dir)
    written = Struct("Order", [("key", I64), ("lines", Seq(line(STRING)))])
    plain = df.select("key", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["flag"].alias("flag"))).alias("lines"))
    return through_blobs(plain, written, Struct("Order", [("key", I64), ("lines", Seq(line(Shared(STRING))))])).select("key", F.explode("lines").alias("l")).select("key", "l.line", "l.flag")


@_query("select l_orderkey as key, l_linenumber as line, l_quantity as quantity from lineitem")
def shared_field_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader without the shared field, whose dictionary repeats values in a row."""
    scene = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", I32), ("quantity", F64), ("flag", Shared(STRING))])))])
    plain = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", I32), ("quantity", F64)])))])
    return through_blobs(_orders_with_lines(spark, sf_dir), scene, plain).select("key", F.explode("lines").alias("l")).select("key", "l.line", "l.quantity")


@_query("select (select count(*) from (select distinct l_orderkey, l_returnflag from lineitem))::bigint as flags, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem))::bigint as lines, (select count(*) from lineitem)::bigint as keys")
def shared_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shared fields have a dictionary each, anew in every row: from the columns' sizes."""
    from lamella.plans import layout

    node = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", Shared(I32)), ("flag", Shared(STRING))])))])
    df = _orders_with_lines(spark, sf_dir).select("key", F.transform("lines", lambda x: F.struct(x["line"].alias("line"), x["flag"].alias("flag"))).alias("lines"))
    path = scratch(spark, "blobs")
    blobs.write(df, path, node)
    at = {f"{c.path}:{c.kind}": c.number for c in layout.columns(node)}
    size = lambda key: F.max(F.when(F.col("number") == at[key], F.col("bytes")))
    return blobs.column_sizes(spark, path).agg(size("lines.[].flag:lengths").alias("flags"), (size("lines.[].line:i32") / 4).cast("long").alias("lines"), size("lines.[].flag:keys").alias("keys"))


@_query("select o_orderkey as key, o_custkey as who, 'none' as note from orders")
def evolve_foreign_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field whose schema comes from the data's own type; the reader adds a part and drops another."""
    inner = F.struct(F.col("o_custkey").alias("who"), F.col("o_orderstatus").alias("status"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), inner.alias("v"))
    foreign = from_spark(df.schema["v"].dataType, "Foreign")
    reader = Struct("Foreign", [Field("who", Option(I64)), Field("note", STRING, "none")])
    return _kept(spark, sf_dir, "orders", "o_orderkey", inner, foreign, reader).select("key", "v.who", "v.note")


_PLANS = [("own", "identity"), ("fewer", "projection"), ("wider", "projection"), ("narrower", "checked"), ("never zero", "checked"), ("unwrapped", "refused")]


@_query(_values(_PLANS, "reader", "plan"))
def plan_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plan each reader gets."""
    writer = from_spark(table(spark, sf_dir, "customer").schema, "Customer")
    key, nation = (next(f for f in writer.fields if f.name == n) for n in ("c_custkey", "c_nationkey"))
    readers = {
        "own": writer, "fewer": Struct("Customer", [key]), "wider": Struct("Customer", [Field("c_nationkey", Option(I64))]), "narrower": Struct("Customer", [Field("c_nationkey", Option(I8))]),
        "never zero": Struct("Customer", [Field("c_nationkey", Option(NONZERO["NonZeroI32"]))]), "unwrapped": Struct("Customer", [Field("c_nationkey", I32)]),
    }
    return rows_of(spark, [(k, plan_kind(writer, r)) for k, r in readers.items()], "reader string, plan string")


@_query("select c_custkey as key, c_name as title from customer")
def reader_from_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's schema comes from elsewhere, as text, and has never seen the data."""
    registered = Struct("Customer", [Field("c_custkey", I64), Field("c_name", STRING)]).to_json()
    path = scratch(spark, "blobs")
    df = table(spark, sf_dir, "customer")
    blobs.write(df, path, from_spark(df.schema, "customer", True))
    return blobs.scan(spark, path, Node.from_json(registered)).select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title"))


# Frames, files and batches ----------------------------------------------------------------------------------------------------------


@_query("select count(*)::bigint as frames, count(*)::bigint as rows, 1 as most from region")
def frames_of_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "blobs")
    blobs.write(table(spark, sf_dir, "region"), path, rows_per_blob=1)
    return blobs.claimed_rows(spark, path).agg(F.count("*").alias("frames"), F.sum("rows").alias("rows"), F.max("rows").cast("int").alias("most"))


@_query("select 1::bigint as files, ceil(count(*) / 100.0)::bigint as frames, count(*)::bigint as rows, count(*)::bigint as read_back from labels")
def frames_in_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several frames follow one another in a file."""
    path = scratch(spark, "blobs")
    blobs.write(table(spark, sf_dir, "labels").coalesce(1), path, rows_per_blob=100)
    claimed = blobs.claimed_rows(spark, path).agg(F.countDistinct("name").alias("files"), F.count("*").alias("frames"), F.sum("rows").alias("rows"))
    return claimed.crossJoin(blobs.scan(spark, path).agg(F.count("*").alias("read_back")))  # one row each


@_query("select count(*)::bigint as readable, 2 * count(*)::bigint as claimed, true as refused from nation")
def permissive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two files is damaged behind its head: a scan fails, a permissive one reads the other."""
    path, df = scratch(spark, "blobs"), table(spark, sf_dir, "nation").coalesce(1)
    blobs.write(df, path, run="whole")
    blobs.write(df, path, run="damaged")
    fs, _ = blobs.file_system(path)
    name = next(f for f in blobs.files(path) if "damaged" in f)
    with fs.open_input_file(name) as f:
        first, data = next(blobs.file_frames(f))[3], bytearray(f.read_at(f.size(), 0))
    data[first] = 9  # the first presence byte
    with fs.open_output_stream(name, compression=None) as f:
        f.write(data)
    try:
        blobs.scan(spark, path, strict=True).count()
        refused = False
    except Exception as e:  # raised in a task
        refused = "InvalidTag" in str(e)
    claimed = blobs.claimed_rows(spark, path).agg(F.sum("rows").alias("claimed"))
    return blobs.scan(spark, path, permissive=True, strict=True).agg(F.count("*").alias("readable")).crossJoin(claimed).withColumn("refused", F.lit(refused))  # one row each


@_query("select count(*)::bigint as rows, sum(r_regionkey)::bigint as keys from region")
def overwrite_and_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of a name that is there already replaces what it wrote; overwrite replaces everything."""
    path, df = scratch(spark, "blobs"), table(spark, sf_dir, "region")
    for run in ("first", "second", "second"):
        blobs.write(df, path, run=run)
    blobs.write(df.where("r_regionkey < 2"), path, run="third")
    blobs.write(df, path, mode="overwrite")
    return blobs.scan(spark, path).agg(F.count("*").alias("rows"), F.sum("r_regionkey").alias("keys"))


_BATCHES = [("two rows", 2), ("a bad one refused", 2), ("another", 3), ("after reset", 0), ("finished into", 1)]


@_query(_values(_BATCHES, "step", "n"))
def batch_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows so far, a batch of rows that fails and leaves nothing, a reset, and blobs put into a buffer."""
    node = Struct("S", [("a", U32), ("b", STRING)])
    batch, out = Batch(node), []
    batch.push_rows([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}])
    out.append(("two rows", batch.rows))
    _outcome(lambda: batch.push_rows([{"a": 3, "b": "z"}, {"a": 4, "b": None}]))
    out.append(("a bad one refused", batch.rows))
    batch.push_rows([{"a": 5, "b": "w"}])
    out.append(("another", batch.rows))
    batch.reset()
    out.append(("after reset", batch.rows))
    batch.push_rows([{"a": 6, "b": "v"}])
    buffer = bytearray()
    batch.finish_into(buffer)
    out.append(("finished into", len(decode(node, bytes(buffer)))))
    return rows_of(spark, out, "step string, n int")


_SINGLES = [("one", "ok"), ("none", "Malformed"), ("two", "Malformed")]


@_query(_values(_SINGLES, "blob", "outcome"))
def single_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made(n: int) -> bytes:
        batch = Batch(U32)
        batch.push_rows(list(range(n)))
        return batch.finish()

    return rows_of(spark, [(k, _outcome(lambda n=n: single(U32, made(n)))) for k, n in (("one", 1), ("none", 0), ("two", 2))], "blob string, outcome string")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@_query(_values([(t, True, True, True) for t in _TABLES], "name", "by_bytes", "by_json", "told"))
def schema_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas as bytes, as JSON numbers and as text, and back."""
    rows = []
    for t in _TABLES:
        node = from_spark(table(spark, sf_dir, t).schema, t)
        names = all(f.name in node.describe() for f in node.fields)
        rows.append((t, Node.from_bytes(node.to_bytes()) == node, Node.from_json(node.to_json()) == node, names))
    return rows_of(spark, rows, "name string, by_bytes boolean, by_json boolean, told boolean")


# Definitions -----------------------------------------------------------------------------------------------------------------------

_DEFINITIONS = [
    ("struct", "ok"), ("unit", "ok"), ("newtype", "ok"), ("tuple", "ok"), ("transparent", "ok"), ("skipped field", "ok"), ("explicit name before rule", "ok"), ("trailing underscore", "ok"), ("retired wire name", "SchemaMismatch"), ("retired name before the rule", "ok"),
    ("untagged", "Unsupported"), ("flatten", "Unsupported"), ("skip_serializing_if", "Unsupported"), ("from alone", "Unsupported"), ("split rename", "Unsupported"), ("unknown attribute", "Unsupported"), ("one-sided conversion", "Unsupported"),
    ("foreign type", "Untraceable"), ("alternatives", "Untraceable"), ("interval column", "Untraceable"), ("two columns of one name", "Untraceable"), ("too deep", "DepthLimitExceeded"), ("skipped variant in the schema", "ok"), ("skipped variant written", "SchemaMismatch"),
]


@_query(_values(_DEFINITIONS, "definition", "outcome"))
def definition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas from Python definitions, and what has none."""
    a = derive.attributes

    def cls(fields: list[tuple], **container: object) -> Node:
        made = dataclasses.make_dataclass("Made", [(n, t, dataclasses.field(metadata=m)) for n, t, m in fields])
        return derive.schema(**container)(made).__schema__

    def want(node: Node, expected: Node) -> None:
        if node != expected:
            raise ValueError(f"{node} is not {expected}")

    def deep() -> Node:
        kind = int
        for _ in range(300):
            kind = list[kind]
        return derive.node_of(kind)

    def columns_of(sql: str) -> Node:
        return from_spark(spark.sql(sql).schema)

    skipping = lambda: derive.enum("E", {"A": None, "B": int, "Debug": derive.SKIPPED})
    acts: dict[str, Callable[[], object]] = {
        "struct": lambda: want(cls([("x", int, {}), ("y", str | None, {})]), Struct("Made", [("x", I64), ("y", Option(STRING))])),
        "unit": lambda: want(cls([], kind="unit"), UnitStruct("Made")),
        "newtype": lambda: want(cls([("x", int, {})], kind="tuple"), Newtype("Made", I64)),
        "tuple": lambda: want(cls([("x", int, {}), ("y", float, {})], kind="tuple"), TupleStruct("Made", [I64, F64])),
        "transparent": lambda: want(cls([("x", list[int], {})], transparent=True), Seq(I64)),
        "skipped field": lambda: want(cls([("x", int, {}), ("y", int, a(skip=True))]), Struct("Made", [("x", I64)])),
        "explicit name before rule": lambda: want(cls([("one_two", int, a(rename="Own")), ("three_four", int, {})], rename_all="camelCase"), Struct("Made", [("Own", I64), ("threeFour", I64)])),
        "trailing underscore": lambda: want(cls([("class_", int, {})]), Struct("Made", [("class", I64)])),
        "retired wire name": lambda: cls([("max_hp", int, {})], rename_all="camelCase", removed=("maxHp",)),
        "retired name before the rule": lambda: cls([("max_hp", int, {})], rename_all="camelCase", removed=("max_hp",)),
        "untagged": lambda: cls([("x", int, {})], untagged=True),
        "flatten": lambda: cls([("x", int, a(flatten=True))]),
        "skip_serializing_if": lambda: cls([("x", int, a(skip_serializing_if="empty"))]),
        "from alone": lambda: cls([("x", int, a(**{"from": int}))]),
        "split rename": lambda: cls([("x", int, a(rename={"serialize": "y"}))]),
        "unknown attribute": lambda: cls([("x", int, a(colour="red"))]),
        "one-sided conversion": lambda: derive.convert(int, lambda c: c, None),
        "foreign type": lambda: derive.node_of(complex),
        "alternatives": lambda: derive.node_of(int | str),
        "interval column": lambda: columns_of("select make_interval(1) as v"),
        "two columns of one name": lambda: columns_of("select 1 as a, 2 as a"),
        "too deep": deep,
        "skipped variant in the schema": lambda: want(skipping(), Enum("E", [Variant("A"), Variant("B", "newtype", [I64])])),
        "skipped variant written": lambda: Batch(skipping()).push_rows([{"tag": "Debug"}]),
    }
    return rows_of(spark, [(k, _outcome(f)) for k, f in acts.items()], "definition string, outcome string")


_ERRORS = [("schema version", "UnsupportedVersion"), ("frame version", "UnsupportedVersion"), ("magic", "Malformed"), ("zero written", "LamellaError"), ("zero read", "LamellaError"), ("null where none may be", "IncompleteRow"), ("two chars", "SchemaMismatch"), ("surrogate", "InvalidTag"), ("bool of 2", "InvalidTag"), ("number out of range", "LamellaError")]


@_query(_values(_ERRORS, "input", "error"))
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.sources.frame import peek_schema, to_frame

    import pyarrow as pa

    framed = to_frame(U8, pa.array([1], pa.int16()))

    def push(node: Node, value: object) -> None:
        Batch(node).push_rows([value])

    acts: dict[str, Callable[[], object]] = {
        "schema version": lambda: Node.from_bytes(b"\x7f" + U8.to_bytes()[1:]),
        "frame version": lambda: peek_schema(framed[:4] + b"\x7f" + framed[5:]),
        "magic": lambda: peek_schema(b"none" + framed[4:]),
        "zero written": lambda: push(NONZERO["NonZeroU8"], 0),
        "zero read": lambda: decode(NONZERO["NonZeroU8"], encode(U8, pa.array([0], pa.int16()))),
        "null where none may be": lambda: push(STRING, None),
        "two chars": lambda: push(CHAR, "ab"),
        "surrogate": lambda: decode(CHAR, bytes([1, 1, 4]) + (0xD800).to_bytes(4, "little")),
        "bool of 2": lambda: decode(BOOL, bytes([1, 1, 1, 2])),
        "number out of range": lambda: push(U8, 300),
    }
    return rows_of(spark, [(k, _outcome(f)) for k, f in acts.items()], "input string, error string")


_SPANS = [("plain", 1), ("enum of three", 3), ("enum in enum", 6), ("siblings", 3), ("in a sequence", 3), ("beyond the cap", 1 << 20)]


@_query(_values(_SPANS, "shape", "n"))
def probe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a compatibility probe makes to meet every variant."""
    three = Enum("E", [Variant("A"), Variant("B"), Variant("C")])
    nest = Enum("N", [Variant("A"), Variant("B", "newtype", [three])])
    deep: Node = three
    for _ in range(20):
        deep = Enum("D", [Variant("A"), Variant("B"), Variant("C", "newtype", [deep])])
    shapes = {"plain": I32, "enum of three": three, "enum in enum": nest, "siblings": Struct("S", [("a", three), ("b", Enum("F", [Variant("X"), Variant("Y")]))]), "in a sequence": Seq(Option(three)), "beyond the cap": deep}
    return rows_of(spark, [(k, compat.span(v)) for k, v in shapes.items()], "shape string, n int")


_NAMES = [("explicit", "Own"), ("variant rule", "ONE"), ("field rule of a variant", "x-y")]


@_query(_values(_NAMES, "rule", "wire"))
def name_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive.enum("E", {"One": {"x_y": int}}, rename_all="UPPERCASE", rename_all_fields="kebab-case")
    one = derive.schema(rename_all="camelCase")(dataclasses.make_dataclass("Named", [("x_y", int, dataclasses.field(metadata=derive.attributes(rename="Own")))])).__schema__
    return rows_of(spark, [("explicit", one.fields[0].name), ("variant rule", made.variants[0].name), ("field rule of a variant", made.variants[0].fields[0].name)], "rule string, wire string")


@_query("select c_custkey as key from customer where c_custkey % 2 = 0")
def conversion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion that fails on some values: rows without them read, and the others bring its own words up."""
    even = Convert(I64, lambda c: F.when(c % 2 == 0, c).otherwise(F.raise_error(F.lit("odd key")).cast("long")), lambda c: c, "long")
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    writer, reader = Struct("C", [("key", I64)]), Struct("C", [("key", even)])
    try:
        evolve(df, writer, reader, strict=True).count()
    except Exception as e:  # raised in a task
        if "odd key" not in str(e):
            raise
    return evolve(df.where("key % 2 = 0"), writer, reader, strict=True)


# Streams ---------------------------------------------------------------------------------------------------------------------------


def _arriving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Struct]:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).format("parquet").load(f"{sf_dir.rstrip('/')}/event[s].parquet"), from_spark(schema, "Event")


@_query("select * from events")
def stream_format_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's own stream writer."""
    path, (arriving, node) = scratch(spark, "blobs"), _arriving(spark, sf_dir)
    streams.write_format(arriving, path, scratch(spark, "offsets"), node).awaitTermination()
    return blobs.scan(spark, path, node)


@_query("select count(*)::bigint as rows, count(distinct event_id)::bigint as events from events")
def stream_batch_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A micro-batch whose commit was lost runs again: its files are replaced, and no row is there twice."""
    path, offsets = scratch(spark, "blobs"), scratch(spark, "offsets")
    arriving, node = _arriving(spark, sf_dir)
    streams.write_blobs(arriving, path, offsets, node).awaitTermination()
    fs, root = blobs.file_system(offsets)
    fs.delete_dir_contents(os.path.join(root, "commits"))
    again, _ = _arriving(spark, sf_dir)
    streams.write_blobs(again, path, offsets, node).awaitTermination()
    return blobs.scan(spark, path, node).agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"))
