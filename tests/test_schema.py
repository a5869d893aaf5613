from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import types as T

from lamella import errors as E
from lamella.functions import rename, std_types
from lamella.functions.std_types import F32, F64, I64, STRING, U32
from lamella.plans import derive
from lamella.plans.derive import attributes, convert, enum, schema
from lamella.plans.schema import Enum, Field, Map, Newtype, Node, Option, Seq, Shared, Struct, Tuple, TupleStruct, Unit, UnitStruct, Variant, from_spark, spark_type
from lamella.plans.spec import validate


def test_bytes_and_json():
    node = Struct("S", [("a", Map(STRING, Seq(Option(U32)))), ("b", Enum("E", [Variant("U"), Variant("N", "newtype", [F32]), Variant("T", "tuple", [F32, STRING]), Variant("S", "struct", [("x", Unit())])]))])
    for n in (node, Shared(node), Newtype("N", node), Tuple([node, node]), TupleStruct("T", [node]), UnitStruct("u")):
        assert Node.from_bytes(n.to_bytes()) == n == Node.from_json(n.to_json())
    assert Struct("P", [("x", F32)]).to_bytes() == bytes([1, 24, 1]) + b"P" + bytes([1, 1]) + b"x" + bytes([11])


def test_bad_bytes():
    good = Struct("P", [("x", F32)]).to_bytes()
    with pytest.raises(E.TrailingBytes):
        Node.from_bytes(good + b"\0")
    with pytest.raises(E.UnsupportedVersion):
        Node.from_bytes(b"\2" + good[1:])
    with pytest.raises(E.Malformed):
        Node.from_bytes(b"\0" + good[1:])
    with pytest.raises(E.Malformed):
        Node.from_bytes(bytes([1, 27]))
    with pytest.raises(E.DepthLimitExceeded):
        Node.from_bytes(bytes([1]) + bytes([17]) * 300 + bytes([0]))
    for i in range(len(good)):
        with pytest.raises(E.LamellaError):
            Node.from_bytes(good[:i])


def test_reader_only_parts_are_not_in_equality_or_bytes():
    plain = Struct("S", [("a", F32)])
    rich = Struct("S", [Field("a", F32, 1.0, ("b",))], removed=("old",))
    assert plain == rich and plain.to_bytes() == rich.to_bytes()
    assert convert(F32, lambda c: c, lambda c: c) == F32


def test_descriptions():
    assert str(Struct("S", [("a", Option(U32))])) == "S {a: option<u32>}"


def test_from_spark_and_back():
    kind = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.ArrayType(T.DoubleType(), False)), T.StructField("c", T.MapType(T.StringType(), T.DateType(), True)), T.StructField("d", T.DecimalType(12, 2)), T.StructField("t", T.TimestampType())])
    node = from_spark(kind, "Row")
    assert spark_type(node) == kind
    with pytest.raises(E.Untraceable):
        from_spark(T.StructType([T.StructField("i", T.DayTimeIntervalType())]))


def test_dataclasses():
    @schema(rename_all="camelCase", removed=("hp",))
    class Save:
        player_id: int
        name: str
        tags: list[str]
        motto: str | None = None
        cache: int = dataclasses.field(default=0, metadata=attributes(skip=True))
        health: float = dataclasses.field(default=1.5, metadata=attributes(aliases=("vigour",)))

    expected = Struct("Save", [("playerId", I64), ("name", STRING), ("tags", Seq(STRING)), ("motto", Option(STRING)), ("health", F64)])
    assert Save.__schema__ == expected and Save.__schema__.fields[4].aliases == ("vigour",) and Save.__schema__.fields[4].default == 1.5

    @schema(kind="tuple")
    class Pair:
        a: int
        b: Save

    assert Pair.__schema__ == TupleStruct("Pair", [I64, expected])

    @schema(kind="newtype")
    class Meters:
        value: float

    assert Meters.__schema__ == Newtype("Meters", F64)
    weapon = enum("Weapon", {"Sword": None, "Bow": {"max_range": U32}, "Wand": (U32,), "Pair": (U32, F32)}, rename_all="snake_case", rename_all_fields="camelCase")
    assert weapon == Enum("Weapon", [Variant("sword"), Variant("bow", "struct", [("maxRange", U32)]), Variant("wand", "newtype", [U32]), Variant("pair", "tuple", [U32, F32])])


def test_untraceable_and_unsupported():
    class Plain:
        pass

    with pytest.raises(E.Untraceable):
        derive.node_of(Plain)
    with pytest.raises(E.Untraceable):
        derive.node_of(int | str)
    with pytest.raises(E.Unsupported):

        @schema(untagged=True)
        class A:
            x: int

    with pytest.raises(E.Unsupported):

        @schema
        class B:
            x: int = dataclasses.field(default=0, metadata=attributes(flatten=True))

    with pytest.raises(E.Unsupported):

        @schema(rename_all={"serialize": "camelCase"})
        class C:
            x: int

    with pytest.raises(E.Unsupported):
        convert(F32, lambda c: c, None)


@pytest.mark.parametrize(
    "node",
    [
        Struct("S", [("hp", F32)], ("hp",)),
        Struct("S", [Field("health", F32, 0.0, ("hp",))], ("hp",)),
        Struct("S", [Field("health", F32, 0.0, ("1",))], (1,)),
        TupleStruct("P", [F32, U32], (1,)),
        Enum("E", [Variant("B")], ("B",)),
        Enum("E", [Variant("A", aliases=("B",))], ("B",)),
        Enum("E", [Variant("A")], (0,)),
        Seq(Struct("S", [("hp", F32)], ("hp",))),
        Struct("S", [Field("a", F32), Field("b", F32, aliases=("a",))]),
    ],
)
def test_retired_names_stay_retired(node):
    with pytest.raises(E.LamellaError):
        validate(node)


def test_retirement_allows_placeholders():
    validate(Struct("S", [("hp", Unit()), ("health", F32)], ("hp",)))
    validate(TupleStruct("P", [F32, Unit(), F32], (1, 7)))
    validate(Enum("E", [Variant("A")], ("B",)))


def test_case_rules():
    assert [rename.field("max_speed", r) for r in rename.RULES] == ["max_speed", "MAX_SPEED", "MaxSpeed", "maxSpeed", "max_speed", "MAX_SPEED", "max-speed", "MAX-SPEED"]
    assert rename.variant("HTTPServer", "snake_case") == "h_t_t_p_server"
    assert rename.variant("ÉtatNeuf", "snake_case") == "État_neuf"
    with pytest.raises(ValueError):
        rename.field("a", "Title Case")


def test_std_types():
    assert std_types.SOCKET.variants[0].payload == Tuple([std_types.IPV4, std_types.U16])
    assert std_types.bound(U32).variants[1].name == "Included"
    assert spark_type(std_types.DURATION).simpleString() == "struct<secs:decimal(20,0),nanos:bigint>"
