from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamella.errors import SchemaMismatch
from lamella.functions.std_types import BOOL, CHAR, F32, F64, I8, I16, I32, I64, NONZERO, STRING, U8, U32, U64
from lamella.operators import compat
from lamella.operators.decode import decode
from lamella.operators.encode import Batch
from lamella.operators.reconcile import Options, evolve, reconcile, written
from lamella.plans.schema import Bytes, Convert, Enum, Field, Map, Newtype, Option, Seq, Shared, Struct, Tuple, TupleStruct, Unit, UnitStruct, Variant, struct_type


def read(spark, writer, reader, values, options=Options()):
    """What the reader makes of values of the writer's type, through the codec."""
    w, r = Struct("W", [("v", writer)]), Struct("R", [("v", reader)])
    batch = Batch(w)
    batch.push_rows([{"v": v} for v in values])
    array = decode(w, batch.finish())
    # as files are read: nullable throughout
    df = spark.createDataFrame(pa.Table.from_batches([pa.RecordBatch.from_struct_array(array)]), compat._loose(struct_type(w)))
    return [plain(x["v"]) for x in evolve(df, w, r, options=options).collect()]


def plain(v):
    """Rows as dicts, without the payloads of other variants."""
    if hasattr(v, "asDict"):
        v = {k: plain(x) for k, x in v.asDict().items()}
        return {k: x for k, x in v.items() if k in ("tag", v["tag"])} if "tag" in v else v
    return [plain(x) for x in v] if isinstance(v, list) else v


POINT = TupleStruct("P", [U32, U32, U32])
ROW = {"_0": 1, "_1": 2, "_2": 3}
TOOL = Enum("Tool", [Variant("Sword"), Variant("Bow", "struct", [("range", U32)]), Variant("Wand", "newtype", [U8]), Variant("Pair", "tuple", [U8, U8])])
BOW = {"tag": "Bow", "Bow": {"range": 12}}


def S(*fields):
    return Struct("S", list(fields))


PASS = [
    ("EV1 same", S(("a", U32)), S(("a", U32)), {"a": 7}, {"a": 7}),
    ("EV2 default", S(("a", U32)), S(("a", U32), Field("m", U32, 50)), {"a": 7}, {"a": 7, "m": 50}),
    ("EV2 default function", S(("a", U32)), S(Field("m", Seq(U32), lambda: [1, 2])), {"a": 7}, {"m": [1, 2]}),
    ("EV3b option", S(("a", U32)), S(("a", U32), ("m", Option(STRING))), {"a": 7}, {"a": 7, "m": None}),
    ("EV4 drop", S(("a", U32), ("b", STRING)), S(("a", U32)), {"a": 7, "b": "x"}, {"a": 7}),
    ("EV5 reorder", S(("a", U32), ("b", U32)), S(("b", U32), ("a", U32)), {"a": 7, "b": 8}, {"b": 8, "a": 7}),
    ("EV6 alias", S(("a", U32)), S(Field("z", U32, aliases=("y", "a"))), {"a": 7}, {"z": 7}),
    ("EV8 widen", U32, U64, 7, 7),
    ("EV8 unsigned to signed", U8, I16, 255, 255),
    ("EV9 narrow", U32, U8, 200, 200),
    ("EV10 sign", I32, U32, 5, 5),
    ("EV11 int to float", U32, F32, 42, 42.0),
    ("EV12 f64 to f32", F64, F32, 1.5, 1.5),
    ("EV12 f32 to f64", F32, F64, 1.5, 1.5),
    ("EV14 wrap", STRING, Option(STRING), "x", "x"),
    ("EV14 nested", U32, Option(Option(U32)), 3, {"value": 3}),
    ("EV16 some", Option(U32), Seq(U64), 7, [7]),
    ("EV16 none", Option(U32), Seq(U32), None, []),
    ("EV18 newtype on", U32, Newtype("N", U32), 7, 7),
    ("EV18 newtype off", Newtype("N", U32), U32, 7, 7),
    ("EV19 plain to struct", U32, S(Field("id", U32, aliases=("0",)), Field("x", U8, 1)), 5, {"id": 5, "x": 1}),
    ("EV20 unit to struct", UnitStruct("U"), S(Field("f", U32, 0)), True, {"f": 0}),
    ("EV21 to unit", STRING, Unit(), "x", True),
    ("EV22 positions", POINT, S(Field("z", U32, aliases=("2",)), Field("x", U32, aliases=("0",))), ROW, {"z": 3, "x": 1}),
    ("EV22 untagged default", POINT, S(Field("y", U32, aliases=("1",)), Field("q", U32, 9)), ROW, {"y": 2, "q": 9}),
    ("EV25 grow", TupleStruct("P", [U32, U32]), TupleStruct("P", [U32, U32, Field("", U32, 9)]), {"_0": 1, "_1": 2}, {"_0": 1, "_1": 2, "_2": 9}),
    ("EV27 shrink", POINT, TupleStruct("P", [U32, U32]), ROW, {"_0": 1, "_1": 2}),
    ("EV27 shrink bare", Tuple([U32, U32]), Tuple([U64]), {"_0": 1, "_1": 2}, {"_0": 1}),
    ("EV28 seq to array", Seq(U32), Tuple([U32, U32]), [1, 2], {"_0": 1, "_1": 2}),
    ("EV28 array to seq", Tuple([U32, U32]), Seq(U64), {"_0": 1, "_1": 2}, [1, 2]),
    ("EV29 elements", Seq(S(("a", U8))), Seq(S(("a", U32), Field("b", U8, 1))), [{"a": 1}], [{"a": 1, "b": 1}]),
    ("EV29 map", Map(U8, U8), Map(U32, Option(U32)), [(1, 2)], {1: 2}),
    ("EV30 variants", TOOL, Enum("Tool", [Variant("New"), TOOL.variants[1], TOOL.variants[0]][0:3]), BOW, {"tag": "Bow", "Bow": {"range": 12}}),
    ("EV31 variant alias", TOOL, Enum("Tool", [Variant("Blade", aliases=("Sword",)), Variant("Arc", "struct", [("range", U32)], ("Bow",))]), BOW, {"tag": "Arc", "Arc": {"range": 12}}),
    ("EV33 unit to fields", TOOL, Enum("Tool", [Variant("Sword", "struct", [Field("edge", U8, 3)])]), {"tag": "Sword"}, {"tag": "Sword", "Sword": {"edge": 3}}),
    ("EV35 payload to unit", TOOL, Enum("Tool", [Variant("Bow")]), BOW, {"tag": "Bow"}),
    ("EV36 newtype to fields", TOOL, Enum("Tool", [Variant("Wand", "struct", [Field("power", U8, aliases=("0",))])]), {"tag": "Wand", "Wand": 4}, {"tag": "Wand", "Wand": {"power": 4}}),
    ("EV36 tuple to fields", TOOL, Enum("Tool", [Variant("Pair", "struct", [Field("y", U8, aliases=("1",))])]), {"tag": "Pair", "Pair": {"_0": 1, "_1": 2}}, {"tag": "Pair", "Pair": {"y": 2}}),
    ("EV38 newtype to tuple", TOOL, Enum("Tool", [Variant("Wand", "tuple", [U8, Field("", U8, 5)])]), {"tag": "Wand", "Wand": 4}, {"tag": "Wand", "Wand": {"_0": 4, "_1": 5}}),
    ("EV38 tuple to newtype", Enum("E", [Variant("A", "tuple", [U8])]), Enum("E", [Variant("A", "newtype", [U8])]), {"tag": "A", "A": {"_0": 4}}, {"tag": "A", "A": 4}),
    ("EV39 plain to shared", Seq(STRING), Seq(Shared(STRING)), ["a", "a"], ["a", "a"]),
    ("EV40 shared to plain", Seq(Shared(STRING)), Seq(STRING), ["a", "a"], ["a", "a"]),
    ("EV41 drop shared", S(("a", Seq(Shared(STRING))), ("b", U8)), S(("b", U8)), {"a": ["a", "a"], "b": 1}, {"b": 1}),
]


@pytest.mark.parametrize("name, writer, reader, value, expected", PASS, ids=[p[0] for p in PASS])
def test_changes_that_read(spark, name, writer, reader, value, expected):
    assert read(spark, writer, reader, [value, value]) == [expected] * 2


REFUSE = [
    ("EV3 no default", S(("a", U32)), S(("a", U32), ("stamina", U32)), "stamina"),
    ("EV7 no alias", S(("a", U32)), S(("b", U32)), "`b`"),
    ("EV13 float to int", F32, U32, "f32"),
    ("EV13 string to int", STRING, U32, "string"),
    ("EV13 int to string", U32, STRING, "u32"),
    ("EV13 bool to int", BOOL, U8, "bool"),
    ("EV13 int to bool", U8, BOOL, "u8"),
    ("char to string", CHAR, STRING, "char"),
    ("string to bytes", STRING, Bytes(), "string"),
    ("EV15 unwrap", Option(U32), U32, "nothing"),
    ("EV16b option to array", Option(U32), Tuple([U32]), "nothing"),
    ("EV17 seq to option", Seq(U32), Option(U32), "seq"),
    ("EV19 untagged", U32, S(Field("id", U32, 0)), "alias"),
    ("EV20 no default", Unit(), S(("f", U32)), "`f`"),
    ("EV23 untagged", POINT, S(("x", U32), ("y", U32)), '"0", "1", "2"'),
    ("EV24 named to tuple", S(("x", U32)), TupleStruct("P", [U32]), "positions"),
    ("EV24 named to plain", S(("x", U32)), Newtype("N", U32), "u32"),
    ("EV26 bare tuple grows", Tuple([U32]), Tuple([U32, U32]), "can't grow"),
    ("EV25 no default", TupleStruct("P", [U32]), TupleStruct("P", [U32, U32]), "`1`"),
    ("EV34 unit to newtype", TOOL, Enum("Tool", [Variant("Sword", "newtype", [Field("", U8, 1)])]), "holds nothing"),
    ("EV37 named variant to tuple", TOOL, Enum("Tool", [Variant("Bow", "tuple", [U32])]), "positions"),
    ("EV37 named variant to newtype", TOOL, Enum("Tool", [Variant("Bow", "newtype", [U32])]), "positions"),
    ("EV43 map to struct", Map(STRING, U32), S(("a", U32)), "map"),
    ("EV43 struct to map", S(("a", U32)), Map(STRING, U32), "S"),
    ("two names match", S(("a", U32), ("b", U32)), S(Field("a", U32, aliases=("b",))), "several"),
]


@pytest.mark.parametrize("name, writer, reader, hint", REFUSE, ids=[p[0] for p in REFUSE])
def test_changes_refused_when_planned(spark, name, writer, reader, hint):
    with pytest.raises(SchemaMismatch) as e:
        reconcile(writer, reader, F.col("v"), "v")
    assert hint in str(e.value)


FAIL = [
    ("EV9", U32, U8, 999, "999"),
    ("EV10", I32, U32, -5, "-5"),
    ("u64 to i64", U64, I64, 2**64 - 1, "18446744073709551615"),
    ("EV32", TOOL, Enum("Tool", [Variant("Sword")]), BOW, "Bow"),
    ("EV28", Seq(U32), Tuple([U32, U32]), [1, 2, 3], "sequence of 3"),
    ("nonzero", U32, NONZERO["NonZeroU32"], 0, "zero"),
]


@pytest.mark.parametrize("name, writer, reader, value, hint", FAIL, ids=[p[0] for p in FAIL])
def test_values_that_do_not_fit(spark, name, writer, reader, value, hint):
    with pytest.raises(Exception, match=hint):
        read(spark, writer, reader, [value])


def test_strict_keeps_checks_under_count(spark):
    w, r = S(("a", I32), ("b", I32)), S(("a", I8), ("b", I32))
    df = spark.createDataFrame([(999, 1)], "a int, b int")
    assert evolve(df, w, r).select("b").count() == 1
    for plan in (evolve(df, w, r, strict=True), evolve(df, w, r, strict=True).select("b")):
        with pytest.raises(Exception, match="999"):
            plan.count()


def test_strict_with_maps(spark):
    w = S(("m", Map(STRING, I32)), ("b", I32))
    df = spark.sql("select map('a', 999) as m, 1 as b")
    assert evolve(df, w, S(("m", Map(STRING, I64)), ("b", I32)), strict=True).count() == 1
    with pytest.raises(Exception, match="999"):
        evolve(df, w, S(("m", Map(STRING, I8)), ("b", I32)), strict=True).select("b").count()


def test_identity_is_no_projection(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert evolve(df, S(("a", I32)), S(("a", I32))) is df


def test_strict_shared(spark):
    with pytest.raises(SchemaMismatch):
        reconcile(Shared(STRING), STRING, F.col("v"), options=Options(strict_shared=True))
    with pytest.raises(SchemaMismatch):
        reconcile(S(("a", U8)), S(("b", Option(U8))), F.col("v"), options=Options(missing_option_is_null=False))


def test_conversion_after_reconciling(spark):
    degrees = Convert(F64, lambda c: F.pmod(c, F.lit(360.0)), lambda c: c * 1.0, "double")
    sorted_ = Convert(Seq(I16), lambda c: F.sort_array(c), lambda c: c)
    assert read(spark, F32, degrees, [400.0]) == [40.0]
    assert read(spark, Seq(I8), sorted_, [[9, -1, 4]]) == [[-1, 4, 9]]
    df = spark.createDataFrame([(10.0,)], "v double")
    assert written(df, Struct("S", [("v", degrees)])).collect()[0]["v"] == 10.0


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c-d` int")
    out = evolve(df, S(("a.b", I32), ("c-d", I32)), S(Field("x", I64, aliases=("a.b",)), ("c-d", I32)))
    assert [tuple(r) for r in out.collect()] == [(1, 2)]


def test_projection_reaches_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id as b", "id as c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = evolve(df, S(("id", I64), ("b", I64), ("c", I64)), S(Field("key", I64, aliases=("id",)))).where("key > 5")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,5)" in plan
