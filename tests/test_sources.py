from __future__ import annotations

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from lamella.errors import LamellaError, SchemaMismatch
from lamella.functions.std_types import F64, I32, I64, STRING
from lamella.operators import compat
from lamella.operators.compat import Verdict
from lamella.operators.misfits import misfits
from lamella.operators.reconcile import assess
from lamella.plans.schema import Convert, Enum, Field, Newtype, Option, Primitive, Seq, Struct, Variant, from_spark
from lamella.sources import blobs
from lamella.streaming import blobs as streams


@pytest.fixture
def people(spark):
    rows = [(1, "ann", [1.5], {"a": 1}, datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.date(1969, 1, 1), decimal.Decimal("-12.34")), (2, None, None, None, None, None, None), (3, "", [], {}, None, None, decimal.Decimal("0.01"))]
    return spark.createDataFrame(rows, "id long, name string, v array<double>, m map<string,int>, t timestamp, d date, x decimal(12,2)")


def test_write_scan_and_format(spark, people, tmp_path):
    path = str(tmp_path / "p")
    blobs.write(people, path, rows_per_blob=2)
    key = lambda r: r["id"]
    assert sorted(blobs.scan(spark, path).collect(), key=key) == sorted(people.collect(), key=key)
    assert sorted(spark.read.format("lamella").load(path).collect(), key=key) == sorted(people.collect(), key=key)
    assert spark.read.format("lamella").schema("name string").load(path).where("name = 'ann'").count() == 1
    assert blobs.scan(spark, path).count() == 3
    assert sum(blobs.column_bytes(spark, path).values()) > 0
    with pytest.raises(Exception, match="SchemaMismatch|expected"):
        spark.read.format("lamella").schema("name int").load(path).collect()


def test_modes_and_empty(spark, people, tmp_path):
    path = str(tmp_path / "p")
    blobs.write(people, path)
    blobs.write(people, path)
    assert blobs.scan(spark, path).count() == 6
    blobs.write(people, path, mode="overwrite")
    assert blobs.scan(spark, path).count() == 3
    blobs.write(people.where("false"), str(tmp_path / "e"))
    assert blobs.scan(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(SchemaMismatch):
        blobs.scan(spark, str(tmp_path / "none"))


def test_versions_meet_in_one_scan(spark, tmp_path):
    path = str(tmp_path / "v")
    blobs.write(spark.createDataFrame([(1, "a")], "id int, name string"), path, Struct("A", [("id", I32), ("name", STRING)]))
    blobs.write(spark.createDataFrame([(2, "b", 9)], "id long, title string, tier int"), path, Struct("A", [("id", I64), ("title", STRING), ("tier", I32)]))
    reader = Struct("A", [("id", I64), Field("title", STRING, aliases=("name",)), Field("tier", I32, 7)])
    assert sorted(map(tuple, blobs.scan(spark, path, reader).collect())) == [(1, "a", 7), (2, "b", 9)]
    assert len(blobs.writer_schemas(path)) == 2
    out = []
    streams.for_each_version(streams.contents(spark, path), reader, lambda df, i: out.extend(map(tuple, df.collect())), str(tmp_path / "c")).awaitTermination()
    assert sorted(out) == [(1, "a", 7), (2, "b", 9)]


def test_nulls_need_options(spark, tmp_path):
    df = spark.createDataFrame([(None,)], "id int")
    with pytest.raises(Exception, match="IncompleteRow|is null"):
        blobs.write(df, str(tmp_path / "n"), Struct("A", [("id", I32)]))


def test_messages(spark, people):
    node = from_spark(people.schema)
    frames = streams.to_messages(people.coalesce(1), node, 2)
    assert frames.where(streams.is_frame()).count() == 2
    assert streams.read_mixed(frames, node).count() == 3


def test_misfits(spark):
    df = spark.createDataFrame([(1, 1), (300, 2), (-1, 3), (None, 4)], "a int, b int")
    out = misfits(df, from_spark(df.schema), Struct("", [("a", Option(Primitive("u8"))), ("b", Option(I64))]))
    assert [tuple(r) for r in out.collect()] == [("a", 2)]


def test_verdicts(spark):
    u = lambda k: Primitive(k)
    old = Struct("S", [("v", u("u64")), ("untouched", STRING)])
    assert compat.check(spark, old, old).verdict is Verdict.OK
    narrow = compat.check(spark, old, Struct("S", [("v", u("u8")), ("untouched", STRING)]))
    assert narrow.verdict is Verdict.VALUE_DEPENDENT and "v narrows from u64 to u8" in str(narrow)
    assert compat.check(spark, old, Struct("S", [("v", u("u64")), ("new", STRING)])).verdict is Verdict.UNREADABLE
    wide = Struct("S", [("a", u("u64")), ("b", u("i64")), ("c", I32)])
    assert compat.check(spark, Struct("S", [("a", u("u8")), ("b", u("u32")), ("c", u("i8"))]), wide).verdict is Verdict.OK
    odd = Convert(I32, lambda c: F.when(c % 2 == 0, c).otherwise(F.raise_error(F.lit("odd")).cast("int")), lambda c: c, "int")
    assert compat.check(spark, Struct("H", [("v", I32)]), Struct("H", [("v", odd)])).verdict is Verdict.INCONCLUSIVE
    # aliases and positions lead to what is read, so narrowings are found behind them
    assert compat.check(spark, Struct("S", [("a", u("u64"))]), Struct("S", [Field("b", u("u16"), aliases=("a",))])).verdict is Verdict.VALUE_DEPENDENT
    assert compat.check(spark, Struct("S", [("a", u("u64"))]), Struct("S", [Field("b", u("u64"), aliases=("a",))])).verdict is Verdict.OK


def test_probe_meets_nested_variants(spark):
    def nest(*inner):
        return Enum("Outer", [Variant("A"), Variant("B", "newtype", [Enum("Inner", [Variant(x) for x in inner])])])

    assert compat.span(nest("X", "Y")) == 4
    assert compat.check(spark, nest("X", "Y"), nest("Y")).verdict is Verdict.UNREADABLE
    deep = lambda *x: Enum("L0", [Variant("P"), Variant("Q", "newtype", [nest(*x)])])
    assert compat.check(spark, deep("X", "Y"), deep("X")).verdict is Verdict.UNREADABLE
    assert compat.check(spark, deep("X", "Y"), deep("Y", "X", "Z")).verdict is Verdict.OK


def test_findings_paths(spark):
    shape = lambda t: Enum("E", [Variant("A", "struct", [("depth", t)]), Variant("B", "newtype", [Seq(Option(t))]), Variant("C", "newtype", [Newtype("N", t)])])
    assert [n.path for n in assess(shape(Primitive("u64")), shape(Primitive("u16"))).narrowings] == ["A.depth", "B", "C"]
    assert assess(F64, Primitive("f32")).narrowings == ()
    assert assess(STRING, I32).refusal


def test_parts_of_other_runs_stay_and_runs_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(10).select(F.col("id").alias("a"))
    other = tmp_path / "p" / "_temporary" / "other"
    other.mkdir(parents=True)
    (other / "part").write_bytes(b"unfinished")
    blobs.write(df, path, run="one")
    blobs.write(df, path, run="one")
    assert (other / "part").read_bytes() == b"unfinished" and blobs.scan(spark, path).count() == 10
    blobs.write(df, path, run="two")
    assert blobs.scan(spark, path).count() == 20
    blobs.write(df, path, mode="overwrite")
    assert blobs.scan(spark, path).count() == 10


def test_only_wanted_columns_are_read(spark, people, tmp_path, monkeypatch):
    path = str(tmp_path / "p")
    blobs.write(people.coalesce(1), path, rows_per_blob=2)
    name = blobs.files(path)[0]
    fs, _ = blobs.file_system(path)
    with fs.open_input_file(name) as f:
        frames = list(blobs.file_frames(f))
    assert [rows for _, rows, _, _ in frames] == [2, 1]
    # damage a column that is not asked for: it is not looked at
    from lamella.plans.layout import width

    node, _, lengths, at = frames[0]
    before = sum(width(f.node) for f in node.fields if f.name == "id")
    data = bytearray(open(name, "rb").read())
    data[at + sum(lengths[:before])] = 9
    open(name, "wb").write(data)
    fs, _ = blobs.file_system(path)
    assert [r for _, a in blobs.read_file(fs, name, ["id"], False) for r in a.to_pylist()] == [{"id": 1}, {"id": 2}, {"id": 3}]
    with pytest.raises(LamellaError):
        list(blobs.read_file(fs, name, ["id"], True))
    assert sorted(r["id"] for r in blobs.scan(spark, path, Struct("A", [("id", Option(I64))])).collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="InvalidTag"):
        blobs.scan(spark, path).collect()
    assert blobs.scan(spark, path, permissive=True).count() == 0
    assert blobs.claimed_rows(spark, path).agg(F.sum("rows")).first()[0] == 3


def test_names_without_fingerprints(spark, people, tmp_path):
    import os

    path = str(tmp_path / "p")
    blobs.write(people, path)
    for f in blobs.files(path):
        os.rename(f, f[: f.rindex("-s")] + blobs.SUFFIX)
    blobs.write(people, path)
    assert blobs.scan(spark, path).count() == 6 and len(blobs.writer_schemas(path)) == 1


def test_equal_maps_have_equal_bytes_and_sets_are_distinct(spark, tmp_path):
    from lamella.functions.std_types import hash_set, sorted_set
    from lamella.operators.reconcile import written
    from lamella.plans.schema import Map

    node = Struct("S", [("m", Map(STRING, I32)), ("s", sorted_set(I32)), ("h", hash_set(I32))])
    one = spark.sql("select map('b', 1, 'a', 2) as m, array(3, 1, 3) as s, array(3, 1, 3) as h")
    two = spark.sql("select map('a', 2, 'b', 1) as m, array(1, 3) as s, array(3, 1) as h")
    assert [list(r["m"].items()) for r in written(one, node).collect()] == [[("a", 2), ("b", 1)]]
    rows = []
    for i, df in enumerate((one, two)):
        blobs.write(df, str(tmp_path / str(i)), node)
        rows.append([(tmp_path / str(i) / f).read_bytes() for f in (p.split("/")[-1] for p in blobs.files(str(tmp_path / str(i))))])
    assert rows[0] == rows[1]


def test_exact_scan_refuses_other_schemas(spark, tmp_path):
    path = str(tmp_path / "x")
    blobs.write(spark.createDataFrame([(1,)], "id long"), path, Struct("A", [("id", I64)]))
    assert blobs.scan(spark, path, Struct("A", [("id", I64)]), exact=True).count() == 1
    with pytest.raises(SchemaMismatch):
        blobs.scan(spark, path, Struct("A", [("id", F64)]), exact=True)


def test_a_logical_type_of_ones_own(spark, tmp_path):
    import pyarrow as pa
    from pyspark.sql import types as T

    from lamella.operators.decode import decode
    from lamella.operators.encode import encode
    from lamella.plans.schema import register_logical, spark_type

    register_logical("time_ms", "i32", T.IntegerType(), pa.time32("ms"))
    node = Newtype("time_ms", I32)
    array = pa.array([datetime.time(1, 2, 3)], pa.time32("ms"))
    assert decode(node, encode(node, array)) == array and spark_type(node) == T.IntegerType()
