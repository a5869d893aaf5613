"""The queries of the library's own operators, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.errors import LamellaError
from lamella.functions import rename, shared, std_types
from lamella.functions.std_types import F32, F64, I8, I16, I32, I64, STRING, U8, U32, U64
from lamella.operators import compat
from lamella.operators.decode import decode
from lamella.operators.encode import Batch
from lamella.operators.misfits import misfits
from lamella.operators.reconcile import evolve, reconcile, written
from lamella.plans import layout
from lamella.plans.schema import Convert, Enum, Field, Map, Newtype, Node, Option, Primitive, Seq, Shared, Struct, Tuple, TupleStruct, Unit, Variant, from_spark
from lamella.plans.spec import validate
from lamella.sources import blobs
from lamella.sources.scratch import scratch
from lamella.streaming import blobs as streams

_Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, _Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[_Query], _Query]:
    def add(f: _Query) -> _Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def through_blobs(df: DataFrame, node: Struct | None = None, reader: Struct | None = None, strict: bool = False) -> DataFrame:
    """df written as blob files and scanned again."""
    path = scratch(df.sparkSession, "blobs")
    blobs.write(df, path, node)
    return blobs.scan(df.sparkSession, path, reader, strict)


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Round trips: encode, decode, frames, every column type of the tables ------------------------------------------------

for _name in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
    _query(f"select * from {_name}", f"roundtrip_{_name}")(lambda spark, sf_dir, _t=_name: through_blobs(table(spark, sf_dir, _t)))


@_query("select vec_id, label, (unnest(range(len(embedding))))::int as place, unnest(embedding)::double as component from embeddings")
def roundtrip_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of every vector."""
    df = through_blobs(table(spark, sf_dir, "embeddings"))
    return df.select("vec_id", "label", F.posexplode("embedding").alias("place", "component")).withColumn("component", F.col("component").cast("double"))


@_query("select l_orderkey, l_quantity from lineitem")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a blob table: the others are not decoded."""
    df = table(spark, sf_dir, "lineitem")
    whole = from_spark(df.schema, "lineitem")
    return through_blobs(df, whole, Struct("lineitem", [f for f in whole.fields if f.name in ("l_orderkey", "l_quantity")]))


@_query("select o_orderkey, o_totalprice from orders")
def format_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source by its name: spark.read.format(...).schema(...).load(...)."""
    path = scratch(spark, "blobs")
    blobs.write(table(spark, sf_dir, "orders"), path)
    return spark.read.format(blobs.FORMAT).schema("o_orderkey long, o_totalprice double").load(path)


@_query("select count(*) as frames_rows, true as all_frames from nation")
def sniff_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "blobs")
    blobs.write(table(spark, sf_dir, "nation"), path)
    frames = spark.read.format("binaryFile").load(path)
    rows = blobs.scan(spark, path).agg(F.count("*").alias("frames_rows"))
    return rows.crossJoin(frames.agg(F.bool_and(streams.is_frame()).alias("all_frames")))  # one row each


# Evolution of flat rows ---------------------------------------------------------------------------------------------------


def _evolved(spark: SparkSession, sf_dir: str, name: str, fields: Callable[[dict[str, Field]], list[Field]], required: bool = False, strict: bool = False) -> DataFrame:
    df = table(spark, sf_dir, name)
    writer = from_spark(df.schema, name, required)
    return evolve(df, writer, validate(Struct(name, fields({f.name: f for f in writer.fields}))), strict)


@_query("select *, 7::int as tier, null::varchar as motto from customer")
def evolve_add_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "customer", lambda f: [*f.values(), Field("tier", I32, 7), Field("motto", Option(STRING))])


@_query("select c_name, c_custkey from customer")
def evolve_drop_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "customer", lambda f: [f["c_name"], f["c_custkey"]])


@_query("select c_custkey, c_name as title from customer")
def evolve_rename_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "customer", lambda f: [f["c_custkey"], Field("title", Option(STRING), aliases=("c_name",))])


@_query("select c_custkey, c_nationkey::bigint as c_nationkey from customer")
def evolve_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "customer", lambda f: [f["c_custkey"], Field("c_nationkey", Option(I64))])


@_query("select p_partkey, p_size::tinyint as p_size from part")
def evolve_narrow_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "part", lambda f: [f["p_partkey"], Field("p_size", Option(I8))], strict=True)


@_query("select 'p_size' as path, count(*) filter (p_size > 127 or p_size < -128)::bigint as rows from part union all select 'o_custkey', count(*) filter (o_custkey > 127 or o_custkey < -128) from orders union all select 'o_orderkey', count(*) filter (o_orderkey > 65535 or o_orderkey < 0) from orders")
def evolve_narrow_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    writer = from_spark(df.schema, "orders")
    counts = misfits(df, writer, Struct("orders", [Field("o_custkey", Option(I8)), Field("o_orderkey", Option(Primitive("u16")))]))
    part = table(spark, sf_dir, "part")
    return counts.union(misfits(part, from_spark(part.schema, "part"), Struct("part", [Field("p_size", Option(I8))])))


@_query("select c_custkey, c_nationkey::bigint as c_nationkey from customer where c_nationkey between 0 and 255")
def evolve_signedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _evolved(spark, sf_dir, "customer", lambda f: [f["c_custkey"], Field("c_nationkey", Option(U32))])
    return df.where("c_nationkey <= 255")


@_query("select c_custkey, c_nationkey::double as c_nationkey, c_acctbal::float as c_acctbal from customer")
def evolve_int_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "customer", lambda f: [f["c_custkey"], Field("c_nationkey", Option(F64)), Field("c_acctbal", Option(F32))])


@_query("select n_nationkey, n_name from nation")
def evolve_option_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "nation", lambda f: [Field("n_nationkey", Option(I32)), Field("n_name", Option(STRING))], required=True)


@_query("select o_orderkey, case when o_orderstatus = 'P' then 0 else 1 end as n, case when o_orderstatus <> 'P' then o_orderstatus end as first_one from orders")
def evolve_option_to_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("s"))
    out = evolve(df, from_spark(df.schema), Struct("", [("o_orderkey", Option(I64)), ("s", Seq(STRING))]))
    return out.select("o_orderkey", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first_one"))


@_query("select n_nationkey, true as n_comment_seen from nation")
def evolve_to_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evolved(spark, sf_dir, "nation", lambda f: [f["n_nationkey"], Field("n_comment_seen", Unit(), aliases=("n_name",))])


@_query("select count(*)::bigint as n, sum(c_custkey)::bigint as keys from customer")
def evolve_strict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strict keeps the row checks under an aggregate that reads other columns."""
    df = _evolved(spark, sf_dir, "customer", lambda f: [f["c_custkey"], Field("c_nationkey", Option(U8))], strict=True)
    return df.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


# Evolution of shapes -------------------------------------------------------------------------------------------------------


def _reshaped(spark: SparkSession, sf_dir: str, name: str, key: str, value: Column, writer: Node, reader: Node) -> DataFrame:
    df = table(spark, sf_dir, name).select(F.col(key).alias("key"), value.alias("v"))
    return df.select("key", reconcile(writer, reader, F.col("v"), "v").alias("v"))




def _line() -> Column:
    return F.struct(F.col("l_quantity").alias("_0"), F.col("l_extendedprice").alias("_1"), F.col("l_discount").alias("_2"))


_TRIPLE = TupleStruct("Line", [F64, F64, F64])


@_query("select c_custkey as key, c_name as name, 1::int as rank from customer")
def evolve_newtype_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = Struct("Named", [Field("name", STRING, aliases=("0",)), Field("rank", I32, 1)])
    return _reshaped(spark, sf_dir, "customer", "c_custkey", F.col("c_name"), Newtype("Old", STRING), reader).select("key", "v.name", "v.rank")


@_query("select l_orderkey as key, l_extendedprice as price, l_quantity as quantity from lineitem")
def evolve_tuple_to_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = Struct("Line", [Field("price", F64, aliases=("1",)), Field("quantity", F64, aliases=("0",))])
    return _reshaped(spark, sf_dir, "lineitem", "l_orderkey", _line(), _TRIPLE, reader).select("key", "v.price", "v.quantity")


@_query("select l_orderkey as key, l_quantity as a, l_extendedprice as b, l_discount as c, 0.5::double as d from lineitem")
def evolve_tuple_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = TupleStruct("Line", [F64, F64, F64, Field("", F64, 0.5)])
    return _reshaped(spark, sf_dir, "lineitem", "l_orderkey", _line(), _TRIPLE, reader).select("key", *[F.col(f"v._{i}").alias(n) for i, n in enumerate("abcd")])


@_query("select l_orderkey as key, l_quantity as a, l_extendedprice as b from lineitem")
def evolve_tuple_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reshaped(spark, sf_dir, "lineitem", "l_orderkey", _line(), _TRIPLE, TupleStruct("Line", [F64, F64])).select("key", F.col("v._0").alias("a"), F.col("v._1").alias("b"))


@_query("select l_orderkey as key, l_quantity as a, l_extendedprice as b, l_discount as c from lineitem")
def evolve_seq_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = F.array("l_quantity", "l_extendedprice", "l_discount")
    return _reshaped(spark, sf_dir, "lineitem", "l_orderkey", array, Seq(F64), Tuple([F64] * 3)).select("key", *[F.col(f"v._{i}").alias(n) for i, n in enumerate("abc")])


@_query("select l_orderkey as key, 3 as n, round(l_quantity + l_extendedprice + l_discount, 4) as total from lineitem")
def evolve_array_to_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reshaped(spark, sf_dir, "lineitem", "l_orderkey", _line(), Tuple([F64] * 3), Seq(F64))
    return out.select("key", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    return lines.withColumnRenamed("l_orderkey", "key")


@_query("select l_orderkey as key, l_linenumber::bigint as no, l_quantity as quantity, 'each' as unit from lineitem")
def evolve_seq_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_with_lines(spark, sf_dir)
    writer = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", I32), ("quantity", F64), ("flag", STRING)])))])
    reader = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [Field("no", I64, aliases=("line",)), Field("quantity", F64), Field("unit", STRING, "each")])))])
    return evolve(df, writer, reader).select("key", F.explode("lines").alias("l")).select("key", "l.*")


@_query("select n_nationkey as key, n_name as k, n_regionkey::bigint as v from nation")
def evolve_map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.create_map(F.col("n_name"), F.col("n_regionkey"))
    out = _reshaped(spark, sf_dir, "nation", "n_nationkey", value, Map(STRING, I32), Map(Newtype("Name", STRING), I64))
    return out.select("key", F.explode("v").alias("k", "v"))


@_query("select c_custkey as key, ((c_nationkey * 30 + 100) % 360)::double as degrees, (c_nationkey * 30 + 100)::double as written_back from customer")
def convert_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value kept in another type: reconciled as that type, then converted; and converted back to be written."""
    degrees = Convert(F64, lambda c: F.pmod(c, F.lit(360.0)), lambda c: c + 0.0, "double")
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_nationkey") * 30 + 100).alias("angle"))
    writer = Struct("Turn", [("key", Option(I64)), ("angle", I32)])
    reader = Struct("Turn", [("key", Option(I64)), ("angle", degrees)])
    back = written(df.withColumn("angle", F.col("angle").cast("double")), reader).select(F.col("key").alias("k"), F.col("angle").alias("written_back"))
    return evolve(df, writer, reader).withColumnRenamed("angle", "degrees").join(back, F.col("key") == F.col("k")).drop("k")


# Enums ------------------------------------------------------------------------------------------------------------------------

_STATUS = Enum("Status", [Variant("F", "newtype", [F64]), Variant("O", "struct", [("clerk", STRING), ("priority", Option(STRING))]), Variant("P")])
_ORDER = Struct("Order", [("o_orderkey", I64), ("status", _STATUS)])


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    clerk = F.coalesce(F.col("o_orderpriority"), F.lit(""))
    status = F.struct(s.alias("tag"), F.when(s == "F", F.col("o_totalprice")).alias("F"), F.when(s == "O", F.struct(clerk.alias("clerk"), F.col("o_orderpriority").alias("priority"))).alias("O"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@_query("select o_orderkey, o_orderstatus as tag, case when o_orderstatus = 'F' then o_totalprice end as price, case when o_orderstatus = 'O' then o_orderpriority end as priority from orders")
def enum_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_blobs(_statuses(spark, sf_dir), _ORDER).select("o_orderkey", "status.tag", F.col("status.F").alias("price"), F.col("status.O.priority").alias("priority"))


@_query("select 'F' as variant, (8 * count(*))::bigint as bytes from orders where o_orderstatus = 'F' union all select 'O', count(*)::bigint from orders where o_orderstatus = 'O' union all select 'tags', count(*)::bigint from orders")
def enum_encode_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload columns hold the rows of their variant only: 8 bytes a price, a presence byte a priority, a byte a tag."""
    path = scratch(spark, "blobs")
    blobs.write(_statuses(spark, sf_dir), path, _ORDER)
    sizes = blobs.column_bytes(spark, path)
    named = {f"{c.path}:{c.kind}": sizes.get(c.number, 0) for c in layout.columns(_ORDER)}
    return rows_of(spark, [("F", named["status.F:f64"]), ("O", named["status.O.priority:presence"]), ("tags", named["status:tags"])], "variant string, bytes long")


def _status_read(spark: SparkSession, sf_dir: str, reader: Enum, strict: bool = False) -> DataFrame:
    return evolve(_statuses(spark, sf_dir), _ORDER, Struct("Order", [("o_orderkey", I64), ("status", reader)]), strict)


@_query("select o_orderkey, o_orderstatus as tag, case when o_orderstatus = 'F' then o_totalprice end as price from orders")
def enum_add_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, o, p = _STATUS.variants
    return _status_read(spark, sf_dir, Enum("Status", [Variant("New", "newtype", [I64]), p, o, f])).select("o_orderkey", "status.tag", F.col("status.F").alias("price"))


@_query("select o_orderkey, case o_orderstatus when 'F' then 'Finished' else o_orderstatus end as tag, case when o_orderstatus = 'P' then 'none' end as why from orders")
def enum_rename_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant renamed with an alias, and a unit variant that gains fields with defaults."""
    reader = Enum("Status", [Variant("Finished", "newtype", [F64], ("F",)), Variant("O"), Variant("P", "struct", [Field("why", STRING, "none")])])
    return _status_read(spark, sf_dir, reader).select("o_orderkey", "status.tag", F.col("status.P.why").alias("why"))


@_query("select count(*) filter (o_orderstatus <> 'P')::bigint as readable, count(*) filter (o_orderstatus = 'P')::bigint as refused from orders")
def enum_remove_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of a variant that is gone are refused; the others read."""
    f, o, _ = _STATUS.variants
    known = _statuses(spark, sf_dir).withColumn("gone", ~F.col("status.tag").isin("F", "O"))
    kept = evolve(known.where("not gone").drop("gone"), _ORDER, Struct("Order", [("o_orderkey", I64), ("status", Enum("Status", [f, o]))]), strict=True)
    return kept.agg(F.count("*").alias("readable")).crossJoin(known.agg(F.count_if("gone").alias("refused")))  # one row each


@_query("select o_orderkey, o_totalprice as amount from orders where o_orderstatus = 'F'")
def enum_newtype_to_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, o, p = _STATUS.variants
    reader = Enum("Status", [Variant("F", "struct", [Field("amount", F64, aliases=("0",)), Field("paid", Primitive("bool"), True)]), o, p])
    return _status_read(spark, sf_dir, reader).where("status.tag = 'F'").select("o_orderkey", F.col("status.F.amount").alias("amount"))


# Shared values -----------------------------------------------------------------------------------------------------------------


@_query("with p as (select l_orderkey as key, l_linenumber as line, l_returnflag as flag, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_returnflag) as place from lineitem), f as (select *, min(place) over (partition by key, flag) as first_place from p) select key, line, (dense_rank() over (partition by key order by first_place) - 1)::int as shared_key from f")
def shared_keys_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_with_lines(spark, sf_dir)
    keyed = df.select("key", F.arrays_zip(F.col("lines.line").alias("line"), shared.keys(F.col("lines.flag")).alias("shared_key")).alias("z"))
    return keyed.select("key", F.explode("z").alias("z")).select("key", "z.line", "z.shared_key")


_SCENE = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", I32), ("quantity", F64), ("flag", Shared(STRING))])))])


@_query("select l_orderkey as key, l_linenumber as line, l_returnflag as flag from lineitem")
def shared_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written with a dictionary a row, read by a reader without sharing."""
    plain = Struct("Order", [("key", I64), ("lines", Seq(Struct("Line", [("line", I32), ("flag", STRING)])))])
    return through_blobs(_orders_with_lines(spark, sf_dir), _SCENE, plain).select("key", F.explode("lines").alias("l")).select("key", "l.line", "l.flag")


@_query("select (select count(*) from lineitem)::bigint as keys, (select count(*) from (select distinct l_orderkey, l_returnflag from lineitem))::bigint as entries")
def shared_dictionary_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the columns' sizes: a byte a key, a length byte an entry."""
    path = scratch(spark, "blobs")
    blobs.write(_orders_with_lines(spark, sf_dir), path, _SCENE)
    sizes = blobs.column_bytes(spark, path)
    at = {f"{c.path}:{c.kind}": c.number for c in layout.columns(_SCENE)}
    return rows_of(spark, [(sizes[at["lines.[].flag:keys"]], sizes[at["lines.[].flag:lengths"]])], "keys long, entries long")


# Layout and sizes ------------------------------------------------------------------------------------------------------------------


@_query("select * from (values (0, 'o_orderkey', 'i64'), (1, 'status', 'tags'), (2, 'status.F', 'f64'), (3, 'status.O.clerk', 'lengths'), (4, 'status.O.clerk', 'utf8'), (5, 'status.O.priority', 'presence'), (6, 'status.O.priority', 'lengths'), (7, 'status.O.priority', 'utf8')) t(number, path, kind)")
def layout_columns_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, [(c.number, c.path, c.kind) for c in layout.columns(_ORDER)], "number int, path string, kind string")


@_query("select * from (values (0, 'key', 'i64'), (1, 'lines', 'lengths'), (2, 'lines.[].line', 'i32'), (3, 'lines.[].quantity', 'f64'), (4, 'lines.[].flag', 'keys'), (5, 'lines.[].flag', 'lengths'), (6, 'lines.[].flag', 'utf8')) t(number, path, kind)")
def layout_columns_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, [(c.number, c.path, c.kind) for c in layout.columns(_SCENE)], "number int, path string, kind string")


_VARINT = "case when n < 128 then 1 when n < 16384 then 2 when n < 2097152 then 3 else 4 end"


def _bytes_sql(name: str, columns: list[tuple[str, int]]) -> str:
    """Bytes of each physical column of a table of nullable columns; width 0 is a string."""
    out, at = [], 0
    for c, wide in columns:
        out.append(f"select {at} as number, count(*)::bigint as bytes from {name}")
        if wide:
            out.append(f"select {at + 1}, ({wide} * count({c}))::bigint from {name}")
            at += 2
        else:
            out.append(f"select {at + 1}, coalesce(sum({_VARINT}), 0)::bigint from (select strlen({c}) as n from {name} where {c} is not null)")
            out.append(f"select {at + 2}, coalesce(sum(strlen({c})), 0)::bigint from {name}")
            at += 3
    return " union all ".join(out)


def _column_bytes(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    path = scratch(spark, "blobs")
    blobs.write(table(spark, sf_dir, name).select(*columns), path)
    return blobs.column_sizes(spark, path)


for _name, _columns in {
    "nation": [("n_nationkey", 4), ("n_name", 0), ("n_regionkey", 4)],
    "orders": [("o_orderkey", 8), ("o_totalprice", 8), ("o_orderstatus", 0)],
    "documents": [("doc_id", 8), ("text", 0), ("lang", 0)],
}.items():
    _query(_bytes_sql(_name, _columns), f"column_bytes_{_name}")(lambda spark, sf_dir, _t=_name, _c=_columns: _column_bytes(spark, sf_dir, _t, [c for c, _ in _c]))


@_query()
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of tables as blobs, plain and deflated file by file in tasks, and by columns."""
    import zlib

    def deflated(batches):
        for batch in batches:
            sizes = [(len(c.as_buffer()), len(zlib.compress(c.as_buffer(), 6))) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in sizes], pa.int64()), pa.array([b for _, b in sizes], pa.int64())], ["bytes", "deflated"])

    out: DataFrame | None = None
    for name in ("nation", "customer", "labels"):
        path = scratch(spark, "blobs")
        blobs.write(table(spark, sf_dir, name), path)
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{blobs.SUFFIX}").load(path).select("content").mapInArrow(deflated, "bytes long, deflated long")
        total = files.agg(F.lit(name).alias("name"), F.sum("bytes").alias("bytes"), F.sum("deflated").alias("deflated"))
        here = total.crossJoin(blobs.column_sizes(spark, path).agg(F.sum("bytes").alias("column_bytes")))  # one row each
        out = here if out is None else out.union(here)
    return out


# Versions together -------------------------------------------------------------------------------------------------------------------

_LATEST = Struct("Customer", [Field("key", I64, aliases=("c_custkey",)), Field("title", STRING, aliases=("c_name",)), Field("nation", I64, aliases=("c_nationkey",)), Field("tier", I32, 7)])


def _two_versions(spark: SparkSession, sf_dir: str) -> str:
    df, path = table(spark, sf_dir, "customer"), scratch(spark, "versions")
    first = Struct("Customer", [("c_custkey", I64), ("c_name", STRING), ("c_nationkey", I32)])
    second = Struct("Customer", [("title", STRING), ("key", I64), ("nation", I64), ("tier", I16), ("gone", F64)])
    blobs.write(df.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey"), path, first)
    later = df.where("c_custkey % 2 = 1").select(F.col("c_name").alias("title"), F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("nation"), F.lit(9).cast("short").alias("tier"), F.col("c_acctbal").alias("gone"))
    blobs.write(later, path, second)
    return path


_BOTH = "select c_custkey as key, c_name as title, c_nationkey::bigint as nation, case when c_custkey % 2 = 0 then 7 else 9 end::int as tier from customer"


@_query(_BOTH)
def multi_version_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blobs.scan(spark, _two_versions(spark, sf_dir), _LATEST)


@_query(_BOTH)
def stream_mixed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two versions arrive in one stream; each micro-batch is read version by version."""
    out = scratch(spark, "stream")
    frames = streams.contents(spark, _two_versions(spark, sf_dir))
    streams.for_each_version(frames, _LATEST, lambda df, i: df.write.mode("append").parquet(out), scratch(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)


@_query("select * from events")
def stream_events_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows streamed into blob files, and the files streamed back into rows."""
    source, middle, out = f"{sf_dir}/events.parquet", scratch(spark, "blobs"), scratch(spark, "stream")
    schema = spark.read.parquet(source).schema
    node = from_spark(schema, "Event")
    arriving = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(source if source.endswith("/") else source.rsplit("/", 1)[0] + "/event[s].parquet")
    streams.write_blobs(arriving, middle, scratch(spark, "offsets"), node).awaitTermination()
    rows = streams.read(spark, middle, node)
    rows.writeStream.option("checkpointLocation", scratch(spark, "offsets")).format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@_query("select * from labels")
def message_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as messages that each carry a frame, and back: what a queue would hold."""
    df = table(spark, sf_dir, "labels")
    node = from_spark(df.schema, "Label")
    return streams.read_mixed(streams.to_messages(df, node, 100), node)


# Values of common types -------------------------------------------------------------------------------------------------------------


@_query("select l_orderkey as key, l_linenumber as line, (l_partkey + (l_suppkey * 700000000) // 1000000000)::decimal(20, 0) as secs, ((l_suppkey * 700000000) % 1000000000)::bigint as nanos from lineitem")
def duration_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    d = std_types.duration(F.col("l_partkey"), F.col("l_suppkey").cast("long") * 700_000_000)
    return df.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), d.alias("d")).select("key", "line", "d.secs", "d.nanos")


@_query("select event_id, (epoch_us(ts) // 1000000)::decimal(20, 0) as secs, (epoch_us(ts) % 1000000 * 1000)::bigint as nanos from events")
def system_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = std_types.system_time(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", F.col("t.secs_since_epoch").alias("secs"), F.col("t.nanos_since_epoch").alias("nanos"))


@_query("select o_orderkey as key, '10.' || (o_custkey // 256 % 256) || '.' || (o_custkey % 256) || '.' || (o_orderkey % 256) as ip from orders")
def ip_octets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted text to octets, through blobs, and back to text."""
    text = F.concat_ws(".", F.lit("10"), F.floor(F.col("o_custkey") / 256) % 256, F.col("o_custkey") % 256, F.col("o_orderkey") % 256)
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), std_types.ipv4(text).alias("ip"))
    return through_blobs(df, Struct("Peer", [("key", I64), ("ip", std_types.IPV4)])).select("key", std_types.ipv4_text(F.col("ip")).alias("ip"))


@_query("select vec_id as key, round(sum(x::double), 5) as total from (select vec_id, unnest(embedding) as x from embeddings) group by vec_id")
def math_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components as four matrices, through blobs."""
    value = lambda m: F.struct(*[F.get("embedding", F.lit(16 * m + i)).alias(f"_{i}") for i in range(16)])
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), *[value(m).alias(f"m{m}") for m in range(4)])
    out = through_blobs(df, Struct("Body", [("key", I64), *[(f"m{m}", std_types.MATH["Mat4"]) for m in range(4)]]))
    parts = F.array(*[F.col(f"m{m}._{i}").cast("double") for m in range(4) for i in range(16)])
    return out.select("key", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@_query("select p_partkey as key, least(p_size, 25) as low, greatest(p_size, 25) as high, p_size >= 25 as ok from part")
def range_and_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, limit = F.col("p_size"), F.lit(25)
    outcome = F.struct(F.when(size >= 25, "Ok").otherwise("Err").alias("tag"), F.when(size >= 25, size).alias("Ok"), F.when(size < 25, F.col("p_name")).alias("Err"))
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), std_types.range_of(F.least(size, limit), F.greatest(size, limit)).alias("r"), outcome.alias("o"))
    out = through_blobs(df, Struct("Part", [("key", I64), ("r", std_types.value_range(I32)), ("o", std_types.result(I32, STRING))]))
    return out.select("key", F.col("r.start").alias("low"), F.col("r.end").alias("high"), (F.col("o.tag") == "Ok").alias("ok"))


@_query("select o_orderkey as key, o_custkey::decimal(20, 0) + 18446744073709000000 as big, ascii(substr(o_orderstatus, 1, 1)) as code from orders")
def unsigned_and_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at the upper end of u64, those beyond it as a variant of their own, and characters."""
    node = Enum("Big", [Variant("Fits", "newtype", [U64]), Variant("Wide", "newtype", [Newtype("decimal(21,0)", Primitive("i128"))])])
    big = F.col("o_custkey").cast("decimal(20,0)") + F.lit("18446744073709000000").cast("decimal(20,0)")
    fits = big <= F.lit("18446744073709551615").cast("decimal(20,0)")
    either = F.struct(F.when(fits, "Fits").otherwise("Wide").alias("tag"), F.when(fits, big.cast("decimal(20,0)")).alias("Fits"), F.when(~fits, big).alias("Wide"))
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), either.alias("big"), F.col("o_orderstatus").alias("letter"))
    out = through_blobs(df, Struct("Row", [("key", I64), ("big", node), ("letter", Primitive("char"))]))
    return out.select("key", F.coalesce(F.col("big.Fits").cast("decimal(21,0)"), F.col("big.Wide")).alias("big"), F.ascii("letter").alias("code"))


@_query("select l_orderkey as key, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as flags, count(distinct l_returnflag)::int as n from lineitem group by l_orderkey")
def set_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorted set and a hash set: written distinct, read distinct."""
    df = _orders_with_lines(spark, sf_dir).select("key", F.col("lines.flag").alias("flags"), F.col("lines.flag").alias("any_order"))
    out = through_blobs(df, Struct("Order", [("key", I64), ("flags", std_types.sorted_set(STRING)), ("any_order", std_types.hash_set(STRING))]))
    return out.select("key", F.concat_ws(",", "flags").alias("flags"), F.size("any_order").alias("n"))


@_query("select * from (values ('own schema', true), ('other schema', false)) t(reader, accepted)")
def exact_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without reconciling, only files of the reader's own schema are read."""
    path, df = scratch(spark, "blobs"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    own = from_spark(df.schema, "region")
    blobs.write(df, path, own)

    def accepted(reader: Struct) -> bool:
        try:
            return blobs.scan(spark, path, reader, exact=True).count() == df.count()
        except LamellaError:
            return False

    return rows_of(spark, [("own schema", accepted(own)), ("other schema", accepted(Struct("region", [("r_name", Option(STRING))])))], "reader string, accepted boolean")


# Definitions, verdicts and hostile input: fixed answers ------------------------------------------------------------------------------


@_query("select * from (values ('lowercase', 'max_speed', 'maxspeed'), ('UPPERCASE', 'MAX_SPEED', 'MAXSPEED'), ('PascalCase', 'MaxSpeed', 'MaxSpeed'), ('camelCase', 'maxSpeed', 'maxSpeed'), ('snake_case', 'max_speed', 'max_speed'), ('SCREAMING_SNAKE_CASE', 'MAX_SPEED', 'MAX_SPEED'), ('kebab-case', 'max-speed', 'max-speed'), ('SCREAMING-KEBAB-CASE', 'MAX-SPEED', 'MAX-SPEED')) t(rule, field, variant)")
def rename_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, [(r, rename.field("max_speed", r), rename.variant("MaxSpeed", r)) for r in rename.RULES], "rule string, field string, variant string")


@_query("select * from (values ('same', 'ok', 0), ('default', 'ok', 0), ('no default', 'unreadable', 0), ('wider', 'ok', 0), ('narrower', 'value dependent', 1), ('sign', 'value dependent', 1), ('variant gone', 'unreadable', 0), ('renamed', 'ok', 0), ('refuses', 'inconclusive', 0)) t(change, verdict, findings)")
def compat_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Struct("Save", [("id", U32), ("name", STRING), ("status", _STATUS)])
    key, name, status = old.fields
    f, o, _ = _STATUS.variants
    odd = Convert(I32, lambda c: F.when(c % 2 == 0, c).otherwise(F.raise_error(F.lit("odd")).cast("int")), lambda c: c, "int")
    readers = {
        "same": old,
        "default": Struct("Save", [key, name, status, Field("mana", U32, 50)]),
        "no default": Struct("Save", [key, name, status, Field("mana", U32)]),
        "wider": Struct("Save", [("id", U64), name, status]),
        "narrower": Struct("Save", [("id", U8), name, status]),
        "sign": Struct("Save", [("id", I32), name, status]),
        "variant gone": Struct("Save", [key, name, ("status", Enum("Status", [f, o]))]),
        "renamed": Struct("Save", [key, Field("title", STRING, aliases=("name",)), status]),
    }
    rows = [(k, compat.check(spark, old, r)) for k, r in readers.items()]
    rows.append(("refuses", compat.check(spark, Struct("Held", [("v", I32)]), Struct("Held", [("v", odd)]))))
    return rows_of(spark, [(k, r.verdict.value, len(r.findings)) for k, r in rows], "change string, verdict string, findings int")


@_query("select * from (values ('A.depth', 'u64', 'u16'), ('B', 'u64', 'u16'), ('C', 'u64', 'u16')) t(path, written, now)")
def compat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shape(t: Node) -> Node:
        return Enum("E", [Variant("A", "struct", [("depth", t)]), Variant("B", "newtype", [Seq(Option(t))]), Variant("C", "newtype", [Newtype("N", t)])])

    return compat.findings(spark, shape(U64), shape(Primitive("u16")))


@_query("select * from (values ('name reused', false), ('name held by unit', true), ('position reused', false), ('alias reused', false), ('variant reused', false), ('position on enum', false), ('free', true)) t(definition, accepted)")
def retirement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {
        "name reused": lambda: Struct("S", [("hp", F32)], ("hp",)),
        "name held by unit": lambda: Struct("S", [("hp", Unit())], ("hp",)),
        "position reused": lambda: TupleStruct("P", [F32, U32], (1,)),
        "alias reused": lambda: Struct("S", [Field("health", F32, 0.0, ("hp",))], ("hp",)),
        "variant reused": lambda: Enum("E", [Variant("A"), Variant("B")], ("B",)),
        "position on enum": lambda: Enum("E", [Variant("A")], (1,)),
        "free": lambda: Struct("S", [("health", F32)], ("hp",)),
    }

    def accepted(make: Callable[[], Node]) -> bool:
        try:
            validate(make())
        except LamellaError:
            return False
        return True

    return rows_of(spark, [(k, accepted(f)) for k, f in made.items()], "definition string, accepted boolean")


@_query("select * from (values ('rows beyond bytes', 'LimitExceeded'), ('zero columns', 'LimitExceeded'), ('long sequence', 'LimitExceeded'), ('padded varint', 'InvalidVarint'), ('presence', 'InvalidTag'), ('variant', 'InvalidTag'), ('shared key', 'InvalidTag'), ('bytes behind', 'TrailingBytes'), ('cut short', 'UnexpectedEof'), ('text', 'InvalidUtf8'), ('columns', 'Malformed')) t(input, error)")
def hardening_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    def blob(node: Node, values: list) -> bytes:
        batch = Batch(node)
        batch.push_rows(values)
        return batch.finish()

    from lamella.functions import varint

    big = varint.write_one(10**15)
    text = blob(STRING, ["ab"])
    inputs: dict[str, tuple[Node, bytes]] = {
        "rows beyond bytes": (U8, big + bytes([1, 1, 7])),
        "zero columns": (Unit(), varint.write_one(2**20 + 1) + b"\0"),
        "long sequence": (Seq(U32), bytes([1, 2, 4, 8]) + varint.write_one(200_000_000) + bytes(8)),
        "padded varint": (STRING, bytes([1, 2, 2, 2, 0x82, 0]) + b"ab"),
        "presence": (Option(U8), bytes([1, 2, 1, 0, 9])),
        "variant": (_STATUS, bytes([1, 7, 1, 0, 0, 0, 0, 0, 0, 0x37])),
        "shared key": (Seq(Shared(U8)), bytes([1, 3, 1, 2, 1, 2, 0, 9, 7])),
        "bytes behind": (STRING, text + b"x"),
        "cut short": (STRING, text[:-1]),
        "text": (STRING, text[:-2] + b"\xff\xff"),
        "columns": (STRING, bytes([1, 1, 1, 2])),
    }

    def error(node: Node, data: bytes) -> str:
        try:
            decode(node, data)
        except LamellaError as e:
            return type(e).__name__
        return "none"

    return rows_of(spark, [(k, error(*v)) for k, v in inputs.items()], "input string, error string")


from lamella import catalogue_forms as _forms  # noqa: E402, F401  registers its queries
