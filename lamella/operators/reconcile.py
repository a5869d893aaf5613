"""Schema evolution: what a reader asks for, from what a writer wrote, as column expressions.

The writer's schema and the reader's are compared once, when the plan is made; every change that could alter meaning
in silence is refused there. What is left is plain projection that Catalyst prunes, pushes through and compiles.
Structs are never cast, only built anew by name. Changes that some values survive and others don't raise on
the values that don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.errors import SchemaMismatch
from lamella.plans.schema import MISSING, Bytes, Convert, Enum, Field, Map, Newtype, Node, Option, Primitive, Seq, Shared, String, Struct, Tuple, TupleStruct, Unit, UnitStruct, Variant, boxed, field_name, spark_type

_INT_TYPES = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)"}


@dataclass(frozen=True)
class Options:
    #: a missing option without a default reads as null
    missing_option_is_null: bool = True
    #: a shared value read by a reader without sharing is refused
    strict_shared: bool = False


def lit(value: object, node: Node) -> Column:
    """A default as a column of the node's type: a Python value, a Column, or a function that gives either."""
    if callable(value) and not isinstance(value, Column):
        value = value()
    if isinstance(value, Column):
        return value.cast(spark_type(node))
    inner = node
    while isinstance(inner, Newtype | Shared):
        inner = inner.inner
    kind = spark_type(node)
    if value is None:
        return F.lit(None).cast(kind)
    match inner:
        case Convert():
            return F.lit(value).cast(kind)
        case Option():
            got = lit(value, inner.inner)
            return F.struct(got.alias("value")) if boxed(inner) else got
        case Struct() | Tuple() | TupleStruct():
            names = [field_name(inner, f) for f in inner.fields]
            get = (lambda i, n: value[n]) if isinstance(value, dict) else (lambda i, n: value[i])
            return F.struct(*[lit(get(i, n), f.node).alias(n) for i, (n, f) in enumerate(zip(names, inner.fields, strict=True))])
        case Enum():
            tag, load = (value, None) if isinstance(value, str) else value
            return _enum_struct(inner, F.lit(tag), {v.name: lit(load, v.payload) for v in inner.variants if v.name == tag and v.payload is not None})
        case Seq():
            return F.array(*[lit(v, inner.inner) for v in value]).cast(kind)
        case Map():
            items = [x for k, v in value.items() for x in (lit(k, inner.key), lit(v, inner.value))]
            return F.create_map(*items).cast(kind)
    return F.lit(value).cast(kind)


def _enum_struct(node: Enum, tag: Column, loads: dict[str, Column]) -> Column:
    return F.struct(tag.alias("tag"), *[(loads[v.name] if v.name in loads else F.lit(None).cast(spark_type(v.payload))).alias(v.name) for v in node.variants if v.payload is not None])


def collected(node: Seq, values: Column) -> Column:
    """Values as the sequence's kind holds them: as they come, distinct, or distinct and ascending."""
    if not node.order:
        return values
    return F.sort_array(F.array_distinct(values)) if node.order == "sorted" else F.array_distinct(values)


def by_key(entries: Column) -> Column:
    """Map entries in ascending order of keys, so that equal maps have equal bytes."""
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def is_identity(writer: Struct, reader: Struct) -> bool:
    """Whether the reader takes the writer's columns as they are, so that nothing is computed."""
    return writer == reader and not any(_reads_differently(f.node) for f in reader.fields)


def child(col: Column, name: str) -> Column:
    return col.getField(name)


def reconcile(writer: Node, reader: Node, col: Column, path: str = "", options: Options = Options()) -> Column:
    """The reader's value from a column of the writer's type. Raises SchemaMismatch where no value could be read."""
    return _Compiler(options).value(writer, reader, col, path)


@dataclass(frozen=True)
class Narrowing:
    """An integer that the reader keeps in a type which lacks some of the writer's values."""

    path: str
    written: str
    now: str

    def __str__(self) -> str:
        return f"{self.path or 'the value'} narrows from {self.written} to {self.now}"


@dataclass(frozen=True)
class Assessment:
    """What compiling a reader shows before any data is read."""

    narrowings: tuple[Narrowing, ...] = field(default=())
    refusal: str = ""


def assess(writer: Node, reader: Node, options: Options = Options()) -> Assessment:
    """The narrowings that the compiled projection checks row by row, wherever an alias or a position leads, and the refusal that ended
    the compilation, if one did. Needs a session, as any column does."""
    compiler, refusal = _Compiler(options), ""
    try:
        compiler.value(writer, reader, F.lit(None), "")
    except SchemaMismatch as e:
        refusal = str(e)
    return Assessment(tuple(compiler.narrowings), refusal)


def plan_kind(writer: Struct, reader: Struct, options: Options = Options()) -> str:
    """Which plan a reader gets: "identity" (the writer's columns as they are), "projection" (columns chosen, renamed or built anew, no
    row can fail), "checked" (some rows may be refused) or "refused"."""
    if is_identity(writer, reader):
        return "identity"
    found = assess(writer, reader, options)
    if found.refusal:
        return "refused"
    return "checked" if found.narrowings or _may_fail(writer, reader) else "projection"


def _may_fail(writer: Node, reader: Node) -> bool:
    """Whether enums that lose variants, sequences of a due length, values that may not be zero or conversions are among what is read."""
    inside = (Enum, Convert, Tuple)
    return any(isinstance(n, inside) or isinstance(n, Primitive) and n.nonzero for n in _below(reader))


def _below(node: Node) -> Iterable[Node]:
    yield node
    for child_ in node.children():
        yield from _below(child_)


class _Compiler:
    def __init__(self, options: Options):
        self.options = options
        self.narrowings: list[Narrowing] = []

    def refuse(self, writer: Node, reader: Node, path: str) -> SchemaMismatch:
        return SchemaMismatch(reader.describe(), writer.describe(), path)

    def value(self, w: Node, r: Node, col: Column, path: str) -> Column:
        while isinstance(w, Newtype | Convert):
            w = w.inner
        if isinstance(r, Convert):
            return r.read(self.value(w, r.inner, col, path))
        if isinstance(r, Newtype):
            return self.value(w, r.inner, col, path)
        if isinstance(r, Unit | UnitStruct):
            return F.lit(True)
        if isinstance(w, Shared):
            if not isinstance(r, Shared) and self.options.strict_shared:
                raise SchemaMismatch("a shared value", r.describe(), path)
            return self.value(w.inner, r.inner if isinstance(r, Shared) else r, col, path)
        if isinstance(r, Shared):
            return self.value(w, r.inner, col, path)
        if isinstance(w, Option):
            return self.option(w, r, col, path)
        if isinstance(r, Option):
            got = self.value(w, r.inner, col, path)
            return F.struct(got.alias("value")) if boxed(r) else got
        match r:
            case Primitive():
                if isinstance(w, Primitive):
                    return self.primitive(w, r, col, path)
            case String() | Bytes():
                if type(w) is type(r):
                    return col
            case Seq():
                if isinstance(w, Seq):
                    same = w.inner == r.inner and not _reads_differently(r.inner)
                    return collected(r, col if same else F.transform(col, lambda x: self.value(w.inner, r.inner, x, f"{path}[]")))
                if isinstance(w, Tuple):
                    return collected(r, F.array(*[self.value(f.node, r.inner, child(col, f"_{f.name}"), f"{path}.{f.name}") for f in w.fields]))
            case Map():
                if isinstance(w, Map):
                    pair = lambda e: F.struct(self.value(w.key, r.key, e["key"], f"{path}.key").alias("key"), self.value(w.value, r.value, e["value"], f"{path}.value").alias("value"))
                    return F.map_from_entries(F.transform(F.map_entries(col), pair))
            case Tuple() | TupleStruct():
                return self.positions(w, r, col, path)
            case Struct():
                return self.struct(w, r.fields, col, path, r)
            case Enum():
                if isinstance(w, Enum):
                    return self.enum(w, r, col, path)
        raise self.refuse(w, r, path)

    def option(self, w: Option, r: Node, col: Column, path: str) -> Column:
        inside = child(col, "value") if boxed(w) else col
        if isinstance(r, Option):
            got = self.value(w.inner, r.inner, inside, path)
            return F.when(col.isNotNull(), F.struct(got.alias("value")) if boxed(r) else got)
        if isinstance(r, Seq):
            got = self.value(w.inner, r.inner, inside, path)
            return F.when(col.isNull(), F.array().cast(spark_type(r))).otherwise(F.array(got))
        raise SchemaMismatch(r.describe(), f"{w.describe()}, which may hold nothing", path)

    def primitive(self, w: Primitive, r: Primitive, col: Column, path: str) -> Column:
        if w.kind == r.kind:
            return self.nonzero(r, col, path)
        if w.integer and r.integer and w.width < 16 and r.width < 16:
            low, high = r.bounds()
            have_low, have_high = w.bounds()
            cast = col.cast(_INT_TYPES[r.kind])
            if low <= have_low and have_high <= high:
                return self.nonzero(r, cast, path)
            self.narrowings.append(Narrowing(path.replace("[]", ""), w.kind, r.kind))
            told = F.concat(F.lit(f"{path or 'the value'}: "), col.cast("string"), F.lit(f" does not fit {r.kind}"))
            bad = (col < F.lit(low).cast("decimal(20,0)")) | (col > F.lit(high).cast("decimal(20,0)"))
            return self.nonzero(r, F.when(bad, F.raise_error(told).cast(spark_type(r))).otherwise(cast), path)
        if (w.integer and w.width < 16 or w.float) and r.float:
            return col.cast("float" if r.kind == "f32" else "double")
        raise self.refuse(w, r, path)

    def nonzero(self, r: Primitive, col: Column, path: str) -> Column:
        if not r.nonzero:
            return col
        return F.when(col == 0, F.raise_error(F.lit(f"{path or 'the value'}: zero where none may be")).cast(spark_type(r))).otherwise(col)

    def missing(self, f: Field, path: str) -> Column:
        if f.default is not MISSING:
            return lit(f.default, f.node)
        if isinstance(f.node, Option) and self.options.missing_option_is_null:
            return F.lit(None).cast(spark_type(f.node))
        if isinstance(f.node, Unit | UnitStruct):
            return F.lit(True)
        raise SchemaMismatch(f"a field `{f.name}`", "none, and the reader gives no default", path)

    def positions(self, w: Node, r: Tuple | TupleStruct, col: Column, path: str) -> Column:
        if isinstance(w, Struct):
            raise SchemaMismatch("named fields, as they were written", "positions, which names can't be told to take", path)
        if isinstance(w, Seq) and isinstance(r, Tuple):
            n = len(r.fields)
            items = F.struct(*[self.value(w.inner, f.node, F.get(col, F.lit(i)), f"{path}[{i}]").alias(f"_{i}") for i, f in enumerate(r.fields)])
            told = F.concat(F.lit(f"{path or 'the value'}: a sequence of "), F.size(col).cast("string"), F.lit(f" where {n} are due"))
            return F.when(F.size(col) != n, F.raise_error(told).cast(spark_type(r))).otherwise(items)
        if not isinstance(w, Tuple | TupleStruct):
            raise self.refuse(w, r, path)
        return self.by_position([f.node for f in w.fields], r.fields, lambda i: child(col, f"_{i}"), path, grows=isinstance(r, TupleStruct), what=r)

    def by_position(self, nodes: list[Node], fields: tuple[Field, ...], get: Callable[[int], Column], path: str, grows: bool, what: Node | None) -> Column:
        out = []
        for i, f in enumerate(fields):
            if i < len(nodes):
                got = self.value(nodes[i], f.node, get(i), f"{path}.{i}".lstrip("."))
            elif not grows:
                raise SchemaMismatch(f"{len(fields)} values", f"{len(nodes)}: a bare tuple can't grow", path)
            else:
                got = self.missing(f, path)
            out.append(got.alias(f"_{i}"))
        return F.struct(*out)

    def struct(self, w: Node, fields: tuple[Field, ...], col: Column, path: str, r: Node) -> Column:
        """Named fields, from fields by name, from positions that the reader declares, from one plain value, or from nothing."""
        if isinstance(w, Struct):
            return self.by_name(w.fields, fields, lambda f: child(col, f.name), path)
        if isinstance(w, Tuple | TupleStruct):
            return self.declared([f.node for f in w.fields], fields, lambda i: child(col, f"_{i}"), path)
        if isinstance(w, Unit | UnitStruct):
            return self.from_nothing(fields, path)
        if isinstance(w, Enum | Option):
            raise self.refuse(w, r, path)
        if not any("0" in f.names for f in fields):
            raise SchemaMismatch(r.describe(), f"{w.describe()}; alias a field \"0\" to read it there", path)
        return self.declared([w], fields, lambda i: col, path)

    def from_nothing(self, fields: tuple[Field, ...], path: str) -> Column:
        return F.struct(*[self.missing(f, f"{path}.{f.name}".lstrip(".")).alias(f.name) for f in fields])

    def by_name(self, have: Iterable[Field], fields: tuple[Field, ...], get: Callable[[Field], Column], path: str) -> Column:
        known = {f.name: f for f in have}
        out = []
        for f in fields:
            here = f"{path}.{f.name}".lstrip(".")
            found = [known[n] for n in f.names if n in known]
            if len(found) > 1:
                raise SchemaMismatch(f"one of {', '.join(f.names)}", "several of them", here)
            out.append((self.value(found[0].node, f.node, get(found[0]), here) if found else self.missing(f, here)).alias(f.name))
        return F.struct(*out)

    def declared(self, nodes: list[Node], fields: tuple[Field, ...], get: Callable[[int], Column], path: str) -> Column:
        places = {str(i) for i in range(len(nodes))}
        if not any(places.intersection(f.names) for f in fields):
            hints = ", ".join(f'"{i}"' for i in range(len(nodes)))
            raise SchemaMismatch(f"named fields aliased to the positions they replace ({hints})", "none: to match them in the order of declaration would change meaning once that order does", path)
        out = []
        for f in fields:
            here = f"{path}.{f.name}".lstrip(".")
            at = [int(n) for n in f.names if n in places]
            out.append((self.value(nodes[at[0]], f.node, get(at[0]), here) if at else self.missing(f, here)).alias(f.name))
        return F.struct(*out)

    def enum(self, w: Enum, r: Enum, col: Column, path: str) -> Column:
        by_name = {n: v for v in r.variants for n in v.names}
        tag, loads = child(col, "tag"), {}
        told = F.concat(F.lit(f"{path or 'the value'}: no variant of {r.name} is called "), tag)
        new_tag: Column | None = None
        for wv in w.variants:
            rv = by_name.get(wv.name)
            if rv is None:
                continue
            test = tag == wv.name
            new_tag = F.when(test, F.lit(rv.name)) if new_tag is None else new_tag.when(test, F.lit(rv.name))
            got = self.variant(wv, rv, child(col, wv.name), f"{path}.{wv.name}".lstrip("."))
            if rv.payload is not None and got is not None:
                loads[rv.name] = loads[rv.name].when(test, got) if rv.name in loads else F.when(test, got)
        failed = F.raise_error(told).cast("string")
        return _enum_struct(r, failed if new_tag is None else new_tag.otherwise(failed), loads)

    def variant(self, w: Variant, r: Variant, col: Column, path: str) -> Column | None:
        if r.kind == "unit":
            return None
        if w.kind == "unit":
            if r.kind == "struct":
                return self.from_nothing(r.fields, path)
            raise SchemaMismatch(r.describe(), f"{w.name}, which holds nothing", path)
        nodes = [f.node for f in w.fields]
        get = (lambda i: col) if w.kind == "newtype" else (lambda i: child(col, f"_{i}"))
        if r.kind == "struct":
            if w.kind == "struct":
                return self.by_name(w.fields, r.fields, lambda f: child(col, f.name), path)
            return self.declared(nodes, r.fields, get, path)
        if w.kind == "struct":
            raise SchemaMismatch("named fields, as they were written", f"{r.describe()}: positions, which names can't be told to take", path)
        if r.kind == "newtype":
            if len(nodes) != 1:
                raise SchemaMismatch("one value", f"{len(nodes)}", path)
            return self.value(nodes[0], r.fields[0].node, get(0), path)
        return self.by_position(nodes, r.fields, get, path, grows=True, what=None)


def projection(writer: Struct, reader: Struct, options: Options = Options()) -> list[Column]:
    """The reader's fields over a DataFrame whose columns are the writer's."""
    compiler = _Compiler(options)
    known = {f.name: f for f in writer.fields}
    out = []
    for f in reader.fields:
        found = [known[n] for n in f.names if n in known]
        if len(found) > 1:
            raise SchemaMismatch(f"one of {', '.join(f.names)}", "several of them", f.name)
        got = compiler.value(found[0].node, f.node, F.col(f"`{found[0].name}`"), f.name) if found else compiler.missing(f, f.name)
        out.append(got.alias(f.name))
    return out


def evolve(df: DataFrame, writer: Struct, reader: Struct, strict: bool = False, options: Options = Options()) -> DataFrame:
    """df, whose columns are the writer's, as the reader asks for it.

    A value that can't be read raises when its column is computed. strict: every row is checked whatever is selected
    afterwards, as the checks stand in a filter that pruning keeps.
    """
    if is_identity(writer, reader) and df.columns == [f.name for f in writer.fields]:
        return df
    cols = projection(writer, reader, options)
    if strict:
        # always true, but not before every column is computed; maps can't be hashed
        plain = [c for c, f in zip(cols, reader.fields, strict=True) if not _holds_map(f.node)]
        maps = [c for c, f in zip(cols, reader.fields, strict=True) if _holds_map(f.node)]
        checks = [F.xxhash64(F.struct(*plain)) % 2 < 5] * bool(plain) + [F.length(F.to_json(F.struct(*maps))) >= 0] * bool(maps)
        for check in checks:
            df = df.where(check)
    return df.select(*cols)


def _holds_map(node: Node) -> bool:
    return isinstance(node, Map) or any(map(_holds_map, node.children()))


def _reads_differently(node: Node) -> bool:
    """Whether reading the node's own data does more than take it."""
    own = isinstance(node, Convert) or isinstance(node, Primitive) and node.nonzero or isinstance(node, Seq) and bool(node.order)
    return own or any(map(_reads_differently, node.children()))


def _writes_differently(node: Node) -> bool:
    return isinstance(node, Convert | Map) or isinstance(node, Seq) and bool(node.order) or any(map(_writes_differently, node.children()))


def written(df: DataFrame, node: Struct) -> DataFrame:
    """df with every conversion taken back to its representation, sets made distinct and maps in the order of their keys,
    ready to be encoded."""

    def back(n: Node, col: Column) -> Column:
        match n:
            case Convert():
                return back(n.inner, n.write(col))
            case Newtype() | Shared():
                return back(n.inner, col)
            case _ if not _writes_differently(n):
                return col
            case Option():
                inside = child(col, "value") if boxed(n) else col
                got = back(n.inner, inside)
                return F.when(col.isNotNull(), F.struct(got.alias("value")) if boxed(n) else got)
            case Seq():
                return collected(n, F.transform(col, lambda x: back(n.inner, x)) if _writes_differently(n.inner) else col)
            case Map():
                pair = lambda e: F.struct(back(n.key, e["key"]).alias("key"), back(n.value, e["value"]).alias("value"))
                return F.map_from_entries(by_key(F.transform(F.map_entries(col), pair)))
            case Struct() | Tuple() | TupleStruct():
                return F.struct(*[back(f.node, child(col, field_name(n, f))).alias(field_name(n, f)) for f in n.fields])
            case Enum():
                return _enum_struct(n, child(col, "tag"), {v.name: F.when(child(col, "tag") == v.name, back(v.payload, child(col, v.name))) for v in n.variants if v.payload is not None})
        return col

    return df.select(*[back(f.node, F.col(f"`{f.name}`")).alias(f.name) for f in node.fields])

