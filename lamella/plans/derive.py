"""Schemas from Python definitions: dataclasses for structs, lists of cases for enums."""

from __future__ import annotations

import dataclasses
import types
import typing
from collections.abc import Callable, Mapping
from typing import Any

from lamella.errors import DepthLimitExceeded, Unsupported, Untraceable
from lamella.functions import rename
from lamella.plans.schema import MAX_DEPTH, MISSING, Bytes, Convert, Enum, Field, Map, Newtype, Node, Option, Primitive, Seq, Shared, String, Struct, Tuple, TupleStruct, Unit, UnitStruct, Variant
from lamella.plans.spec import reject, validate

_SCHEMAS: dict[type, Node] = {}
#: A case of an enum that is never written: it has no place in the schema, and rows that use it are refused.
SKIPPED: Any = type("Skipped", (), {"__repr__": lambda self: "SKIPPED"})()


def attributes(**given: Any) -> dict[str, Any]:
    """Metadata of a dataclass field: rename, default, aliases, skip, shared, convert."""
    return {"lamella": given}


def convert(inner: Any, read: Callable | None, write: Callable | None, spark: str = "") -> Convert:
    """A value written as another type: both directions are column functions."""
    return Convert(node_of(inner), read, write, spark)


def node_of(kind: Any, depth: int = 0) -> Node:
    """The schema of a Python annotation: nodes stand for themselves, int is i64, float f64, tuple[...] a tuple."""
    if depth >= MAX_DEPTH:
        raise DepthLimitExceeded
    if isinstance(kind, Node):
        return kind
    if kind in _SCHEMAS:
        return _SCHEMAS[kind]
    if kind in (None, type(None)):
        return Unit()
    simple = {bool: Primitive("bool"), int: Primitive("i64"), float: Primitive("f64"), str: String(), bytes: Bytes()}
    if isinstance(kind, type) and kind in simple:
        return simple[kind]
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1 and len(args) == 2:
            return Option(node_of(rest[0], depth + 1))
        raise Untraceable(f"{kind}: only a value or nothing; alternatives are an enum")
    if origin in (list, set, frozenset):
        return Seq(node_of(args[0], depth + 1), order="" if origin is list else "set")
    if origin in (dict, Mapping):
        return Map(node_of(args[0], depth + 1), node_of(args[1], depth + 1))
    if origin is tuple:
        return Seq(node_of(args[0], depth + 1)) if len(args) == 2 and args[1] is Ellipsis else Tuple([node_of(a, depth + 1) for a in args])
    if dataclasses.is_dataclass(kind):
        return of_dataclass(kind, depth=depth + 1)
    raise Untraceable(f"{kind!r} has no schema: give it one, or a conversion")


def schema(cls: type | None = None, **container: Any) -> Any:
    """Decorator: the dataclass gets a checked schema (class attribute __schema__).

    container: kind ("struct", "tuple", "newtype", "unit"), rename, rename_all, removed, transparent.
    """

    def apply(c: type) -> type:
        c = c if dataclasses.is_dataclass(c) else dataclasses.dataclass(c)
        c.__schema__ = _SCHEMAS[c] = validate(of_dataclass(c, container))
        return c

    return apply(cls) if cls is not None else apply


def of_dataclass(cls: type, container: dict[str, Any] | None = None, depth: int = 0) -> Node:
    container = container or {}
    reject(cls.__name__, container)
    name = container.get("rename", cls.__name__)
    hints = typing.get_type_hints(cls, localns={c.__name__: c for c in _SCHEMAS}) if not all(isinstance(f.type, Node) for f in dataclasses.fields(cls)) else {}
    fields = []
    for f in dataclasses.fields(cls):
        given = dict(f.metadata.get("lamella", {}))
        reject(f"{cls.__name__}.{f.name}", given)
        if given.get("skip"):
            continue
        node = given["convert"] if "convert" in given else node_of(hints.get(f.name, f.type), depth)
        if given.get("shared"):
            node = Shared(node)
        wire = given.get("rename") or (rename.field(f.name, container["rename_all"]) if "rename_all" in container else f.name.removesuffix("_") if f.name.endswith("_") and not f.name.startswith("_") else f.name)
        fallback = f.default if f.default is not dataclasses.MISSING else f.default_factory if f.default_factory is not dataclasses.MISSING else MISSING
        fields.append(Field(wire, node, given.get("default", fallback), tuple(given.get("aliases", ()))))
    if container.get("transparent"):
        if len(fields) != 1:
            raise Unsupported(f"{cls.__name__}: transparent needs one field")
        return fields[0].node
    match container.get("kind", "struct"):
        case "unit":
            return UnitStruct(name)
        case "newtype":
            return Newtype(name, fields[0].node)
        case "tuple":
            return Newtype(name, fields[0].node) if len(fields) == 1 else TupleStruct(name, fields, tuple(container.get("removed", ())))
        case "struct":
            return Struct(name, fields, tuple(container.get("removed", ())))
    raise Unsupported(f"{cls.__name__}: kind {container['kind']!r}")


def enum(name: str, cases: Mapping[str, Any], rename_all: str | None = None, rename_all_fields: str | None = None, removed: tuple[str, ...] = (), aliases: Mapping[str, tuple[str, ...]] | None = None) -> Enum:
    """An enum: each case None (unit), a type (newtype), a tuple of types, a dict or dataclass (named fields), or SKIPPED."""
    out = []
    for case, kind in cases.items():
        wire = rename.variant(case, rename_all) if rename_all else case
        also = tuple((aliases or {}).get(case, ()))
        named = lambda n: rename.field(n, rename_all_fields) if rename_all_fields else n
        if kind is SKIPPED:
            continue
        if kind is None:
            out.append(Variant(wire, "unit", (), also))
        elif isinstance(kind, tuple):
            out.append(Variant(wire, "newtype" if len(kind) == 1 else "tuple", [k if isinstance(k, Field) else node_of(k) for k in kind], also))
        elif isinstance(kind, dict):
            out.append(Variant(wire, "struct", [Field(named(n), k.node, k.default, k.aliases) if isinstance(k, Field) else Field(named(n), node_of(k)) for n, k in kind.items()], also))
        else:
            out.append(Variant(wire, "newtype", [node_of(kind)], also))
    return validate(Enum(name, out, removed))
