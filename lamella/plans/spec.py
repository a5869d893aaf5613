"""Rules that a reader's definition must keep, checked when it is made and never part of any bytes."""

from __future__ import annotations

from lamella.errors import SchemaMismatch, Unsupported
from lamella.plans.schema import Enum, Field, Node, Struct, Tuple, TupleStruct, Unit, UnitStruct


def _retired(what: str, name: object, where: str) -> SchemaMismatch:
    return SchemaMismatch(f"a {what} that was never retired", f"{name!r}, which is: data written before still holds it with its old meaning", where)


def _placeholder(f: Field) -> bool:
    return isinstance(f.node, Unit | UnitStruct)


def _fields(where: str, fields: tuple[Field, ...], removed: tuple[int | str, ...], named: bool) -> None:
    seen: set[str] = set()
    for i, f in enumerate(fields):
        for name in f.names:
            if named and name in seen:
                raise SchemaMismatch("names and aliases that differ", f"{name!r} twice", where)
            seen.add(name)
        if named and f.name in removed and not _placeholder(f):
            raise _retired("name", f.name, where)
        if not named and i in removed and not _placeholder(f):
            raise _retired("position", i, where)
        for alias in f.aliases:
            if alias in removed or alias.isdigit() and int(alias) in removed:
                raise _retired("alias", alias, where)


def _variants(node: Enum) -> None:
    seen: set[str] = set()
    for r in node.removed:
        if isinstance(r, int):
            raise Unsupported(f"{node.name}: variants are known by name, so a position can't be retired")
    for v in node.variants:
        for name in v.names:
            if name in node.removed:
                raise _retired("variant", name, node.name)
            if name in seen:
                raise SchemaMismatch("variant names and aliases that differ", f"{name!r} twice", node.name)
            seen.add(name)


def validate(node: Node) -> Node:
    """The node, if its definition and all below keep the rules.

    A retired field name or position is never used again but by a unit that holds its place; no alias claims a retired name or
    position; a retired variant's name never comes back as a name or an alias; names and aliases of one container differ.
    Names are those on the wire, after any renaming.
    """
    match node:
        case Struct():
            _fields(node.name, node.fields, node.removed, True)
        case TupleStruct():
            _fields(node.name, node.fields, node.removed, False)
        case Tuple():
            _fields("tuple", node.fields, (), False)
        case Enum():
            _variants(node)
            for v in node.variants:
                _fields(f"{node.name}.{v.name}", v.fields, (), v.kind == "struct")
    for child in node.children():
        validate(child)
    return node


#: Definitions that the format has no place for, and why.
REJECTED = {
    "untagged": "a value's variant must be on the wire",
    "tag": "a variant's tag is a column of its own, not a field",
    "content": "a variant's payload has columns of its own, not a field",
    "flatten": "a flattened field has no name of its own to be found by",
    "skip_serializing_if": "rows are complete: a field is written in all or none",
    "skip_serializing": "a field left out on one side only would be missing on the other; use skip",
    "skip_deserializing": "a field left out on one side only would be missing on the other; use skip",
    "field_identifier": "identifiers of fields are no data",
    "variant_identifier": "identifiers of variants are no data",
    "remote": "a remote definition can't be told from the type itself",
    "with": "a codec of one's own hides its representation; use a conversion",
    "from": "a conversion needs both directions and a representation",
    "into": "a conversion needs both directions and a representation",
    "try_from": "a conversion needs both directions and a representation",
}


def reject(where: str, attributes: dict[str, object]) -> None:
    for name, value in attributes.items():
        if name in REJECTED:
            raise Unsupported(f"{where}: {name}: {REJECTED[name]}")
        if name in ("rename", "rename_all", "rename_all_fields") and isinstance(value, dict):
            raise Unsupported(f"{where}: {name}: one name serves both directions")
        if name not in ("rename", "rename_all", "rename_all_fields", "default", "aliases", "alias", "skip", "removed", "convert", "transparent", "shared", "order", "nonzero", "kind"):
            raise Unsupported(f"{where}: there is no attribute {name}")


