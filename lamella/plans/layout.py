"""Which physical columns a schema has: numbered in pre-order, a node's own before its children's."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from lamella.plans.schema import Bytes, Convert, Enum, Map, Newtype, Node, Option, Primitive, Seq, Shared, String, Unit, UnitStruct, Variant


@dataclass(frozen=True)
class PhysicalColumn:
    number: int
    path: str
    kind: str


@cache
def own_columns(node: Node) -> int:
    """How many columns a node has besides its children's."""
    if isinstance(node, Unit | UnitStruct | Newtype | Convert):
        return 0
    if isinstance(node, String | Bytes):
        return 2
    return 1 if isinstance(node, Primitive | Option | Seq | Map | Enum | Shared) else 0


@cache
def width(node: Node) -> int:
    """How many columns a node has in all."""
    return own_columns(node) + sum(map(width, node.children()))


def variant_width(variant: Variant) -> int:
    return sum(width(f.node) for f in variant.fields)


def columns(node: Node, path: str = "") -> list[PhysicalColumn]:
    """Every column in order, with the path of its node and what it holds."""
    out: list[PhysicalColumn] = []

    def add(at: str, kind: str) -> None:
        out.append(PhysicalColumn(len(out), at, kind))

    def join(at: str, name: str) -> str:
        return f"{at}.{name}" if at else name

    def walk(n: Node, at: str) -> None:
        match n:
            case Primitive():
                add(at, n.kind)
            case String() | Bytes():
                add(at, "lengths")
                add(at, "utf8" if isinstance(n, String) else "bytes")
            case Option():
                add(at, "presence")
                walk(n.inner, at)
            case Seq():
                add(at, "lengths")
                walk(n.inner, join(at, "[]"))
            case Map():
                add(at, "lengths")
                walk(n.key, join(at, "key"))
                walk(n.value, join(at, "value"))
            case Enum():
                add(at, "tags")
                for v in n.variants:
                    for f in v.fields:
                        walk(f.node, join(join(at, v.name), f.name) if v.kind != "newtype" else join(at, v.name))
            case Shared():
                add(at, "keys")
                walk(n.inner, at)
            case Newtype() | Convert():
                walk(n.inner, at)
            case _:
                for f in getattr(n, "fields", ()):
                    walk(f.node, join(at, f.name))

    walk(node, path)
    return out
