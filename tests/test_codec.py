from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamella import errors as E
from lamella.functions import varint
from lamella.functions.std_types import BOOL, CHAR, F32, F64, I32, I64, MATH, NONZERO, STRING, U8, U16, U32, U64, U128
from lamella.operators.decode import decode, single
from lamella.operators.encode import Batch, encode
from lamella.plans.layout import columns, width
from lamella.plans.schema import Bytes, Enum, Map, Newtype, Option, Primitive, Seq, Shared, Struct, Tuple, Unit, UnitStruct, Variant, arrow_type
from lamella.sources.frame import from_frame, is_self_describing, peek_schema, to_frame

SHADE = Enum("Shade", [Variant("Plain"), Variant("Tinted", "newtype", [U8]), Variant("Blend", "tuple", [F32, F32]), Variant("Custom", "struct", [("red", U8), ("alpha", Option(F64))])])
KITCHEN = Struct(
    "Kitchen",
    [("id", U128), ("letter", CHAR), ("text", STRING), ("raw", Seq(U8)), ("flag", Seq(BOOL)), ("pair", Tuple([Primitive("i8"), U64])), ("maybe", Option(Option(U32))), ("shades", Seq(SHADE)), ("lookup", Map(STRING, Newtype("Meters", F64)))]
    + [("marker", UnitStruct("M")), ("blob", Bytes()), ("sh", Seq(Shared(STRING))), ("so", Shared(Option(STRING)))],
)
ROWS = [
    {"id": bytes(range(16)), "letter": "🦀", "text": "héé", "raw": [1, 255], "flag": [True, False], "pair": {"_0": -5, "_1": 2**64 - 1}, "maybe": None, "lookup": [("a", 1.5)], "marker": True, "blob": b"\0x", "sh": ["a", "b", "a"], "so": None}
    | {"shades": [{"tag": "Plain"}, {"tag": "Custom", "Custom": {"red": 3, "alpha": None}}, {"tag": "Blend", "Blend": {"_0": 1.0, "_1": -0.0}}]},
    {"id": bytes(16), "letter": "a", "text": "", "raw": [], "flag": [], "pair": {"_0": 5, "_1": 0}, "maybe": {"value": None}, "shades": [{"tag": "Tinted", "Tinted": 9}], "lookup": [], "marker": True, "blob": b"", "sh": ["b", "b", "c", "a"], "so": "q"},
    {"id": bytes(16), "letter": "ß", "text": "z" * 300, "raw": list(range(200)), "flag": [], "pair": {"_0": 5, "_1": 0}, "maybe": {"value": 7}, "shades": [], "lookup": [("x", 0.5), ("y", 2.0)], "marker": True, "blob": b"q", "sh": [], "so": "r"},
]


def blob(node, values) -> bytes:
    batch = Batch(node)
    batch.push_rows(values)
    return batch.finish()


def test_known_bytes():
    assert list(blob(Seq(Tuple([U32, F32])), [[{"_0": 1, "_1": 1.5}, {"_0": 2, "_1": 2.5}]])) == [1, 3, 1, 8, 8, 2, 1, 0, 0, 0, 2, 0, 0, 0, 0, 0, 192, 63, 0, 0, 32, 64]
    assert list(blob(Seq(STRING), [["ab", "", "cde"]])) == [1, 3, 1, 3, 5, 3, 2, 0, 3, 97, 98, 99, 100, 101]
    assert list(blob(Seq(Shared(U8)), [[7, 7]])) == [1, 3, 1, 2, 1, 2, 0, 0, 7]
    assert list(varint.write_one(16383)) == [255, 127]


def test_column_counts():
    reading = Struct("Reading", [("sensor", U16), ("celsius", F32)])
    assert [width(x) for x in (reading, Seq(reading), Option(STRING), Unit())] == [2, 3, 3, 0]
    assert len(columns(KITCHEN)) == width(KITCHEN)


def test_round_trip_of_every_node():
    data = blob(KITCHEN, ROWS)
    assert decode(KITCHEN, data).to_pylist() == pa.array(ROWS, arrow_type(KITCHEN)).to_pylist()


def test_pruned_decode():
    data = blob(KITCHEN, ROWS)
    for strict in (True, False):
        assert decode(KITCHEN, data, ["text", "sh"], strict).to_pylist() == [{"text": r["text"], "sh": r["sh"]} for r in ROWS]
    assert len(decode(KITCHEN, data, [], False)) == 3


def test_floats_keep_their_bits():
    values = [float("nan"), float("inf"), float("-inf"), -0.0, 2.2250738585072014e-308]
    out = decode(F64, blob(F64, values))
    assert np.array(values).tobytes() == out.to_numpy().tobytes()


def test_batch_rolls_back_and_is_reused():
    batch = Batch(Struct("R", [("a", U8), ("b", STRING)]))
    batch.push_rows([{"a": 1, "b": "x"}])
    with pytest.raises(E.LamellaError):
        batch.push_rows([{"a": 300, "b": "y"}])
    with pytest.raises(E.IncompleteRow):
        batch.push_rows([{"a": 3, "b": None}])
    out = bytearray()
    batch.push_rows([{"a": 2, "b": "z"}])
    assert batch.rows == 2
    batch.finish_into(out)
    assert decode(batch.node, bytes(out)).to_pylist() == [{"a": 1, "b": "x"}, {"a": 2, "b": "z"}]
    assert batch.rows == 0
    batch.push_rows([{"a": 9, "b": ""}])
    batch.reset()
    assert len(decode(batch.node, batch.finish())) == 0


def test_single():
    assert single(Seq(U8), blob(Seq(U8), [[1]])) == [1]
    with pytest.raises(E.Malformed):
        single(U8, blob(U8, [1, 2]))


def test_frames():
    data = to_frame(KITCHEN, pa.array(ROWS, arrow_type(KITCHEN)))
    assert is_self_describing(data) and not is_self_describing(b"CRB")
    node, array = from_frame(data)
    assert node == KITCHEN and len(array) == 3 and peek_schema(data)[0] == KITCHEN
    with pytest.raises(E.Malformed):
        peek_schema(b"nope" + data[4:])
    with pytest.raises(E.UnsupportedVersion):
        peek_schema(data[:4] + b"\2" + data[5:])
    with pytest.raises(E.UnexpectedEof):
        peek_schema(data[:20])


def test_shared_scope_is_row_and_position():
    node = Struct("S", [("a", Seq(Shared(STRING))), ("b", Seq(Shared(STRING)))])
    rows = [{"a": ["x", "x"], "b": ["x"]}, {"a": ["x"], "b": ["y", "x", "y"]}]
    data = blob(node, rows)
    assert decode(node, data).to_pylist() == rows
    # three dictionaries of "x", one of "y" and "x"
    assert data.count(b"x") == 4
    one = len(blob(Seq(Shared(STRING)), [["x" * 1000]]))
    assert len(blob(Seq(Shared(STRING)), [["x" * 1000] * 3])) == one + 2


def test_shared_floats_by_bits():
    values = [[0.0, -0.0, float("nan"), 0.0]]
    out = decode(Seq(Shared(F64)), blob(Seq(Shared(F64)), values)).flatten().to_numpy()
    assert out.tobytes() == np.array(values[0]).tobytes()


def test_nonzero_and_math():
    with pytest.raises(E.LamellaError):
        blob(NONZERO["NonZeroU32"], [0])
    with pytest.raises(E.LamellaError):
        decode(NONZERO["NonZeroU32"], blob(U32, [0]))
    assert sum(k.endswith(("Vec2", "Vec3", "Vec4", "Vec3A")) for k in MATH) == 40 and len(MATH["EulerRot"].variants) == 24
    mat = MATH["Mat3"]
    row = {f"_{i}": float(i) for i in range(9)}
    assert decode(mat, blob(mat, [row])).to_pylist() == [row]


def test_chars():
    with pytest.raises(E.SchemaMismatch):
        blob(CHAR, ["ab"])
    for bad in (0xD800, 0x110000):
        with pytest.raises(E.InvalidTag):
            decode(CHAR, bytes([1, 1, 4]) + bad.to_bytes(4, "little"))


def test_varints():
    for v in (0, 1, 127, 128, 16383, 16384, 2**32, 2**63, 2**64 - 1):
        assert varint.read_one(varint.write_one(v)) == (v, len(varint.write_one(v)))
    values = np.array([0, 127, 128, 16384, 2**63, 2**64 - 1], np.uint64)
    data = np.frombuffer(varint.write_many(values), np.uint8)
    out, used = varint.read_many(data, len(values))
    assert (out == values).all() and used == len(data)
    for bad in (b"\x80\x00", b"\xff" * 9 + b"\x02", b"\xff" * 11):
        with pytest.raises(E.InvalidVarint):
            varint.read_one(bad)
    with pytest.raises(E.UnexpectedEof):
        varint.read_one(b"\x80")


def test_limits():
    with pytest.raises(E.LimitExceeded):
        decode(Seq(Unit()), bytes([1, 1, 5]) + varint.write_one(500_000_000))
    with pytest.raises(E.LimitExceeded) as e:
        decode(Seq(U128), bytes([1, 2, 1, 32, 3]) + bytes(32))
    assert (e.value.claimed, e.value.limit) == (3, 2)
    with pytest.raises(E.LimitExceeded):
        decode(Map(U8, U8), bytes([1, 3, 5, 1, 1]) + varint.write_one(500_000_000) + b"\1\1")
    assert len(decode(Unit(), varint.write_one(1000) + b"\0")) == 1000


def test_every_truncation_and_bit_flip_fails_cleanly():
    data, rng = blob(KITCHEN, ROWS), random.Random(1)
    for i in range(len(data)):
        with pytest.raises(E.LamellaError):
            decode(KITCHEN, data[:i])
        flipped = bytearray(data)
        flipped[i] ^= 1 << rng.randrange(8)
        try:
            decode(KITCHEN, bytes(flipped))
        except E.LamellaError:
            pass


NODES = st.recursive(
    st.sampled_from([U8, I32, I64, F64, BOOL, STRING, Bytes(), Unit()]),
    lambda inner: st.one_of(inner.map(Option), inner.map(Seq), inner.map(Shared), st.lists(inner, min_size=1, max_size=3).map(Tuple), st.lists(inner, min_size=1, max_size=2).map(lambda ns: Enum("E", [Variant("U"), *[Variant(f"V{i}", "newtype", [n]) for i, n in enumerate(ns)]]))),
    max_leaves=6,
)


def value_of(node, rng: random.Random):
    match node:
        case Primitive(kind="bool"):
            return rng.random() < 0.5
        case Primitive(kind="f64"):
            return rng.choice([0.5, -1.0, 3.0])
        case Primitive():
            return rng.randrange(200)
        case Unit():
            return True
        case Bytes():
            return rng.randbytes(rng.randrange(4))
        case Option():
            from lamella.plans.schema import boxed

            inner = value_of(node.inner, rng)
            return None if rng.random() < 0.4 else {"value": inner} if boxed(node) else inner
        case Seq():
            return [value_of(node.inner, rng) for _ in range(rng.randrange(4))]
        case Shared():
            return value_of(node.inner, rng)
        case Tuple():
            return {f"_{i}": value_of(f.node, rng) for i, f in enumerate(node.fields)}
        case Enum():
            v = rng.choice(node.variants)
            return {"tag": v.name} | ({v.name: value_of(v.payload, rng)} if v.payload is not None else {})
    return "".join(rng.choice("abé") for _ in range(rng.randrange(5)))


@settings(max_examples=150, deadline=None)
@given(NODES, st.integers(0, 2**32))
def test_random_values_survive(node, seed):
    rng = random.Random(seed)
    root = Struct("Root", [("x", node), ("y", I64)])
    array = pa.array([{"x": value_of(node, rng), "y": i} for i in range(rng.randrange(6))], arrow_type(root))
    data = encode(root, array)
    assert decode(root, data).to_pylist() == array.to_pylist()
    assert decode(root, data, ["y"], strict=True).to_pylist() == [{"y": i} for i in range(len(array))]
    assert type(node).from_bytes(node.to_bytes()) == node
