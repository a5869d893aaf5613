from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lamella.llm import warc
from lamella.llm.training_order import Feistel, ShardReader, read_slots, write_shards
from tests.llm.helpers import clashing, documents, odd_documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, df, tmp_path, least=0):
    path = str(tmp_path / "w")
    warc.write_archives(df, path, least)
    return warc.read_archives(spark, path, payload=True).collect()


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://x/{i}", f"<html>{' '.join(words(rng, 50))}</html>") for i in range(100)]
    rows += [(200 + i, f"http://y/{i}", rows[i % 3][2]) for i in range(9)] + [(300, None, None), (301, "u", ""), (302, "a b\nc", "é" * 1000)]
    out = {r.page_id: r for r in round_trip(spark, pages(spark, rows), tmp_path)}
    assert len(out) == len(rows)
    heads = {}
    for i, _, html in rows:
        heads[html or ""] = max(heads.get(html or "", -1), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        first = heads[html or ""] == i
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else heads[html or ""])
        assert (bytes(r.payload) == raw) if first else r.payload is None
    assert out[302].url == "a%20b%0Ac"


def test_archive_layout(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}", " ".join(words(rng, 200))) for i in range(200)]
    path = str(tmp_path / "w")
    made = warc.write_archives(pages(spark, rows).coalesce(1), path).collect()
    assert sum(r.records for r in made) == 200
    raw = (tmp_path / "w" / made[0].archive).read_bytes()
    assert len(raw) == made[0].bytes and int.from_bytes(raw[:4], "little") == 0x184D2A5D
    found = list(warc.records(raw))
    at, body = found[len(found) // 2]
    assert next(warc.records(raw, at)) == (at, body)  # any record from its offset
    fields, block = warc.parse(body)
    assert fields["WARC-Type"] == "response" and block.endswith(dict((str(i), h) for i, _, h in rows)[fields["WARC-Page-ID"]].encode())


def test_archives_odd_rows(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, None, "same"), (None, "v", "alone"), (2, "w", "x" * 300_000), (3, "s", "xy")]
    out = round_trip(spark, clashing(pages(spark, rows)), tmp_path)
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in out)
    assert kinds == [("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("3", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.write_archives(pages(spark, []), str(tmp_path / "e")).collect() == []
    small = {r.page_id: r.record_type for r in round_trip(spark, pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc" * 9), (4, "u", "abc" * 9)]), tmp_path / "s", 10)}
    assert small == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        f = Feistel(n, 7)
        slots = f.slot(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (f.index(slots) == np.arange(n)).all()
    assert (Feistel(1000, 7).slot(np.arange(1000)) != Feistel(1000, 8).slot(np.arange(1000))).any()


def test_shards_round_trip(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(words(rng, rng.choice([1, 30, 200])))) for i in range(60)]
    path = str(tmp_path / "t")
    index = sorted(write_shards(documents(spark, texts), path, PATH, 64, shard_rows=16).collect(), key=lambda r: r.slot)
    assert [r.slot for r in index] == list(range(len(index)))
    reader = ShardReader(path)
    got = dict(reader.read())
    assert all(zlib.crc32(got[r.slot].astype("<u4").tobytes()) == r.ids_crc32 and len(got[r.slot]) == r.n_tokens for r in index)
    # in the order of sequences the streams of the tasks come back
    whole = np.concatenate([got[s] for s in reader.order.slot(np.arange(len(index)))])
    tokenizer = Tokenizer.from_file(PATH)
    docs = sorted(tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for _, t in texts)
    cuts = np.flatnonzero(whole == 0) + 1
    assert sorted(tuple(x.tolist()) for x in np.split(whole, cuts[:-1])) == docs
    # reading goes on anywhere
    assert [s for s, _ in reader.read(20, 5)] == [20, 21, 22, 23, 24]
    assert all((a[1] == b[1]).all() for a, b in zip(reader.read(37), list(reader.read())[37:], strict=True))
    back = sorted(read_slots(spark, path).collect(), key=lambda r: r.slot)
    assert [(r.slot, r.n_tokens, r.ids_crc32, r.sequence) for r in back] == [(r.slot, r.n_tokens, r.ids_crc32, r.sequence) for r in index]
    # each sequence names the documents it holds
    holds = {i: sum(i in r.doc_ids for r in index) for i, _ in texts}
    assert all(holds.values())


def test_shards_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    index = write_shards(clashing(docs), str(tmp_path / "o"), PATH, 128).collect()
    tokenizer = Tokenizer.from_file(PATH)
    assert sum(r.n_tokens for r in index) == sum(1 + len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert write_shards(documents(spark, []), str(tmp_path / "e"), PATH).collect() == []
    assert read_slots(spark, str(tmp_path / "e")).collect() == [] and len(ShardReader(str(tmp_path / "e"))) == 0
