from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm.common import materialise, read_table, without
from tests.llm.helpers import SF, clashing, documents, shingles, words
from tests.llm.test_packing import check


def write_tables(tmp_path, spark, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_on_planted_rows(spark, tmp_path):
    rng = random.Random(11)
    rows, labels, junk = [], [], set()
    for i in range(200):
        w, good = words(rng, 80), rng.random() < 0.75
        rows.append([i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w), "en", f"src{i % 3}", 0])
        labels.append((i, int(good), 0))
        if not good:
            junk.add(i)
    good_ids = [r[0] for r in rows if r[0] not in junk]
    copy_of, near_of, secret = good_ids[0], good_ids[1], good_ids[2]
    rows.append([900, rows[copy_of][1], "en", "src1", 0])
    near = rows[near_of][1].split()
    near[40] = "changed"
    rows.append([901, " ".join(near), "en", "src1", 0])
    hexadecimal = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows[secret][1] += f' token = "{hexadecimal}"'
    rows += [[950, None, None, None, None], [951, "", "en", "src0", 0]]
    rows = [tuple([*r[:4], None if r[1] is None else len(r[1])]) for r in rows]
    sf = write_tables(tmp_path, spark, rows, labels)

    docs, seen, tables = read_table(spark, sf, "documents"), [], []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "stage")
        tables.append(docs.collect())
        seen.append({r.doc_id: r for r in tables[-1]})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, near_dup, clean, mixed, packed = seen
    assert not junk & set(quality) and set(good_ids) <= set(quality) and {900, 901} <= set(quality)
    assert set(quality) - set(near_dup) == {900, 901}
    kept = [shingles(r.text) for r in near_dup.values()]
    for a in range(len(kept)):
        for b in range(a):
            shared = len(kept[a] & kept[b])
            assert not kept[a] or not kept[b] or 100 * shared < 75 * (len(kept[a]) + len(kept[b]) - shared)
    assert hexadecimal not in clean[secret].text and "[SECRET]" in clean[secret].text and clean[secret].n_chars == len(clean[secret].text)
    assert all(clean[i].text == near_dup[i].text for i in near_dup if i != secret)
    rows = list(clean.values())
    assert sorted(r.doc_id for r in tables[3]) == sorted(plain_copies(rows))
    assert set(mixed) <= set(clean) and set(packed) == set(mixed)
    check(tables[4], [(r.doc_id, r.text) for r in tables[3]], 2048)


def plain_copies(rows) -> list:
    """Each row's doc_id as often as its Poisson draw says."""
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text or "")
    weight = {s: n**0.5 for s, n in chars.items() if n}
    whole, out = sum(chars.values()), []
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for r in rows:
        rate = round(weight.get(r.source, 0) / sum(weight.values()) * whole / chars[r.source], 9) if chars[r.source] else 0.0
        name, parts, copies = md5(f"{'null' if r.doc_id is None else r.doc_id}:{md5(r.text or '')}"), max(1, math.ceil(rate / 32)), 0
        for part in range(1, parts + 1):
            u, mean, k = int(md5(f"5:{name}:{part}")[:13], 16) / 2**52, rate / parts, 0
            p = total = math.exp(-mean)
            while total <= u and k < int(20 + 8 * mean):
                k += 1
                p *= mean / k
                total += p
            copies += k
        out += [r.doc_id] * copies
    return out


def test_run_on_empty_tables_repeated_rows_and_more_columns(spark, tmp_path):
    empty = write_tables(tmp_path / "empty", spark, [], [])
    assert corpus_pipeline.run(spark, empty).collect() == []
    rng = random.Random(13)
    text = " ".join(words(rng, 50))
    rows = [(1, text, "en", "a", len(text))] * 3 + [(2, "other words", "en", "a", 11), (None, None, None, None, None)]
    sf = write_tables(tmp_path / "odd", spark, rows, [(1, 1, 0), (1, 1, 0), (2, 1, 0), (None, 0, 0)])
    docs = clashing(read_table(spark, sf, "documents"))
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "stage")
        if name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) == [1, 2]
    assert {r.doc_id for r in docs.collect()} <= {1, 2}


def test_rows_of_one_id_keep_their_unlike_texts(spark):
    rng = random.Random(12)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(5, b), (5, a), (1, a), (7, c), (7, d), (7, c), (7, d + " end"), (None, a), (None, e), (None, e), (8, ""), (9, None)]
    out = corpus_pipeline.near_duplicates(spark, documents(spark, [(i, x) for i, x in rows]), "").collect()
    assert sorted(((r.doc_id, r.text) for r in out if (r.text or "")[:40] != d[:40]), key=str) == sorted([(1, a), (5, b), (7, c), (None, e), (8, ""), (9, None)], key=str)
    assert [r.doc_id for r in out if (r.text or "")[:40] == d[:40]] == [7]


def test_rows_without_others(spark):
    rows = spark.createDataFrame([(i % 50 if i else None, str(i)) for i in range(100)], "k long, v string")
    gone = spark.createDataFrame([(3,), (3,), (7,), (None,), (99,)], "k long")
    for bits in (1 << 15, 1 << 26):
        got = sorted(((r.k, r.v) for r in without(rows, gone, "k", bits).collect()), key=str)
        assert got == sorted(((r.k, r.v) for r in rows.collect() if r.k not in (3, 7)), key=str)


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows
    texts = dict(zip(*(pq.read_table(f"{SF}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")), strict=True))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    one = next(r for r in rows if r.piece == 0 and "token" not in texts[r.doc_id])
    assert one.length == min(2048, 1 + len(tokenizer.encode(texts[one.doc_id], add_special_tokens=False).ids))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
