from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np

from lamella.llm import quality, wordhash
from lamella.llm.quality import Network, keep_good, quality_scores
from lamella.llm.wordhash import span_hashes
from tests.llm.helpers import clashing, documents, odd_documents, words


def corpus(n: int = 300):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = words(rng, 60)
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    rows, labels = corpus()
    truth = {i: q for i, q, _ in labels}
    out = quality_scores(documents(spark, rows), labels_of(spark, labels)).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    test = [r for r in out if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    kept = {r.doc_id for r in keep_good(documents(spark, rows), labels_of(spark, labels)).collect()}
    assert kept == {r.doc_id for r in out if r.predicted}


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(120)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in quality_scores(documents(spark, rows), labels_of(spark, x)).collect()} for x in (labels, turned))
    assert a == b


def plain_tokens(text: str) -> list[int]:
    """Rows of the word table for runs of letters, digits and signs, one byte after another."""
    kind = lambda b: 0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or bytes([b]).isalpha() else 2 if 48 <= b <= 57 else 3
    out, run = [], b""
    for b in [*text.encode(), None]:
        if run and (b is None or kind(b) != kind(run[-1])):
            if kind(run[-1]):
                out.append(int(span_hashes(np.frombuffer(run, np.uint8), np.array([0]), np.array([len(run)]), fold=True)[0] % np.uint64(quality.WORD_ROWS)))
            run = b""
        if b is not None:
            run += bytes([b])
    return out


def test_word_vectors_and_pooling_equal_a_plain_version(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(30))) + rng.choice(["", " 42!", " Ünï?? 7x"]) for _ in range(25)] + ["", "one", "  "]
    tables = quality.word_tables(documents(spark, list(enumerate(texts))))
    places, signs = quality.index_vectors(quality.WORD_ROWS, quality.WORD_DIMS, 1)
    total = {}
    for tokens in map(plain_tokens, texts):
        for i, a in enumerate(tokens):
            for j in range(max(0, i - quality.WINDOW), min(len(tokens), i + quality.WINDOW + 1)):
                if i != j:
                    for k in range(quality.SIGNS):
                        total.setdefault(a, np.zeros(quality.WORD_DIMS))[places[tokens[j], k]] += signs[tokens[j], k]
    unit = {a: v / max(np.linalg.norm(v), 1e-9) for a, v in total.items()}
    assert all(np.allclose(tables[0][a], v, atol=1e-6) for a, v in unit.items())
    assert not tables[0][[a for a in range(0, quality.WORD_ROWS, 97) if a not in unit]].any()
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        got, tokens = quality.pooled(data, np.array([0, len(data)]), *tables)[0], plain_tokens(text)
        want = np.mean([unit.get(t, np.zeros(quality.WORD_DIMS)) for t in tokens], axis=0) if tokens else np.zeros(quality.WORD_DIMS)
        assert np.allclose(got[: quality.WORD_DIMS], want, atol=1e-5)
        assert np.isclose(got[-2], np.log1p(len(tokens))) and np.isclose(got[-1], len(set(tokens)) / len(tokens) if tokens else 0)


def test_scores_equal_the_network_by_hand():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    net = Network(x, (x[:, 1] > 0).astype(float), epochs=5)
    w1, b1, w2, b2 = net.p
    for row in x[:20]:
        z = (row - net.mean) / net.scale
        hidden = [max(0.0, sum(z[i] * w1[i, j] for i in range(6)) + b1[j]) for j in range(w1.shape[1])]
        logit = (sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / net.temperature
        assert np.isclose(net.scores(row[None])[0], 1 / (1 + np.exp(-logit)))


def test_odd_rows(spark):
    labels = labels_of(spark, [(1, 0, 0), (4, 1, 0), (5, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 0), (99, 0, 1)])
    out = quality_scores(odd_documents(spark), labels).collect()
    assert len(out) == 12 and all(r.score is not None for r in out)
    same = {r.score for r in out if r.doc_id in (7, 8)}
    assert len(same) == 1
    none = quality_scores(documents(spark, [(1, "a b")]), labels_of(spark, [])).collect()
    assert [tuple(r) for r in none] == [(1, False, 0.5, 1)]
    assert quality_scores(documents(spark, []), labels).collect() == []
    extra = clashing(documents(spark, [(1, "a b"), (2, None)]))
    assert quality_scores(extra, labels).count() == 2 and keep_good(extra, labels_of(spark, [])).columns == extra.columns


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    p = Network(x, y, epochs=30).scores(x)
    for low in (0.2, 0.5, 0.8):
        near = (p > low - 0.1) & (p < low + 0.1)
        assert abs(y[near].mean() - p[near].mean()) < 0.12


def test_memory_stays_small_beside_a_slice_of_text():
    rng = random.Random(5)
    texts = [" ".join(words(rng, 250)).encode() for _ in range(2100)]  # about 2 MB, as text_slices gives
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tables = np.ones((quality.WORD_ROWS, quality.WORD_DIMS), np.float32), np.ones((quality.SHAPE_ROWS, quality.SHAPE_DIMS), np.float32)
    powers = dict(wordhash._powers)
    wordhash._powers.update({k: np.ones(1, np.uint64) for k in powers})
    tracemalloc.start()
    try:
        quality.pooled(data, offsets, *tables)
        assert tracemalloc.get_traced_memory()[1] < 32 * len(data)
    finally:
        tracemalloc.stop()
        wordhash._powers.update(powers)


def test_runs_of_tokens_and_bytes_change_nothing():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 123, 3 * wordhash.ROUND_BYTES, dtype=np.uint8)
    cuts = np.sort(rng.choice(len(data), 5000, replace=False))
    cuts = np.concatenate([cuts[:2000], cuts[2000:][cuts[2000:] > cuts[1999] + wordhash.ROUND_BYTES + 9]])  # one span longer than a round
    got = span_hashes(data, cuts[:-1], cuts[1:])
    assert all(got[i] == span_hashes(data[a:b], np.array([0]), np.array([b - a]))[0] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    table = rng.normal(size=(50, 4)).astype(np.float32)
    count = np.array([3, 1, 2 * quality.GATHERED + 5, quality.GATHERED, 7, 3 * quality.GATHERED, 1])
    first = np.concatenate([[0], np.cumsum(count)])
    rows = rng.integers(0, 50, first[-1])
    sums = quality.vector_sums(table, rows, first)
    assert all(np.allclose(s, table[rows[a:b]].astype(np.float64).sum(0), rtol=1e-3, atol=0.5) for s, a, b in zip(sums, first, first[1:], strict=False))
    again = quality.vector_sums(table, np.concatenate([rows[:2], rows[first[2] : first[3]]]), np.array([0, 2, 2 + count[2]]))
    assert (again[1] == sums[2]).all()  # whatever lies beside a text
