from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lamella.llm import multi_index
from lamella.llm.fingerprint import Prefixes, code_points, fingerprints, likeness
from tests.llm.helpers import clashing, documents, odd_documents, words


def test_prefix_hashes_answer_spans():
    rng = random.Random(1)
    a = "".join(rng.choice("abé🦀") for _ in range(400))
    b = a[:150] + "X" + a[151:]
    p, q = Prefixes(code_points(a)), Prefixes(code_points(b))
    for _ in range(300):
        i, j = sorted(rng.sample(range(401), 2))
        k = rng.randrange(401 - (j - i))
        assert p.equal(i, j, q, k, k + j - i) == (a[i:j] == b[k : k + j - i])
    assert p.extension(0, q, 0) == 150 and p.extension(151, q, 151) == 249 and p.extension(150, q, 150) == 0


def by_hand(rows):
    rows = sorted([(i, t or "") for i, t, *_ in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        same = next((j for j, (x, y) in enumerate(zip(t, after, strict=False)) if x != y), min(len(t), len(after)))
        out.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest(), same))
    return out


def result(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.common_next) for r in df.collect()]


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_next_and_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6) * 2 + i % 2, " ".join(words(rng, rng.choice([0, 1, 40, 200])))) for i in range(n)]
    assert sorted(result(fingerprints(documents(spark, rows))), key=str) == sorted(by_hand(rows), key=str)


def test_likeness_tells_edits_from_strangers(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.choice([60, 600])))) for i in range(80)]
    out = fingerprints(documents(spark, rows)).collect()
    assert min(r.near_edited for r in out) > 0.5 and max(r.near_next for r in out) < 0.2
    loop = "abc def ghi " * 400
    a, b = (Prefixes(code_points(t)).fingerprint() for t in (loop, loop[:3600] + "".join(words(rng, 200))))
    assert likeness(a, b) > 0.5 and likeness(a, a) == 1.0


def test_fingerprint_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = fingerprints(clashing(docs))
    assert sorted(result(out), key=str) == sorted(by_hand(rows), key=str)
    prints = {}
    for r in out.collect():
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert len(prints) == 12 - 1 - 2  # null and empty are equal, and three rows have one text
    assert fingerprints(documents(spark, [])).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, least=0.9):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    root = np.arange(len(rows))
    while True:
        new = np.array([min(root[i], *root[hit[i]]) if hit[i].any() else root[i] for i in range(len(rows))])
        if (new == root).all():
            break
        root = new
    return {rows[i][0]: (int(hit[i].sum()), rows[root[i]][0]) for i in range(len(rows))}


def clusters(seed: int, n: int = 150):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.normal(size=(n, 16)):
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append((len(rows), np.float32(c + rng.normal(size=16) * 0.05).tolist(), 0))
    return rows


def test_index_finds_links(spark):
    rows = clusters(1)
    truth = brute(rows)
    out = {r.vec_id: r for r in multi_index.near_duplicates(vectors(spark, rows).repartition(4)).collect()}
    assert sum(r.n_links for r in out.values()) >= 0.9 * sum(n for n, _ in truth.values())
    assert all(out[i].n_links <= truth[i][0] for i in truth)
    assert np.mean([out[i].component_id == truth[i][1] for i in truth]) > 0.95
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.values())


def far_pairs(copies: int, pairs: int = 60, n: int = 2000, dims: int = 32):
    """Vectors drawn evenly, pairs just over cosine 0.9 among them, and copies of one vector."""
    rng = np.random.default_rng(5)
    x = multi_index.unit(rng.normal(size=(n, dims)))
    near = multi_index.drawn_neighbours(x[:pairs], 0.901, 1)[1]
    return [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, near, np.repeat(x[-1:], copies, 0)]))]


@pytest.mark.parametrize("copies", [0, 1000])
def test_index_visits_are_measured_whatever_the_links(spark, monkeypatch, copies):
    monkeypatch.setattr(multi_index, "PER_CELL", 8)
    rows = far_pairs(copies)
    truth = brute(rows)
    out = {r.vec_id: r for r in multi_index.near_duplicates(vectors(spark, rows)).collect()}
    linked = [i for i in range(60)]
    assert all(truth[i][0] == 1 for i in linked)
    assert np.mean([out[i].n_links == 1 for i in linked]) >= 0.95
    assert all(out[i].n_links <= truth[i][0] for i in truth)


def test_index_visits_without_links_are_measured(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "PER_CELL", 8)
    live, kind = multi_index.prepared(vectors(spark, far_pairs(0, 0)))
    grid = multi_index.fitted(live, 2000, 32, kind)
    visits, share = multi_index.visits_needed(live, grid, 32, kind, 0.9, 0.99)
    x = multi_index.unit(np.random.default_rng(6).normal(size=(500, 32)))
    near, far = multi_index.drawn_neighbours(x, 0.9, 2)
    met = np.minimum(grid.place(near, grid.cells(far, 1)[:, 0]), grid.place(far, grid.cells(near, 1)[:, 0])) < visits
    assert visits > 4 and met.mean() > 0.96 and share >= 0.99


def test_index_blocks_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 1)
    monkeypatch.setattr(multi_index, "TILE", (5, 3))
    rng = np.random.default_rng(2)
    c = rng.normal(size=16)
    rows = [(i, np.float32(c + rng.normal(size=16) * 0.02).tolist(), 0) for i in range(200)] + [(1000 + i, np.float32(v).tolist(), 0) for i, v in enumerate(rng.normal(size=(300, 16)))]
    monkeypatch.setattr(multi_index, "PER_CELL", 16)
    truth = brute(rows)
    out = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(vectors(spark, rows), target=1.0).collect()}
    assert out == truth


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(40)]
    rows += [(100 + i, v, 0) for i, v in enumerate([[1.0, 2.0], [2.0, 4.0], [0.0, 1.0], [1.0, 2.0, 0.0], [1.0, 2.0, 0.1], [5.0]])]
    rows += [(200 + i, (np.array(rows[i][1]) * 3).tolist(), 0) for i in range(0, 40, 10)]
    report = []
    out = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_duplicates(vectors(spark, rows), report=report).collect()}
    want = {}
    for length in {len(v) for _, v, _ in rows}:
        want |= brute([r for r in rows if len(r[1]) == length])
    assert out == want and out[100] == (1, 100) and out[101] == (1, 100) and out[104] == (1, 103) and out[105] == (0, 105)
    assert [(d, n) for d, n, *_ in report] == [(2, 3), (3, 2), (4, 44)] and all(v >= 1 and 0.9 <= s <= 1 for *_, v, s in report)


def test_index_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [0.0, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [0.0, 3.0], 0)]
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(clashing(vectors(spark, rows))).collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10)]
    assert out == sorted([*alone, (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 1, 9, True), (None, 1, 9, False)], key=str)
    assert multi_index.near_duplicates(vectors(spark, [])).collect() == []
    assert [tuple(r) for r in multi_index.near_duplicates(vectors(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]


def test_grid_order():
    rng = np.random.default_rng(3)
    grid = multi_index.Grid(rng.normal(size=(5, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    one, two = grid.distances(x)
    total = (one[:, :, None] + two[:, None, :]).reshape(20, -1)
    for most in (1, 4, 25):
        assert (grid.cells(x, most) == total.argsort(1)[:, :most]).all()
    assert (grid.place(x, grid.cells(x, 9)[:, 8]) == 8).all()
