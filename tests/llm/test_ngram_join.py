from __future__ import annotations

import random

import numpy as np
import pytest

from lamella.llm import components as components_module
from lamella.llm import ngram_join
from lamella.llm.components import components
from lamella.llm.ngram_join import jaccard_groups, links_within
from lamella.llm.wordhash import gram_hashes, span_hashes, word_spans
from tests.llm.helpers import clashing, documents, odd_documents, shingles, words


def brute(rows: list[tuple]) -> dict:
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            shared = len(x & y)
            if x and y and 100 * shared >= 75 * (len(x) + len(y) - shared):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min([x for x in (least.get(find(k)), i) if x is not None], default=None)
    return {(i, len(s)): (least[find(k)] if s else i) for k, (i, s) in enumerate(sets)}


def corpus(rng: random.Random) -> list[tuple]:
    rows, i = [], 0
    passage = words(rng, 60)
    for _ in range(40):
        base = words(rng, rng.choice([3, 5, 8, 40, 120]))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 5))
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def result(df) -> dict:
    return {(r.doc_id, r.n_shingles): r.component_id for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    assert result(jaccard_groups(documents(spark, rows))) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 3, 7, 8])
def test_no_link_is_lost_at_any_number_of_blocks(spark, monkeypatch, partitions):
    """Pairs at the threshold: one shingle counted too few would part them."""
    rng = random.Random(partitions)
    rows = []
    for k in range(0, 400, 2):
        n = rng.choice([12, 24, 40, 64, 100])
        line = [f"{w}{k}x{i}" for i, w in enumerate(words(rng, n))]
        other = list(line)
        for at in [1, n - 2][: 1 + (n > 40)]:
            other[at] = f"other{k}"
        rows += [(k, " ".join(line)), (k + 1, " ".join(other))]
    want = brute(rows)
    assert 0 < sum(i != c for (i, _), c in want.items()) < 200
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 1000 if partitions == 7 else 1_000_000)
    try:
        assert result(jaccard_groups(documents(spark, rows, 5))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_steps_between_rows_and_sizes(spark, monkeypatch):
    """Blocks with few postings of many rows, and sizes beyond what their code holds exactly."""
    n = np.unique(np.concatenate([np.arange(1, 5000), 2 ** np.arange(1, 40), 2 ** np.arange(1, 40) - 1, 3**20 + np.arange(9)]))
    n = n[n < 2**41]
    least = ngram_join.least_sizes(ngram_join.size_codes(n))
    assert (least <= n).all() and (n <= least + least // 1024).all()
    monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", 4)
    rng = random.Random(9)
    rows = [(k, " ".join(words(rng, 6))) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " " + rows[k][1]) for k in range(3)]
    rows += [(7000 + k, rows[k][1]) for k in (3, 500, 1000)]
    base = words(rng, 3000)
    rows += [(9000, " ".join(base)), (9001, " ".join(base[:2600])), (9002, " ".join(base[:1200]))]
    assert result(jaccard_groups(documents(spark, rows, 2))) == brute(rows)


def test_refined_order_of_crowded_shingles(spark, monkeypatch):
    """Passages that many share, which the counting table takes for rare ones, and null ids."""
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", 4)
    monkeypatch.setattr(ngram_join, "CROWDED_SHARE", 0.0)
    monkeypatch.setattr(ngram_join, "frequent", lambda docs, size: np.zeros(ngram_join.CELLS // 8, np.uint8))
    orders, sketch = [], ngram_join.sketch
    monkeypatch.setattr(ngram_join, "sketch", lambda *a: (orders.append(a[-1]), sketch(*a))[1])
    rng = random.Random(8)
    passages = [words(rng, 25) for _ in range(3)]
    rows = [(k, " ".join(words(rng, 40) + passages[k % 3] + words(rng, 30))) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " " + words(rng, 1)[0]) for k in range(0, 60, 4)]
    rows += [(None, rows[1][1] + " end"), (None, rows[1][1] + " end"), (None, "only here " + passages[0][0]), (200, "Only here " + passages[0][0] + " ")]
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(documents(spark, rows)).collect()]
    want = brute(rows)
    assert len(orders) > 1 and len(out) == len(rows)
    assert all(want[i, n] == c for i, n, c in out if i is not None)
    assert sorted(c for i, _, c in out if i is None) == [1, 1, 200]


@pytest.mark.parametrize("pivots", [0, 4])
def test_many_near_copies_and_small_blocks(spark, monkeypatch, pivots):
    """A group larger than the limits of pairs and of blocks: ties and pairs of blocks must find it all."""
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", 4)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 16)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    rng = random.Random(5)
    base = words(rng, 100)
    rows = [(1000 + k, " ".join(base[:k] + words(rng, 2) + base[k + 2 :])) for k in range(0, 90)]
    rows += [(k, " ".join(words(rng, 50))) for k in range(20)] + [(500, " ".join(base)), (501, " ".join(base))]
    assert result(jaccard_groups(documents(spark, rows))) == brute(rows)


def test_a_chain_across_blocks(spark, monkeypatch):
    """Each text links with the next few only, and all are one group: it takes the meeting of outer rows with all blocks."""
    monkeypatch.setattr(ngram_join, "PAIRS_UP_TO", 3)
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 8)
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    line = words(random.Random(6), 500)
    rows = [(k, " ".join(line[5 * k : 5 * k + 60])) for k in range(80)]
    assert result(jaccard_groups(documents(spark, rows))) == brute(rows) and len(set(brute(rows).values())) == 1


def test_odd_rows(spark):
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(odd_documents(spark)).collect()), key=str)
    by = {}
    for i, n, c in out:
        by.setdefault(i, []).append((n, c))
    assert by[1] == by[2] == [(0, 1)] or by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[7] == [(2, 7), (2, 7)] and by[8] == [(2, 7)] and by[6][0][1] == 5 and by[4] == [(1, 4)]
    assert by[None] == [(2, None)]
    assert len(out) == 12


def test_empty_and_extra_columns(spark):
    assert jaccard_groups(documents(spark, [])).collect() == []
    docs = documents(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (3, "q r s t u v")])
    assert result(jaccard_groups(clashing(docs))) == {(1, 2): 1, (2, 2): 1, (3, 2): 3}


def test_links_within_blocks():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**62, 200).astype(np.uint64))
    sets = [np.sort(np.concatenate([base[k : k + 180], rng.integers(0, 2**62, 5).astype(np.uint64)])) for k in range(0, 20, 4)]
    a, b = links_within(np.arange(5), sets, 75)
    assert len(a) == 4
    a, b = links_within(np.arange(5), sets, 75, np.array([0, 0, 0, 1, 1]))
    assert len(a) and all((x < 3) != (y < 3) for x, y in zip(a, b, strict=True))
    # what is connected already costs no link
    a, b = links_within(np.arange(5), sets, 75, np.array([0, 0, 0, 1, 1]), np.array([7, 7, 7, 8, 8]))
    assert len(a) == 1
    assert len(links_within(np.arange(5), sets, 75, np.array([0, 0, 0, 1, 1]), np.array([7] * 5))[0]) == 0


@pytest.mark.parametrize("local", [0, 5, 1 << 18])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components_module, "LOCAL_EDGES", local)
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (None, 4), (30, 10), (30, 11), (30, 12), (12, 13)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 10, 11: 10, 12: 10, 13: 10, 30: 10}
    chain = [(i, i + 1) for i in range(200)]
    assert {r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes():
    texts = ["Ab ab\tAB", "", "one two three four five six", "  x  "]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends, first = word_spans(data, offsets)
    assert np.diff(first).tolist() == [3, 0, 6, 1]
    folded = span_hashes(data, starts, ends, fold=True)
    assert folded[0] == folded[1] == folded[2] and len(set(span_hashes(data, starts, ends)[:3].tolist())) == 3
    grams, bounds = gram_hashes(folded, first, 5)
    assert np.diff(bounds).tolist() == [1, 0, 2, 1] and len(set(grams.tolist())) == 4
