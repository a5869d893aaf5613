from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamella.llm.packing import pack, vector_best_fit
from lamella.llm.tokens import WordTokens, word_tokens
from lamella.llm.common import text_parts
from tests.llm.helpers import clashing, documents, odd_documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, most):
    """Every piece is there with its ids' checksum, and sequences are gapless and within their capacity."""
    tokenizer = Tokenizer.from_file(PATH)
    expected = defaultdict(int)
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), most):
            expected[doc_id, k // most, k, len(ids[k : k + most]), zlib.crc32(ids[k : k + most].tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == expected
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences)


def test_pieces_and_sequences(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(words(rng, rng.choice([1, 5, 40, 300])))) for i in range(120)]
    rows = pack(documents(spark, texts), PATH, 128).collect()
    used = check(rows, texts, 128)
    least = max(sum(r.length for r in rows) / 128, sum(r.length > 64 for r in rows))
    assert used <= 1.03 * least + 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(pack(docs, PATH, 512).collect(), [(r.doc_id, r.text) for r in docs.collect()], 512)
    assert pack(documents(spark, []), PATH).collect() == []
    assert len(pack(clashing(documents(spark, [(1, "a b")])), PATH).collect()) == 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities_hold(rule):
    rng = np.random.default_rng(3)
    length = rng.integers(1, 101, 400)
    where, offset = vector_best_fit(length, 100, 3, 6000 + 4000, rule, (1.0, 0.2, 0.2))
    for s in np.unique(where):
        mine = length[where == s]
        assert mine.sum() <= 100 and len(mine) <= 3 and (mine**2).sum() <= 10_000
        assert sorted(offset[where == s]) == sorted(np.cumsum(np.sort(mine)[::-1]) - np.sort(mine)[::-1])
    with pytest.raises(ValueError):
        vector_best_fit(np.array([101]), 100, 3, 10_000)


def test_with_ids(spark):
    row = pack(documents(spark, [(1, "hello there")]), PATH, 64, with_ids=True).collect()[0]
    ids = np.frombuffer(bytes(row.ids), "<u4")
    assert ids.tolist() == [*Tokenizer.from_file(PATH).encode("hello there", add_special_tokens=False).ids, 0]


def test_words_apart_equal_the_whole():
    import pyarrow as pa

    odd = ["", " ", "İstanbul ŉ x'll don't ered***", "é 가 ﬁ ½ ²x 中文 a_b A1b22 <|endoftext|> x", "\xa0a\u2003b\x0bc\x1cd", "it's'S 'Ve", "ǅ ẞ ΑΣ Σ", "«a»b … ’s", "a\r\nb\tc", "0x1F-22.5", "e\u0301 E\u0301"]
    w = WordTokens(PATH)
    for _ in range(2):  # words met, and words known
        ids, bounds = w.encode(*text_parts(pa.array([*odd, None])))
        for text, a, b in zip(odd, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == w.whole.encode(text, add_special_tokens=False).ids, text
    with pytest.raises(ValueError):
        word_tokens(public_tokenizers.path("byte_bpe_50k.json"))
