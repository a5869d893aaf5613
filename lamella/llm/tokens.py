"""Token ids of whole texts under a tokenizers vocabulary, each distinct word encoded once a worker.

The vocabulary's pre-tokenizer must drop white space and never join what white space parts (checked
when it is loaded). A text's ids are then those of its words in turn. Words are told apart by 64-bit
hashes of their bytes in array operations; only a word not met before goes to the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd

from lamella.llm.wordhash import separators, span_hashes, word_spans

#: White space on which every part of the tokenizer agrees.
GAPS = separators(b"\x20\x09\x0a\x0d")
#: Words that a worker keeps; beyond it starts afresh.
WORDS_KEPT = 2_000_000
_SIMPLE = re.compile(r"[^\W\d_]+|[0-9]|[!-&(-/:-@\[-`{-~]+")

_loaded: dict[str, WordTokens] = {}


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices begin[i], begin[i] + 1, ... of length[i] each, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return shift + np.arange(total)


class WordTokens:
    """Encoder with the words met so far: sorted hashes, and where each word's ids are."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        probe = ["ab cd", "ab\ncd", "ab\tcd", "ab \r\n cd"]
        alone = self.whole.encode("ab", add_special_tokens=False).ids + self.whole.encode("cd", add_special_tokens=False).ids
        if any(self.whole.encode(x, add_special_tokens=False).ids != alone for x in probe):
            raise ValueError(f"{path}: ids of words depend on the white space around them")
        vocabulary = self.whole.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the usual byte alphabet of byte-level vocabularies
        spare = iter(range(256, 512))
        self.letters = str.maketrans({chr(b): chr(b) if b in printable else chr(next(spare)) for b in range(256)})
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids, and how many each word has."""
        pieces, owner, rest = [], [], []
        for i, w in enumerate(words):
            low = w.lower()
            own = _SIMPLE.findall(low)
            # letters, ASCII digits and signs part in the same way in any engine; an apostrophe may open a contraction
            if len(low) == sum(map(len, own)) and (low.isascii() or all(x.isalpha() or x.isascii() for x in own)) and _plain(low):
                pieces += own
                owner += [i] * len(own)
            else:
                rest.append(i)
        counts = np.zeros(len(words), np.int64)
        flat, flat_owner = [], []
        if pieces:
            mapped = [x.encode().decode("latin-1").translate(self.letters) for x in pieces]
            got = self.model.encode_batch_fast([" ".join(mapped[i : i + 2000]) for i in range(0, len(mapped), 2000)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in got])
            of = np.concatenate([[0], np.cumsum(self.closing[ids])[:-1]])
            if self.closing[ids].sum() != len(pieces):
                raise ValueError("a piece of a word does not end where the vocabulary ends one")
            flat.append(ids)
            flat_owner.append(np.array(owner)[of])
        if rest:
            got = self.whole.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)
            flat.append(np.concatenate([np.array(x.ids, np.uint32) for x in got]))
            flat_owner.append(np.repeat(rest, [len(x.ids) for x in got]))
        if not flat:
            return np.zeros(0, np.uint32), counts
        ids, of = np.concatenate(flat), np.concatenate(flat_owner)
        by = np.argsort(of, kind="stable")
        counts += np.bincount(of, minlength=len(words))
        return ids[by], counts

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.hashes) + len(words) > WORDS_KEPT:
            self._forget()
        ids, counts = self._encode_words(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        begin = self.used + np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
        self.used += len(ids)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.length = np.insert(self.hashes, at, hashes), np.insert(self.begin, at, begin), np.insert(self.length, at, counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (and the end)."""
        starts, ends, first = word_spans(data, offsets, GAPS)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        which, unique = pd.factorize(span_hashes(data, starts, ends))
        sample = np.zeros(len(unique), np.int64)
        sample[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        by = np.argsort(unique)
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        unique, sample, which = unique[by], sample[by], place[which]
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            if len(self.hashes) + len(new) > WORDS_KEPT:
                self._forget()
                new = np.arange(len(unique))
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, unique)
        begin, length = self.begin[at][which], self.length[at][which]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[ragged(begin, length)], total[first]


def _plain(low: str) -> bool:
    """Whether the word holds only ASCII and simple Latin letters, and nothing that may be a special token."""
    return max(low) < "ɐ" and "<|" not in low


def word_tokens(path: str) -> WordTokens:
    """The worker's encoder for this vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def piece_bounds(counts: Iterable[int], most: int) -> list[tuple[int, int]]:
    """Begin and length of the pieces of most items that a run of each count is cut into."""
    return [(a, min(most, n - a)) for n in counts for a in range(0, n, most)]
