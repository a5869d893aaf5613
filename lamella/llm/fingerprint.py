"""Document fingerprints from prefix polynomial hashes.

For a text of code points c the arrays H[i] = sum of (c[j] + 1) B**j over j < i, modulo two primes, give the
hash of any span in constant time, moved to position 0 by the inverse of B. Two spans are equal where
their hashes are, and the longest common extension of two positions is found by binary search. A
fingerprint holds the hash and length of the whole text, the hashes of its beginnings at fixed places, which tell by
binary search how far two texts begin alike, and the least hashes among its spans of two lengths,
from which the share of spans that two texts have in common is estimated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import only, parts, slices

_U = np.uint64
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_220_703_125)
#: Length of the spans in code points, how many least hashes are kept, and their hexadecimal digits.
LONG, LONG_KEPT, LONG_DIGITS = 24, 48, 8
SHORT, SHORT_KEPT, SHORT_DIGITS = 4, 24, 6
#: Where the shorter of two texts has fewer code points, the short spans tell their likeness.
SHORT_TEXT = 4 * LONG
#: The places of a fingerprint's beginnings grow by this factor; hexadecimal digits of each.
STEP, PLACE_DIGITS = 2 ** (1 / 6), 4


class Powers:
    """B**j and B**-j modulo a prime, as far as any text so far needed."""

    def __init__(self, prime: int, base: int):
        self.prime, self.base, self.up, self.down = prime, base, np.ones(1, _U), np.ones(1, _U)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k, p = len(self.up), _U(self.prime)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, self.prime)) % p])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.base, -k, self.prime)) % p])


def places(n: int) -> list[int]:
    """The lengths of the beginnings that a fingerprint of n code points holds: 1 and on, ever farther apart."""
    out, at = [], 1
    while at <= n:
        out.append(at)
        at = max(at + 1, int(at * STEP))
    return out


_POWERS = tuple(Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """The prefix arrays of one text. Spans are half-open and in code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.points = points
        for w in _POWERS:
            w.need(self.n + 1)

    def _array(self, k: int) -> np.ndarray:
        w = _POWERS[k]
        out = np.zeros(self.n + 1, _U)
        # below 2**52 each, and their reduced sum below 2**62
        np.cumsum((self.points.astype(_U) + _U(1)) * w.up[: self.n] % _U(w.prime), out=out[1:])
        out %= _U(w.prime)
        return out

    @cached_property
    def first(self) -> np.ndarray:
        return self._array(0)

    @cached_property
    def second(self) -> np.ndarray:
        return self._array(1)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The hash of the span from a to b."""
        return tuple(int((int(h[b]) - int(h[a])) * int(w.down[a]) % w.prime) for h, w in zip((self.first, self.second), _POWERS, strict=True))

    def equal(self, a: int, b: int, other: Prefixes, c: int, d: int) -> bool:
        """Whether the span from a to b is the other text's from c to d."""
        return b - a == d - c and self.span(a, b) == other.span(c, d)

    def extension(self, a: int, other: Prefixes, c: int) -> int:
        """How far the texts agree from a here and c there on."""
        low, high = 0, min(self.n - a, other.n - c)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(a, a + mid, other, c, c + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, size: int) -> np.ndarray:
        """Well-spread 64-bit hashes of all spans of this size (of the whole text, if it is shorter)."""
        from lamella.llm.wordhash import mix

        size = min(size, self.n)
        if not size:
            return np.zeros(0, _U)
        w, h, count = _POWERS[0], self.first, self.n - size + 1
        raw = (h[size : size + count] + _U(w.prime) - h[:count]) * w.down[:count]
        raw = (raw & _U(w.prime)) + (raw >> _U(31))  # the first prime is 2**31 - 1
        raw = (raw & _U(w.prime)) + (raw >> _U(31))
        return mix((raw % _U(w.prime)) * _U(64) + _U(size))

    def least(self, size: int, kept: int, digits: int) -> np.ndarray:
        """The `kept` least of the distinct span hashes, cut to so many hexadecimal digits."""
        got = self.spans(size) >> _U(64 - 4 * digits)
        take = 4 * kept
        while True:  # a few more than needed, as equal spans count once
            some = np.partition(got, take)[:take] if take < len(got) else got
            own = np.unique(some)
            if len(own) >= kept or take >= len(got):
                return own[:kept]
            take *= 4

    def fingerprint(self) -> str:
        """Whole-text hash, length, beginnings, least short spans and least long spans, parted by hyphens."""
        whole = self.span(0, self.n)
        short = "".join(f"{x:0{SHORT_DIGITS}x}" for x in self.least(SHORT, SHORT_KEPT, SHORT_DIGITS).tolist())
        long = "".join(f"{x:0{LONG_DIGITS}x}" for x in self.least(LONG, LONG_KEPT, LONG_DIGITS).tolist())
        begin = "".join(f"{x:0{PLACE_DIGITS}x}" for x in (self.first[places(self.n)] & _U((1 << 4 * PLACE_DIGITS) - 1)).tolist())
        return f"{whole[0]:08x}{whole[1]:08x}-{self.n:x}-{begin}-{short}-{long}"


def common_beginning(a: str, b: str, n: int) -> int:
    """The last of the places up to n where two fingerprints' beginnings agree, by binary search."""
    at = places(n)
    low, high = 0, len(at)
    while low < high:
        mid = (low + high + 1) // 2
        here = slice((mid - 1) * PLACE_DIGITS, mid * PLACE_DIGITS)
        low, high = (mid, high) if a[here] == b[here] else (low, mid - 1)
    return at[low - 1] if low else 0


def likeness(a: str, b: str) -> float:
    """How alike two fingerprinted texts are, 0 to 1: the larger of two shares of both texts, that of their common beginning
    and that of the spans they have in common, estimated. Two empty texts: 1."""
    if a == b:
        return 1.0
    (ha, na, pa_, sa, la), (hb, nb, pb, sb, lb) = a.split("-"), b.split("-")
    na, nb = int(na, 16), int(nb, 16)
    if ha == hb and na == nb:
        return 1.0
    if not na or not nb:
        return 0.0
    begin = 2 * common_beginning(pa_, pb, min(na, nb)) / (na + nb)
    x, y, kept, digits = (sa, sb, SHORT_KEPT, SHORT_DIGITS) if min(na, nb) < SHORT_TEXT else (la, lb, LONG_KEPT, LONG_DIGITS)
    one, two = ({v[i : i + digits] for i in range(0, len(v), digits)} for v in (x, y))
    least = sorted(one | two)[:kept]  # fixed width: text order is number order
    share = sum(v in one and v in two for v in least) / len(least)
    return max(begin, 2 * share / (1 + share))


def _ranges(docs: DataFrame, count: int) -> tuple[list[int], list[tuple[bool, int | None] | None]]:
    """Upper bounds of all ranges of doc_id but the last, and the first id of each range (None: no row), as (is null, id)."""
    cuts = []
    if count > 1:
        at = ", ".join(repr(i / count) for i in range(1, count))
        got = docs.agg(F.expr(f"percentile_approx(doc_id, array({at}), 10000)")).first()[0]
        cuts = sorted(set(got or []))
    first: list[tuple[bool, int | None] | None] = [None] * (len(cuts) + 1)
    for r in docs.select(_range_of(cuts).alias("r"), "doc_id").groupBy("r").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none")).collect():  # a row a range
        first[r["r"]] = (bool(r["none"]), None if r["none"] else r["low"])
    return cuts, first


def _range_of(cuts: list[int]):
    """The number of the range that doc_id falls in, by binary search; null ids are in the first."""
    if not cuts:
        return F.lit(0)
    array = "array(" + ", ".join(f"{c}L" for c in cuts) + ")"
    halve = f"(s, i) -> if(s.lo < s.hi, if({array}[(s.lo + s.hi) div 2] < doc_id, named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int))), s)"
    return F.expr(f"if(doc_id is null, 0, aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(cuts)}), {halve}).lo)")


_KIND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_edited, common_next.

    For every row of docs (doc_id, text). A null text is empty. The next row is the one that follows in ascending doc_id (null
    first, then by text among rows of one id), after the last the first; a lone row follows itself. The edited text has
    its last n_chars div 4 code points replaced by the first as many of the next text, or all if it has fewer.
    near_*: likeness of the fingerprints; common_*: how many code points the texts begin with alike, exactly up to hash
    collisions. Equal texts have equal fingerprints; the empty text has one too. Repeated rows are rows of their
    own. Other columns are not read. An empty table gives none.

    Rows are dealt to ranges of doc_id of about equal size and read in order there, one text at a time; the
    first row of each range goes to the range before as well. The driver holds two ids a range.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts, first = _ranges(docs, parts(spark))
    filled = [i for i, x in enumerate(first) if x]
    before = [0] * len(first)
    for at, r in enumerate(filled):
        before[r] = filled[at - 1]
    lows = "array(" + ", ".join("cast(null as bigint)" if not x or x[0] else f"{x[1]}L" for x in first) + ")"
    backs = "array(" + ", ".join(map(str, before)) + ")"
    own = "named_struct('r', r, 'ahead', 0)"
    leads = f"doc_id = {lows}[r] or doc_id is null and {lows}[r] is null"
    targets = f"if({leads}, array({own}, named_struct('r', {backs}[r], 'ahead', 1)), array({own}))"
    dealt = docs.withColumn("r", _range_of(cuts)).select("doc_id", "text", F.explode(F.expr(targets)).alias("t")).select("doc_id", "text", "t.r", "t.ahead")

    def finish(row: tuple[int | None, Prefixes, str], nxt: tuple[int | None, Prefixes, str]) -> tuple:
        import hashlib

        own, after = row[1], nxt[1]
        cut = own.n // 4
        edited_points = np.concatenate([own.points[: own.n - cut], after.points[:cut]])
        edited = Prefixes(edited_points)
        mark = edited.fingerprint()
        digest = hashlib.sha256(edited_points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
        return (row[0], own.n, digest, row[2], mark, likeness(row[2], mark), likeness(row[2], nxt[2]), own.extension(0, edited, 0), own.extension(0, after, 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = None, None, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in _KIND.split(", ")]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            for piece in slices(batch, "text"):
                for doc_id, text, r, ahead in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "text", "r", "ahead")), strict=True):
                    if at != r:
                        held, at = None, r
                    if ahead and held is None:
                        continue  # the range is done
                    own = Prefixes(code_points(text))
                    row = (doc_id, own, own.fingerprint())
                    if held is not None:
                        out.append(finish(held, row))
                    held = None if ahead else row
                if len(out) >= 2000:
                    yield flush()
                    out = []
        yield flush()

    return dealt.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("r", "ahead", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, _KIND)
