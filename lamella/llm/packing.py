"""Best-fit packing of documents into sequences, under token, document-count and attention-cost capacities.

Documents are tokenised where they lie and cut into pieces; only the pieces' sizes move. They are dealt
into groups of about GROUP_PIECES by a number drawn from task and position, so that no key decides
where a row goes, and each group is packed by itself: pieces in falling order of length, each into
the open sequence that the rule prefers among those that hold it under every capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import grouped, materialise, only, parts, text_slices
from lamella.llm.tokens import piece_bounds, word_tokens

#: Pieces that one group holds, about. A group's last sequences may stay part empty, so larger groups pack tighter.
GROUP_PIECES = 16_384


def vector_best_fit(length: np.ndarray, tokens: int, documents: int, cost: int, rule: str = "norm", weights: Sequence[float] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece, and its offset there.

    A piece takes length tokens, one document and length**2 of attention cost. rule "norm": the sequence
    left with the least weighted norm of its residual capacities; "dot": the largest weighted
    product of the piece's demands and the residual capacities. Ties go to the sequence opened first.
    """
    caps = np.array([tokens, documents, cost], np.float64)
    demand = np.column_stack([length, np.ones(len(length)), length.astype(np.float64) ** 2])
    if (demand > caps).any():
        raise ValueError("a piece is larger than a sequence")
    weight = np.asarray(weights, np.float64)
    where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    left = np.zeros((3, max(len(length), 1)))  # residual capacities of the open sequences
    ids = np.zeros(max(len(length), 1), np.int64)
    n_open = opened = 0
    order = np.argsort(-length, kind="stable")
    least = int(length.min()) if len(length) else 0
    for i in order:
        want = demand[i]
        now = left[:, :n_open]
        fits = np.flatnonzero((now[0] >= want[0]) & (now[1] >= 1) & (now[2] >= want[2]))
        if len(fits):
            rest = now[:, fits]
            if rule == "norm":
                rest = (rest - want[:, None]) / caps[:, None]
                best = fits[np.argmin(weight @ (rest * rest))]
            else:
                best = fits[np.argmax((weight * want / caps) @ (rest / caps[:, None]))]
        else:
            best = n_open
            left[:, best], ids[best] = caps, opened
            n_open, opened = n_open + 1, opened + 1
        where[i], offset[i] = ids[best], tokens - left[0, best]
        left[:, best] -= want
        if left[0, best] < least or left[1, best] < 1:  # nothing more fits
            left[:, best : n_open - 1] = left[:, best + 1 : n_open]
            ids[best : n_open - 1] = ids[best + 1 : n_open]
            n_open -= 1
    return where, offset


def token_pieces(docs: DataFrame, vocabulary: str, most: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal (and ids, unsigned 32-bit little-endian): the pieces of each text's ids with 0 after them."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long" + ", ids binary" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        rng = np.random.default_rng([TaskContext.get().partitionId(), 6])
        for piece, data, offsets in text_slices(batches):
            ids, bounds = tokens.encode(data, offsets)
            counts = np.diff(bounds) + 1
            full = np.zeros(len(ids) + len(counts), np.uint32)
            keep = np.ones(len(full), bool)
            ends = np.cumsum(counts)
            keep[ends - 1] = False
            full[keep] = ids
            begin = ends - counts
            cuts = [piece_bounds([n], most) for n in counts.tolist()]
            reps = np.fromiter(map(len, cuts), np.int64, len(cuts))
            start = np.fromiter((a for c in cuts for a, _ in c), np.int64)
            length = np.fromiter((n for c in cuts for _, n in c), np.int64)
            number = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            at = np.repeat(begin, reps) + start
            raw = memoryview(full.astype("<u4").tobytes())
            blobs = [raw[4 * a : 4 * (a + n)] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [piece.column("doc_id").take(pa.array(np.repeat(np.arange(len(cuts)), reps))), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(rng.integers(0, 1 << 62, len(start)))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(b) for b in blobs], pa.binary())] * with_ids, [x.split()[0] for x in kind.split(", ")])

    docs = only(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def pack(docs: DataFrame, vocabulary: str, tokens: int = 2048, documents: int | None = None, cost: int | None = None, rule: str = "norm", weights: Sequence[float] = (1.0, 0.01, 0.01), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every row of docs (doc_id, text), packed.

    A text is its ids under the vocabulary and a 0 (a null or empty text: the 0 alone). Texts longer than a
    sequence are cut into pieces of `tokens` ids, the last one shorter; no other is cut. documents and cost
    bound what one sequence holds besides (None: no bound beyond what the tokens imply). Repeated
    rows are pieces of their own; a null doc_id stays null. Extra columns are not read. An empty
    table gives no row. Which sequence a piece joins depends on how the rows lie in partitions.
    """
    documents, cost = documents or tokens, cost or tokens * tokens
    pieces = materialise(token_pieces(docs, vocabulary, tokens, with_ids), "pieces")
    groups = max(1, round(pieces.count() / GROUP_PIECES))
    names = [x for x in pieces.columns if x != "deal"]

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part"]):
            where, offset = vector_best_fit(group["length"].to_numpy(), tokens, documents, cost, rule, weights)
            where += int(group["part"][0].as_py()) << 32
            group = group.select(names).append_column("sequence_id", pa.array(where)).append_column("offset", pa.array(offset))
            yield from group.combine_chunks().to_batches()

    kind = ", ".join(f"{x} {t}" for x, t in pieces.dtypes if x != "deal") + ", sequence_id long, offset long"
    dealt = pieces.withColumn("part", F.pmod("deal", F.lit(groups))).drop("deal")
    return dealt.repartition(min(parts(docs.sparkSession), groups), "part").sortWithinPartitions("part", "length", "doc_id", "piece").mapInArrow(fit, kind)
