"""Quality classifier: random-indexing vectors pooled per document, and a small network with calibrated probabilities.

Every token has a fixed sparse index vector of +1 and -1, drawn from its hash. A token's vector is the sum
of its neighbours' index vectors over the whole corpus (WINDOW on either side), in a table of fixed
size whose rows tokens share by hash; the tokens' shapes (case, length, the sign itself) have a
table of their own, so that words met once count too. A document is the mean of its tokens' unit vectors,
and a two-layer network over it is trained on a bounded sample of labelled rows; its
logits are divided by the temperature that fits rows kept out of the training best.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import binary_array, numbered, only, place, summed_array, text_slices
from lamella.llm.wordhash import mix, span_hashes

#: Rows and width of the tables for words and for shapes; window of neighbours; signs in an index vector.
WORD_ROWS, WORD_DIMS, SHAPE_ROWS, SHAPE_DIMS, WINDOW, SIGNS = 1 << 15, 64, 256, 32, 2, 2
FEATURES = WORD_DIMS + SHAPE_DIMS + 2
#: Labelled rows that the network is trained on, about (all, if there are fewer), and the hidden layer.
TRAIN_ROWS, HIDDEN = 20_000, 32
#: Tokens whose vectors are gathered at a time; a longer text's are added up in such runs.
GATHERED = 1 << 16

_CLASS = np.full(256, 3, np.uint8)  # signs
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_UPPER = np.zeros(256, np.int32)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LOWER = np.zeros(256, np.int32)
_LOWER[ord("a") : ord("z") + 1] = 1


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each token in the word table, in the shape table, and where each text's tokens begin. A token is a run of letters, digits or signs."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    begin = np.ones(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    words = (span_hashes(data, starts, ends, fold=True) % np.uint64(WORD_ROWS)).astype(np.int64)

    def within(table: np.ndarray) -> np.ndarray:
        before = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=before[1:])
        return before[ends] - before[starts]

    many, few = within(_UPPER), within(_LOWER)
    case = np.where(few > 0, np.where(_UPPER[data[starts]] > 0, 1, np.where(many > 0, 2, 0)), np.where(many > 0, 3, 4))
    length = np.minimum(np.log2(ends - starts).astype(np.int64), 5)
    sort = kind[starts].astype(np.int64)
    shape = np.where(sort == 3, 64 + data[starts] % 128 + 64 * (length > 0), sort * 30 + case * 6 + length)
    return words, np.minimum(shape, SHAPE_ROWS - 1), np.searchsorted(starts, offsets)


def index_vectors(rows: int, dims: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    h = mix(np.arange(rows * SIGNS, dtype=np.uint64) + np.uint64(salt << 32)).reshape(rows, SIGNS)
    return (h % np.uint64(dims)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1)


def add_contexts(total: np.ndarray, tokens: np.ndarray, text: np.ndarray, dims: int, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to each token's row the index vectors of its neighbours in the same text. total is flat."""
    places, signs = index
    for d in range(1, WINDOW + 1):
        near = text[d:] == text[:-d]
        left, right = tokens[:-d][near], tokens[d:][near]
        for a, b in ((left, right), (right, left)):
            for k in range(SIGNS):
                at, sign = a * dims + places[b, k], signs[b, k] > 0
                total += np.bincount(at[sign], minlength=len(total))
                total -= np.bincount(at[~sign], minlength=len(total))


def word_tables(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of both tables, from all texts."""
    split = WORD_ROWS * WORD_DIMS

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        flat = np.zeros(split + SHAPE_ROWS * SHAPE_DIMS, np.int64)
        words, shapes = flat[:split], flat[split:]
        of_words, of_shapes = index_vectors(WORD_ROWS, WORD_DIMS, 1), index_vectors(SHAPE_ROWS, SHAPE_DIMS, 2)
        for _, data, offsets in text_slices(batches):
            w, s, first = tokens_of(data, offsets)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            add_contexts(words, w, text, WORD_DIMS, of_words)
            add_contexts(shapes, s, text, SHAPE_DIMS, of_shapes)
        return flat

    flat = summed_array(docs.select("text"), count, split + SHAPE_ROWS * SHAPE_DIMS)

    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    return unit(flat[:split].reshape(WORD_ROWS, WORD_DIMS).astype(np.float64)), unit(flat[split:].reshape(SHAPE_ROWS, SHAPE_DIMS).astype(np.float64))


def vector_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's rows of the table. first: where each text's begin, and the end; no text is without.

    Runs are cut from each text's own beginning, so equal texts have equal sums, whatever lies beside them."""
    count = np.diff(first)
    runs_of = -(-count // GATHERED)
    text = np.repeat(np.arange(len(count)), runs_of)
    begin = first[text] + GATHERED * (np.arange(len(text)) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of))
    end = np.append(begin[1:], first[-1])
    out = np.zeros((len(count), table.shape[1]), table.dtype)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + GATHERED, "right")))  # a full run is alone, so no text is here twice
        got = table[rows[begin[at] : end[to - 1]]]
        got[0] += out[text[at]]
        out[text[at:to]] = np.add.reduceat(got, begin[at:to] - begin[at], axis=0)
        at = to
    return out


def pooled(data: np.ndarray, offsets: np.ndarray, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The features of each text: mean word and shape vectors, log of the token count, share of distinct tokens."""
    w, s, first = tokens_of(data, offsets)
    count = np.diff(first)
    out = np.zeros((len(count), FEATURES), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        bounds, n = np.append(first[:-1][some], first[-1]), count[some][:, None]
        out[some, :WORD_DIMS] = vector_sums(words, w, bounds) / n
        out[some, WORD_DIMS:-2] = vector_sums(shapes, s, bounds) / n
        text = np.repeat(np.arange(len(count)), count)
        out[some, -1] = np.bincount(np.unique(text * WORD_ROWS + w) // WORD_ROWS, minlength=len(count))[some] / count[some]
    out[:, -2] = np.log1p(count)
    return out


class Network:
    """Two layers over standardised features, trained by Adam on the log loss; then one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 4, epochs: int = 40, batch: int = 256):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        kept, used = order[: len(x) // 5], order[len(x) // 5 :]
        shape = x.shape[1]
        self.p = [rng.normal(0, (2 / shape) ** 0.5, (shape, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            rng.shuffle(used)
            for i in range(0, len(used), batch):
                a, t = x[used[i : i + batch]], y[used[i : i + batch]]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                z = h @ self.p[2] + self.p[3]
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) / len(t)
                back = np.outer(d, self.p[2]) * (h > 0)
                grads = [a.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        z, t = self._logits(x[kept]), y[kept]
        if len(kept):
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
            self.temperature = float(grid[np.argmin([np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid])])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Model:
    """The tables and the network. A network of None scores everything 0.5."""

    def __init__(self, words: np.ndarray, shapes: np.ndarray, net: Network | None):
        self.words, self.shapes, self.net = words, shapes, net

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(offsets) - 1, 0.5)
        return self.net.scores(pooled(data, offsets, self.words, self.shapes).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model for docs (doc_id, text): tables from all texts, the network from about `rows` rows with labels that aren't held out."""
    tables = word_tables(docs)
    labels = only(labels, "doc_id", "quality").where("quality is not null and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.avg("quality").alias("quality")).where(~held_out())
    share = min(1.0, rows / max(labels.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 40)) < int(share * (1 << 40))
    sample = docs.join(F.broadcast(labels.where(draw)), "doc_id")  # about `rows` ids at most
    known = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, data, offsets in text_slices(batches):
            x = pooled(data, offsets, *known.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), binary_array([r.tobytes() for r in x])], ["doc_id", "quality", "x"])

    got = sample.select("doc_id", "text", "quality").mapInArrow(run, "doc_id long, quality double, x binary").collect()
    if not got:
        return Model(*tables, None)
    got.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, FEATURES).astype(np.float64)
    return Model(*tables, Network(x, np.array([float(r["quality"]) for r in got])))


def with_score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs and a column score, that of each row's text. Only the text goes to Python."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        found = [known.value.scores(data, offsets) for _, data, offsets in text_slices([batch])]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.withColumn("score", score(F.col(text).cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels has doc_id, quality.

    Only text is scored. Labels of rows with crc32(doc_id as text) mod 5 = 0 are never used. A null or
    empty text has the score of no tokens; repeated rows have equal scores; a null doc_id is scored and not
    held out. Without any usable label all scores are 0.5. Several labels of one doc_id count
    as their mean; labels of unknown documents and null ones are ignored. Extra columns are not read.
    """
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(docs, fit(docs, labels, rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that quality_scores predicts 1 for, with all their columns. No row moves."""
    slim = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_score(numbered(docs), fit(slim, labels, rows), f"c{place(docs, 'text')}")
    return scored.where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
