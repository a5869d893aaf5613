"""N-gram Jaccard join: groups of documents whose sets of word shingles overlap enough.

The document by shingle incidence is multiplied with itself in blocks, and only where two rows can
reach the threshold:

1. A pass over the texts counts the shingles in a table of fixed size. Its crowded cells make the
   bitmap of frequent shingles, which come last in the order of shingles that all documents use.
2. A second pass keeps for each document the size of its set, a 64-bit name of the set, and the
   n - ceil(t n) + 1 first shingles. Two linked sets share one of these at least. Equal sets are one row
   from here on.
3. Blocks of these columns, each with its whole 64-bit shingles, are multiplied: where at most PAIRS_UP_TO sets share a
   shingle, their overlaps are counted by pair and summed over the blocks; a pair goes when the sum and what lies beyond the
   shorter of the two reaches can't make the overlap that its sizes demand. A shingle that more
   sets share ties them all to one of them, so that no pairs are emitted. Where such shingles are many, as in tables too large for the
   counting table to tell them, they join the frequent ones and steps 2 and 3 run again: what is tied then are sets that
   consist of crowded shingles almost wholly, near-copies of one text as a rule.
4. The connected groups of what is left hold every link. A third pass fetches the texts of
   their members, and each group's product is counted exactly: in one task up to GROUP_ROWS rows and GROUP_SHINGLES shingles,
   else in blocks, each with some rows of the whole group; rows that these leave apart from a group's
   largest part then meet all its blocks. A task emits a spanning forest of the links it finds.

No partner is capped and no candidate dropped. Memory is bounded by blocks; the bitmaps of frequent shingles, of rows that stand
for equal sets and of documents to fetch have a fixed size and decide only speed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import Forest, binary_array, bitmap_of, grouped, materialise, maybe_in, only, packed, parts, runs, summed_array, text_parts, text_slices
from lamella.llm.components import components
from lamella.llm.wordhash import gram_hashes, mix, span_hashes, word_spans

_U = np.uint64
#: Cells of the counting table, and bits of the other filters.
CELLS, FILTER_BITS = 1 << 22, 1 << 26
#: Postings that one block of columns holds, about, and pairs that are counted at a time.
BLOCK_POSTINGS, PAIRS_AT_ONCE = 1_000_000, 4_000_000
PAIRS_UP_TO = 64
#: The share of sets tied by crowded shingles above which the order of shingles is refined.
CROWDED_SHARE = 0.1
GROUP_ROWS, GROUP_SHINGLES = 1024, 4_000_000
#: Rows of a group beyond one block that all its blocks get, about.
PIVOTS = 16


def need(n: np.ndarray, per_cent: int) -> np.ndarray:
    """The least overlap that a set of n can have with a linked one: ceil(t n)."""
    return (n * per_cent + 99) // 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = word_spans(data, offsets)
    grams, bounds = gram_hashes(span_hashes(data, starts, ends, fold=True), first, size)
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = np.sort(grams[a:b])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own


def set_name(own: np.ndarray) -> int:
    """A 64-bit name of a set (signed)."""
    return int(mix(mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True))[0].astype(np.int64))


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """A bit for each cell that holds more shingles than chance explains."""

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        cells = np.zeros(CELLS, np.uint32)
        for _, data, offsets in text_slices(batches):
            got = [s for s in shingle_sets(data, offsets, size) if len(s)]
            if got:
                at, n = np.unique((np.concatenate(got) >> _U(42)).astype(np.int64), return_counts=True)
                cells[at] += n.astype(np.uint32)
        return cells

    cells = summed_array(docs.select("text"), count, CELLS, np.uint32)
    mean = float(cells.mean(dtype=np.float64))
    return np.packbits(cells > mean + 4 * mean**0.5 + 4)


def order_keys(own: np.ndarray, cells: np.ndarray, crowded: np.ndarray | None) -> np.ndarray:
    """The shingles as keys of the common order: frequent ones last. cells, crowded: bitmaps by leading and by trailing bits of a shingle."""
    cell = (own >> _U(42)).astype(np.int64)
    hot = (cells[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
    if crowded is not None:
        spot = (own >> _U(1) & _U(FILTER_BITS - 1)).astype(np.int64)
        hot |= (crowded[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1
    return np.sort((own >> _U(1)) | (hot.astype(np.uint64) << _U(63)))


def size_codes(n: np.ndarray) -> np.ndarray:
    """Sizes in 16 bits: eleven leading bits, and how many follow."""
    e = np.maximum(np.frexp(n.astype(np.float64))[1] - 11, 0)
    return (e << 11 | n >> e).astype(np.uint16)


def least_sizes(code: np.ndarray) -> np.ndarray:
    """The least size of each code. The largest is less than a 1024th above it."""
    code = code.astype(np.int64)
    return (code & 2047) << (code >> 11)


def sketch(docs: DataFrame, size: int, per_cent: int, cells: np.ndarray, crowded: np.ndarray | None = None) -> DataFrame:
    """node, doc_id, tkey, n, name, keys: a number for each row, the hash of its text, the size and name of its set, and its first
    shingles in the common order (null where this task has given them for an equal set)."""
    bits = docs.sparkSession.sparkContext.broadcast((cells, crowded))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece, data, offsets in text_slices(batches):
            ns, names, keys = [], [], []
            for own in shingle_sets(data, offsets, size):
                n, name = len(own), set_name(own) if len(own) else 0
                ns.append(n)
                names.append(name)
                if n and name not in seen:
                    seen.add(name)
                    keys.append(order_keys(own, *bits.value)[: n - int(need(n, per_cent)) + 1].tobytes())
                else:
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("tkey"), pa.array(ns, pa.int64()), pa.array(names, pa.int64()), binary_array(keys)], ["doc_id", "tkey", "n", "name", "keys"])

    found = docs.select("doc_id", "tkey", "text").mapInArrow(run, "doc_id long, tkey long, n long, name long, keys binary")
    return materialise(found.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")


def representatives(sets: DataFrame) -> DataFrame:
    """name, node, doc_id, tkey, n, least: for each set one row that stands for it, and the least doc_id."""
    one = F.min(F.struct("node", "doc_id", "tkey", "n"))
    named = sets.where("keys is not null").groupBy("name").agg(one.alias("r"))
    least = sets.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("least"))
    return materialise(named.join(least, "name").select("name", "r.*", "least"), "reps")


def overlap_counts(sets: DataFrame, reps: DataFrame, per_cent: int) -> DataFrame:
    """kind, a, b, na, nb, shared, block by block.

    Kind 0: sets a and b (by node) of at least na and nb shingles that share so many first shingles. Kind 1: two of many sets that share a
    crowded one. Kind 2: a crowded shingle, its sets counted in shared.
    """
    spark = sets.sparkSession
    spot = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    stand = spark.sparkContext.broadcast(bitmap_of(reps, spot, FILTER_BITS))
    total = sets.where("keys is not null").agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0
    blocks = max(parts(spark), int(total // BLOCK_POSTINGS) + 1)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array(((stand.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            node = batch.column("node").to_numpy()
            gap = np.diff(node, prepend=node[:1])
            _, ends = text_parts(batch.column("keys"))
            at, back = 0, np.flatnonzero(gap < 0)  # numbers ascend, but for where another file begins
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + (32 << 20), "right")) - 1)
                end = min([end, *back[back > at][:1].tolist()])
                yield cells_of(batch.slice(at, end - at))
                at = end

    def cells_of(piece: pa.RecordBatch) -> pa.RecordBatch:
        raw, ends = text_parts(piece.column("keys"))
        keys = np.frombuffer(raw.tobytes(), np.uint64)
        row = np.repeat(np.arange(piece.num_rows), np.diff(ends) // 8)
        node, code = piece.column("node").to_numpy(), size_codes(piece.column("n").to_numpy())
        block = ((keys >> _U(32) & _U(0x7FFFFFFF)) % _U(blocks)).astype(np.int64)
        by = np.argsort(block, kind="stable")
        block, keys, row = block[by], keys[by], row[by]
        own = node[row]
        gaps = np.diff(own, prepend=own[:1])
        first = np.diff(block, prepend=-1) > 0
        first |= gaps > 0xFFFF  # so that two bytes hold a step
        gaps[first] = 0
        cuts = np.append(np.flatnonzero(first), len(keys))
        new = first | (gaps > 0)
        count = np.concatenate([[0], np.cumsum(new)])[cuts]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[cuts[:-1]]), pa.array(own[cuts[:-1]]), packed(keys, cuts), packed(gaps.astype(np.uint8), cuts), packed((gaps >> 8).astype(np.uint8), cuts), packed(code[row[new]], count)],
            ["block", "base", "keys", "steps", "far", "sizes"],
        )

    def decoded(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, node and least size of each posting of a block, by key and node."""
        keys, nodes, sizes = [], [], []
        for base, k, low, high, c in zip(*(group[x].to_pylist() for x in ("base", "keys", "steps", "far", "sizes")), strict=True):
            gaps = np.frombuffer(low, np.uint8) + (np.frombuffer(high, np.uint8).astype(np.int64) << 8)
            new = gaps > 0
            new[:1] = True
            keys.append(np.frombuffer(k, np.uint64))
            nodes.append(base + np.cumsum(gaps))
            sizes.append(np.frombuffer(c, np.uint16)[np.cumsum(new) - 1])
        key, node, code = map(np.concatenate, (keys, nodes, sizes))
        by = np.lexsort((node, key))
        return key[by], node[by], least_sizes(code[by])

    def out(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *[pa.array(np.ascontiguousarray(x, np.int64)) for x in (a, b, na, nb, shared)]], ["kind", "a", "b", "na", "nb", "shared"])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["block"]):
            key, node, n = decoded(group)
            cuts = runs(key)
            length, at = np.diff(cuts), cuts[:-1]
            names, at_name = np.unique(node, return_inverse=True)
            size = np.zeros(len(names), np.int64)
            size[at_name] = n
            codes, counts, held = [], [], 0

            def summed() -> tuple[np.ndarray, np.ndarray]:
                code, back = np.unique(np.concatenate(codes), return_inverse=True)
                return code, np.bincount(back, np.concatenate(counts)).astype(np.int64)

            for k in range(2, PAIRS_UP_TO + 1):
                here = at[length == k]
                i, j = np.triu_indices(k, 1)
                step = max(1, PAIRS_AT_ONCE // max(len(i), 1))
                for some in range(0, len(here), step):
                    rows = here[some : some + step, None]
                    x, y = at_name[(rows + i).ravel()], at_name[(rows + j).ravel()]
                    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                    fits = 100 * (small + small // 1024) >= per_cent * large
                    code, shared = np.unique(x[fits] * len(names) + y[fits], return_counts=True)
                    codes.append(code)
                    counts.append(shared)
                    held += len(code)
                    if held > 2 * PAIRS_AT_ONCE:
                        code, shared = summed()
                        codes, counts, held = [code], [shared], 0
            if codes:
                code, shared = summed()
                x, y = code // len(names), code % len(names)
                for some in range(0, len(code), 100_000):
                    part = slice(some, some + 100_000)
                    yield out(0, names[x[part]], names[y[part]], size[x[part]], size[y[part]], shared[part])
            crowded = length > PAIRS_UP_TO
            if crowded.any():
                ties = [np.column_stack([np.full(k - 1, node[a]), node[a + 1 : a + k]]) for a, k in zip(at[crowded], length[crowded], strict=True)]
                t = np.unique(np.concatenate(ties), axis=0)
                none = np.zeros(len(t), np.int64)
                yield out(1, t[:, 0], t[:, 1], none, none, none)
                none = np.zeros(crowded.sum(), np.int64)
                yield out(2, key[at[crowded]].astype(np.int64), none, none, none, length[crowded])

    dealt = sets.where("keys is not null").select("node", "n", "keys", spot.alias("spot")).mapInArrow(deal, "block long, base long, keys binary, steps binary, far binary, sizes binary")
    return materialise(dealt.repartition(parts(spark), "block").sortWithinPartitions("block").mapInArrow(multiply, "kind int, a long, b long, na long, nb long, shared long"), "overlaps")


def first_products(docs: DataFrame, size: int, per_cent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets, their representatives, and the overlaps of first shingles, in an order whose first shingles are seldom crowded."""
    cells, crowded, before = frequent(docs, size), None, float("inf")
    while True:
        sets = sketch(docs, size, per_cent, cells, crowded)
        reps = representatives(sets)
        overlaps = overlap_counts(sets, reps, per_cent)
        share = overlaps.where("kind = 1").agg(F.approx_count_distinct("b")).first()[0] / max(reps.count(), 1)
        if share <= CROWDED_SHARE or share > before / 2:
            return sets, reps, overlaps
        found = bitmap_of(overlaps.where("kind = 2"), F.col("a").bitwiseAND(F.lit(FILTER_BITS - 1)), FILTER_BITS)
        crowded, before = found if crowded is None else crowded | found, share


def candidates(overlaps: DataFrame, per_cent: int) -> DataFrame:
    """a, b: pairs whose groups hold every link."""
    t = f"cast({per_cent} as bigint)"
    summed = overlaps.where("kind = 0").groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    demand = f"(({t} * (na + nb) + 99 + {t}) div (100 + {t}))"  # ceil(t (na + nb) / (1 + t)), of the least sizes
    beyond = f"((greatest(na, nb) + greatest(na, nb) div 1024) * {t} + 99) div 100 - 1"  # what lies behind the first shingles of the larger, at most
    return summed.where(f"shared + {beyond} >= {demand}").select("a", "b").union(overlaps.where("kind = 1").select("a", "b"))


def links_within(names: np.ndarray, sets: list[np.ndarray], per_cent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets, as pairs of names.

    side: only links between rows of side 0 and others are looked for. known: rows of equal numbers are connected already.
    """
    count = len(sets)
    n = np.fromiter(map(len, sets), np.int64, count)
    forest, out = Forest(count), []
    if count == 2:
        shared = len(np.intersect1d(*sets, assume_unique=True))
        if 100 * shared >= per_cent * (n[0] + n[1] - shared):
            out.append((0, 1))
    elif count > 2:
        left = count
        if known is not None:
            by = np.argsort(known, kind="stable")
            for i, j in zip(by, by[1:], strict=False):
                if known[i] == known[j]:
                    left -= forest.join(int(i), int(j))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(count), n)
        by = np.argsort(flat, kind="stable")
        flat, owner = flat[by], owner[by]
        cuts = runs(flat)
        length = np.diff(cuts)
        common = np.repeat(length > 1, length)
        column_of = np.repeat(np.arange(len(length)), length)
        # by row: its columns that others share; the rows with the most crowded columns come first
        rows, cols = owner[common], column_of[common]
        weight = np.bincount(owner, weights=np.repeat(length, length), minlength=count) / np.maximum(n, 1)
        order = np.argsort(rows, kind="stable")
        rows, cols = rows[order], cols[order]
        begin = np.searchsorted(rows, np.arange(count + 1))
        for i in np.argsort(-weight, kind="stable"):
            if left == 1:
                break
            mine = cols[begin[i] : begin[i + 1]]
            if not len(mine) or side is not None and side[i]:
                continue
            k = length[mine]
            take = np.repeat(cuts[mine] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            shared = np.bincount(owner[take], minlength=count)
            hit = 100 * shared >= per_cent * (n + n[i] - shared)
            hit[i] = False
            if side is not None:
                hit &= side > 0
            for j in np.flatnonzero(hit):
                if forest.join(int(i), int(j)):
                    out.append((int(i), int(j)))
                    left -= 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return names[pairs[:, 0]], names[pairs[:, 1]]


#: Stands for a null doc_id in joins.
_NO_ID = -(1 << 63)


def whole_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tkey, doc_id and more) with the text of each row. A filter of fixed size picks the texts before any moves."""
    own = [F.col("tkey"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id")]
    spot = F.pmod(F.xxhash64("tkey", F.coalesce("doc_id", F.lit(_NO_ID))), F.lit(FILTER_BITS))
    picked = maybe_in(wanted, spot, FILTER_BITS)
    # rows that are equal in id and text may be many: each task gives one
    texts = docs.where(picked(spot)).select(*own, "text").dropDuplicates(["tkey", "id"])
    keys = wanted.select(*own, *[c for c in wanted.columns if c not in ("tkey", "doc_id")])
    return keys.join(texts, ["tkey", "id"])


def products(docs: DataFrame, dealt: DataFrame, keys: list[str], size: int, per_cent: int, across: bool) -> DataFrame:
    """a, b: a spanning forest of the links in each task's rows. dealt: node, name, doc_id, tkey, the task's keys, and side and label where across is set."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, keys):
            found: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
            for batch in group.to_batches():
                sides = batch.column("side").to_pylist() if across else [0] * batch.num_rows
                labels = batch.column("label").to_pylist() if across else sides
                at = 0
                for piece, data, offsets in text_slices([batch]):
                    for name, node, own in zip(piece.column("name").to_pylist(), piece.column("node").to_pylist(), shingle_sets(data, offsets, size), strict=True):
                        if len(own) and (node, sides[at]) not in found and set_name(own) == name:
                            found[node, sides[at]] = (own, labels[at])
                        at += 1
            names = np.fromiter((k[0] for k in found), np.int64, len(found))
            side = np.fromiter((k[1] for k in found), np.int64, len(found)) if across else None
            label = np.fromiter((v[1] for v in found.values()), np.int64, len(found)) if across else None
            if across and (side.all() or not side.any()):
                continue
            a, b = links_within(names, [s for s, _ in found.values()], per_cent, side, label)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    names = ["node", "name", "text", *keys, *["side", "label"] * across]
    whole = whole_texts(docs, dealt).select(*names)
    return whole.repartition(parts(docs.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(multiply, "a long, b long")


def exact_links(docs: DataFrame, reps: DataFrame, groups: DataFrame, size: int, per_cent: int) -> DataFrame:
    """a, b: a spanning forest of the links, found from whole texts. reps: one row a set; groups: node, component.

    A group is dealt to blocks of GROUP_ROWS rows and GROUP_SHINGLES shingles, and the blocks of larger groups get the same few rows of the group, drawn at random,
    besides: near-copies of one text meet there, whichever block they lie in. Only where a group is in several parts after
    that, the rows outside its largest part, in blocks, meet all blocks; pairs within the largest need no look.
    """
    own = ["node", "name", "doc_id", "tkey"]
    members = materialise(groups.join(reps.select(*own, "n"), "node"), "members")
    cut = f"cast(greatest((rows + {GROUP_ROWS - 1}) div {GROUP_ROWS}, (shingles + {GROUP_SHINGLES - 1}) div {GROUP_SHINGLES}) as int)"
    sizes = members.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).withColumn("blocks", F.expr(cut))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    placed = materialise(placed, "placed")
    large = placed.where("blocks > 1")
    drawn = large.where(F.pmod(F.xxhash64("node"), F.lit(1 << 40)) < F.lit(float(PIVOTS * (1 << 40))) / F.col("rows"))
    everywhere = drawn.select(*own, "component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    dealt = placed.select(*own, "component", "block").union(everywhere)
    links = products(docs, dealt, ["component", "block"], size, per_cent, False)
    if not large.limit(1).count():
        return links
    links = materialise(links, "links")
    labelled = large.join(components(links).select("node", F.col("component").alias("label")), "node", "left")
    labelled = materialise(labelled.withColumn("label", F.coalesce("label", "node")), "labelled")
    tally = labelled.groupBy("component", "label").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
    largest = tally.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("s").alias("shingles_all"), F.max_by("s", F.struct("n", "label")).alias("shingles_most")).where("`all` > most")
    outer_cut = f"cast(greatest((`all` - most + {GROUP_ROWS - 1}) div {GROUP_ROWS}, (shingles_all - shingles_most + {GROUP_SHINGLES - 1}) div {GROUP_SHINGLES}, 1) as int)"
    broken = materialise(labelled.join(largest.select("component", "main", F.expr(outer_cut).alias("outer_blocks")), "component"), "broken")
    if not broken.limit(1).count():
        return links
    outer = broken.where("label <> main").withColumn("outer", F.pmod(F.hash("node", F.lit(3)), F.col("outer_blocks")))
    one = outer.select(*own, "label", "component", "outer", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"))
    two = broken.select(*own, "label", "component", F.explode(F.expr("sequence(0, outer_blocks - 1)")).alias("outer"), "block", F.lit(1).alias("side"))
    return links.union(products(docs, one.union(two), ["component", "outer", "block"], size, per_cent, True))


def jaccard_groups(docs: DataFrame, size: int = 5, per_cent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text; other columns are not read).

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A set holds the distinct
    runs of size words; a text of fewer words has its whole sequence as its one member. Null or empty
    texts, and those of white space only, have no set and are linked with nothing. Sets link when
    100 |A and B| >= per_cent |A or B|; equal texts therefore link. component_id is the smallest
    doc_id that links reach, the row's own included. Repeated rows are rows of their own with equal
    results; rows with one doc_id and different texts each have the result of their own text. A row of a null doc_id
    links like any other and never names a group unless all in it are null. An empty table gives none.
    Sets are compared as sets of 64-bit hashes.
    """
    docs = only(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    sets, reps, overlaps = first_products(docs, size, per_cent)
    groups = components(candidates(overlaps, per_cent))
    linked = components(exact_links(docs, reps, groups, size, per_cent))
    named = reps.join(linked, "node", "left").select("name", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "component").select("name", "component_id"), "named")
    return sets.select("doc_id", "n", "name").join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: All pairs that share a shingle, their overlaps, and what links reach.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, (len(w) - 3)::bigint), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from w),
i as (select doc_id, len(s) as n, unnest(s) as g from s),
c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from i a join i b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c where 100 * k >= 75 * (na + nb - k)),
both_ways as (select a, b from l union all select b, a from l),
reach(a, b) as (select a, b from both_ways union select r.a, p.b from reach r join both_ways p on r.b = p.a),
least as (select a, min(b) as m from reach group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id))::bigint as component_id
from s left join least l on s.doc_id = l.a
"""
