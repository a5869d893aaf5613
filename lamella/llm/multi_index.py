"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one for either half of the vectors, are fitted on a bounded sample; their product is a grid of
cells and every vector lies in one. A vector's cells come in the order of the summed distances of
its halves to the codewords (the multi-sequence), and it visits as many as a measured run needs for the
target recall: some distinct vectors, about CALIBRATION of them, are compared with all others by
brute force, each counting as much as any other however many links it has, and with neighbours drawn round them
at the threshold, so that tables of few links are measured as well. What meets in a
cell is verified by the cosine in double precision. Cells that lie near each other make a region, and a vector goes once to each
region in which it lives or visits cells. Full regions are cut into blocks, and
blocks of visitors meet blocks of residents; a task returns a count and a root for each row, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lamella.llm.common import binary_array, grouped, materialise, only, packed, parts
from lamella.llm.components import components

#: Vectors that the codebooks are fitted on, at most, about; vectors per cell aimed at; brute-force queries, at most, about.
SAMPLE, PER_CELL, CALIBRATION = 16_384, 256, 256
#: Neighbours drawn round each of those queries.
DRAWN = 8
#: Bytes of vectors in double precision that a block of either side holds, about, and the share of a block that a region's residents should fill.
BLOCK_BYTES, REGION_SHARE = 32 << 20, 8
#: Residents and visitors that are compared at a time.
TILE = (2048, 256)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([squared(x[i : i + 1024], centres).argmin(1) for i in range(0, len(x), 1024)])
        for j in range(k):
            mine = x[own == j]
            centres[j] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class Grid:
    """The product grid of two codebooks."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right, self.k, self.half = left, right, len(left), left.shape[1]
        self.first: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.left), squared(x[:, self.half :], self.right)

    def cells(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first cells of each row's multi-sequence, the row's own first."""
        one, two = self.distances(x)
        most = min(most, self.k * self.k)
        by_one, by_two = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
        if most not in self.first:  # a cell of ranks (i, j) has (i + 1) (j + 1) - 1 others before it at least
            upto = [min(self.k, most // (i + 1)) for i in range(min(self.k, most))]
            self.first[most] = np.repeat(np.arange(len(upto)), upto), np.concatenate([np.arange(n) for n in upto])
        i, j = self.first[most]
        total = np.take_along_axis(one, by_one, 1)[:, i] + np.take_along_axis(two, by_two, 1)[:, j]
        first = total.argsort(1, kind="stable")[:, :most]
        rows = np.arange(len(x))[:, None]
        return by_one[rows, i[first]] * self.k + by_two[rows, j[first]]

    def place(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells come before this one in each row's multi-sequence."""
        one, two = self.distances(x)
        rows = np.arange(len(x))
        mine = one[rows, cell // self.k] + two[rows, cell % self.k]
        out, step = np.zeros(len(x), np.int64), max(1, (1 << 20) // self.k**2)
        for i in range(0, len(x), step):
            part = slice(i, i + step)
            out[part] = (one[part, :, None] + two[part, None, :] < mine[part, None, None] - 1e-12).sum((1, 2))
        return out


def prepared(vectors: DataFrame) -> tuple[DataFrame, str]:
    """row, vec_id, x: all rows numbered, with the vector's bytes; x is null for vectors that link with nothing. And the bytes' kind: single precision stays so."""
    column_ = only(vectors, "embedding").schema[0].dataType
    kind = "f4" if isinstance(column_, ArrayType) and isinstance(column_.elementType, FloatType) else "f8"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding").to_pylist():
                ok = v is not None and len(v) > 0 and None not in v
                a = np.array(v, np.float64) if ok else np.zeros(1)
                out.append(a.astype(kind).tobytes() if ok and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), binary_array(out)], ["vec_id", "x"])

    slim = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return materialise(slim.mapInArrow(run, "vec_id long, x binary").select(F.monotonically_increasing_id().alias("row"), "vec_id", "x"), "vectors"), kind


def fitted(live: DataFrame, count: int, dims: int, kind: str) -> Grid:
    """The grid for these vectors, from at most about SAMPLE of them."""
    share = min(1.0, SAMPLE / max(count, 1))
    draw = live.where(F.pmod(F.xxhash64("row", F.lit(10)), F.lit(1 << 40)) < int(share * (1 << 40))).select("row", "x").collect()
    draw.sort(key=lambda r: r["row"])
    x = matrix([bytes(r["x"]) for r in draw], dims, kind)
    k = int(min(max(2, round((count / PER_CELL) ** 0.5)), max(1, len(x) // 8)))
    half = dims // 2
    return Grid(k_means(x[:, :half], k, 1), k_means(x[:, half:], k, 2))


def matrix(blobs: pa.ChunkedArray | pa.Array | list[bytes], dims: int, kind: str) -> np.ndarray:
    """The unit vectors of these bytes, in double precision."""
    return unit(np.frombuffer(b"".join(blobs if isinstance(blobs, list) else blobs.to_pylist()), kind).reshape(-1, dims))


def drawn_neighbours(q: np.ndarray, least: float, each: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector so many times, and as many others at exactly this cosine, in directions drawn evenly."""
    many = np.repeat(q, each, 0)
    aside = np.random.default_rng(4).normal(size=many.shape)
    aside -= (aside * many).sum(1, keepdims=True) * many
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    there = size[:, 0] > 1e-9  # a single dimension has nothing aside
    cosine = min(max(least, -1.0), 1.0)
    return many[there], cosine * many[there] + (1 - cosine**2) ** 0.5 * aside[there] / size[there]


def visits_for(place: np.ndarray, weight: np.ndarray, target: float) -> int:
    """The visits that meet the target share of the weight; 1 where there is none."""
    if not len(place):
        return 1
    order = np.argsort(place, kind="stable")
    met = np.cumsum(weight[order])
    return int(place[order][np.searchsorted(met, min(target * met[-1] * (1 - 1e-12), met[-1]))]) + 1


def visits_needed(live: DataFrame, grid: Grid, dims: int, kind: str, least: float, target: float, floor: int = 4) -> tuple[int, float]:
    """How many cells a vector visits so that the target share of links is met from one side or the other, and the share that so many meet.

    Measured twice, and the larger counts: over the links of sampled distinct vectors, a vector's links weighing 1
    together and its copies left out, as they lie where it does; and over neighbours drawn round them at the
    threshold, which a table without links has as well. Visits below the floor are raised to it.
    """
    key = F.xxhash64("x", F.lit(50))
    distinct = live.agg(F.approx_count_distinct(key)).first()[0]
    share = min(1.0, CALIBRATION / max(distinct, 1))
    got = live.where(F.pmod(key, F.lit(1 << 40)) < int(share * (1 << 40))).select("x").distinct().collect()
    got = got or live.select("x").limit(1).collect()
    sample = matrix(sorted(bytes(r["x"]) for r in got), dims, kind)
    queries = live.sparkSession.sparkContext.broadcast((sample, grid))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, g = queries.value
        home, cells = g.cells(q, 1)[:, 0], g.k**2
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = matrix(batch.slice(at, 1024).column("x"), dims, kind)
                cosine = x @ q.T
                a, b = np.nonzero((cosine >= least) & (cosine < 1 - 1e-12))
                if not len(a):
                    continue
                own = g.cells(x, 1)[:, 0]
                near = [np.minimum(g.place(q[b[i : i + 512]], own[a[i : i + 512]]), g.place(x[a[i : i + 512]], home[b[i : i + 512]])) for i in range(0, len(a), 512)]
                code, links = np.unique(b * cells + np.concatenate(near), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // cells), pa.array(code % cells), pa.array(links.astype(np.int64))], ["query", "place", "links"])

    found = live.select("x").mapInArrow(run, "query long, place long, links long").groupBy("query", "place").agg(F.sum("links").alias("links")).collect()  # a row a query and place at most
    query, place, links = (np.array([r[c] for r in found], np.int64) for c in ("query", "place", "links"))
    seen = visits_for(place, links / np.bincount(query, links, len(sample))[query], target)
    near, far = drawn_neighbours(sample, least)
    made = np.minimum(grid.place(near, grid.cells(far, 1)[:, 0]), grid.place(far, grid.cells(near, 1)[:, 0]))
    visits = min(max(floor, seen, visits_for(made, np.ones(len(made)), target)), grid.k**2)
    return visits, float((made < visits).mean()) if len(made) else 1.0


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that pairs (a, b) tie each of 0..n-1 to."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def regions_of(grid: Grid, count: int, block: int) -> tuple[np.ndarray, int]:
    """The band of each right codeword, and how many bands there are: a region is a left codeword with a band, whose codewords lie beside
    each other along the direction in which they differ most, and holds about a block's REGION_SHARE-th part of residents."""
    bands = int(min(grid.k, max(1, -(-count * REGION_SHARE // (grid.k * block)))))
    centred = grid.right - grid.right.mean(0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if grid.right.shape[1] else np.zeros(grid.k)
    rank = np.empty(grid.k, np.int64)
    rank[np.argsort(along, kind="stable")] = np.arange(grid.k)
    return rank * bands // grid.k, bands


def meetings(live: DataFrame, grid: Grid, count: int, dims: int, kind: str, visits: int, least: float) -> DataFrame:
    """row, links, root: for each row and block that it met a link in, how many, and the least row that the block's links tie it to."""
    spark = live.sparkSession
    block = max(64, BLOCK_BYTES // (8 * dims))
    band, bands = regions_of(grid, count, block)
    known = spark.sparkContext.broadcast((grid, band))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, band = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                cells = g.cells(matrix(piece.column("x"), dims, kind), visits)
                region = cells // g.k * bands + band[cells % g.k]
                by = np.argsort(region, axis=1, kind="stable")
                sorted_cells, sorted_regions = np.take_along_axis(cells, by, 1).ravel().astype(np.int32), np.take_along_axis(region, by, 1)
                new = np.ones(sorted_regions.shape, bool)
                new[:, 1:] = sorted_regions[:, 1:] != sorted_regions[:, :-1]
                cuts = np.append(np.flatnonzero(new.ravel()), new.size)
                each = pa.StructArray.from_arrays([pa.array(sorted_regions.ravel()[cuts[:-1]]), packed(sorted_cells, cuts)], ["region", "here"])
                offsets = np.concatenate([[0], np.cumsum(new.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("x"), pa.array(cells[:, 0].copy()), pa.array(region[:, 0].copy()), binary_array([c.tobytes() for c in cells.astype(np.int32)]), pa.ListArray.from_arrays(pa.array(offsets), each)],
                    ["row", "x", "home", "lives_in", "cells", "regions"],
                )

    kinds = "row long, x binary, home long, lives_in long, cells binary, regions array<struct<region:long,here:binary>>"
    dealt = materialise(live.select("row", "x").mapInArrow(deal, kinds), "cells")
    come = dealt.select("lives_in", F.explode("regions.region").alias("region")).groupBy("region").agg(F.count("*").alias("visitors"), F.count_if(F.col("region") == F.col("lives_in")).alias("residents"))
    full = come.select("region", F.expr(f"cast(greatest(1, (residents + {block - 1}) div {block}) as int)").alias("nb"), F.expr(f"cast((visitors + {block - 1}) div {block} as int)").alias("qb")).where("nb > 1 or qb > 1")
    full = materialise(full, "full")
    sent = dealt.select("row", "x", "home", "lives_in", "cells", F.explode("regions").alias("r")).select("row", "x", "home", "cells", "r.region", "r.here", (F.col("r.region") == F.col("lives_in")).alias("lives"))
    sent = sent.join(full, "region", "left").withColumns({"nb": F.coalesce("nb", F.lit(1)), "qb": F.coalesce("qb", F.lit(1))})
    sent = sent.withColumns({"n": F.pmod(F.hash("row"), F.col("nb")), "q": F.pmod(F.hash("row", F.lit(7)), F.col("qb"))})
    # a resident meets all blocks of visitors, a visitor all blocks of residents; who is both goes once where the two coincide
    as_resident = "transform(sequence(0, qb - 1), b -> named_struct('n', n, 'q', b, 'lives', true, 'visits', b = q))"
    as_visitor = "transform(filter(sequence(0, nb - 1), b -> not lives or b <> n), b -> named_struct('n', b, 'q', q, 'lives', false, 'visits', true))"
    sent = sent.withColumn("to", F.explode(F.expr(f"if(lives, concat({as_resident}, {as_visitor}), {as_visitor})")))
    both = sent.select("region", F.col("to.n").alias("nblock"), F.col("to.q").alias("qblock"), "row", "x", "home", F.when(F.col("to.lives"), F.col("cells")).alias("cells"), F.when(F.col("to.visits"), F.col("here")).alias("here"))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["region", "nblock", "qblock"]):
            lives = group["cells"].is_valid().to_numpy(zero_copy_only=False)
            asked = group["here"].is_valid().to_numpy(zero_copy_only=False)
            if not lives.any() or not asked.any():
                continue
            row, home = group["row"].to_numpy(), group["home"].to_numpy()
            x = matrix(group["x"], dims, kind)
            visited = np.frombuffer(b"".join(group["cells"].drop_null().to_pylist()), np.int32).reshape(lives.sum(), -1)
            at = np.cumsum(lives) - 1  # a resident's line in visited
            here = [np.frombuffer(h, np.int32) for h in group["here"].drop_null().to_pylist()]
            guest, wish = np.repeat(np.flatnonzero(asked), [len(h) for h in here]), np.concatenate(here)
            by = np.argsort(wish, kind="stable")
            guest, wish = guest[by], wish[by]
            settled = np.flatnonzero(lives)
            settled = settled[np.argsort(home[settled], kind="stable")]
            cells, begin = np.unique(home[settled], return_index=True)
            links, ends = np.zeros(len(row), np.int64), []
            for cell, own in zip(cells.tolist(), np.split(settled, begin[1:]), strict=True):
                come = guest[np.searchsorted(wish, cell, "left") : np.searchsorted(wish, cell, "right")]
                for i in range(0, len(own), TILE[0]):
                    for j in range(0, len(come), TILE[1]):
                        m, part = own[i : i + TILE[0]], come[j : j + TILE[1]]
                        a, b = np.nonzero((x[m] @ x[part].T >= least) & (row[m][:, None] != row[part]))
                        if not len(a):
                            continue
                        a, b = m[a], part[b]
                        near = home[b] == cell  # both live here, and each visits the other
                        links += np.bincount(b[near], minlength=len(row))
                        a2, b2 = a[~near], b[~near]
                        # met in the visitor's cell as well, if the resident goes there: the smaller cell counts it
                        twice = np.zeros(len(a2), bool)
                        for k in range(0, len(a2), 65_536):
                            twice[k : k + 65_536] = (visited[at[a2[k : k + 65_536]]] == home[b2[k : k + 65_536]][:, None]).any(1)
                        once = ~twice | (cell < home[b2])
                        links += np.bincount(a2[once], minlength=len(row)) + np.bincount(b2[once], minlength=len(row))
                        few, tied = np.unique(np.concatenate([a, b]), return_inverse=True)
                        root = local_roots(tied[: len(a)], tied[len(a) :], len(few))
                        ends.append(np.column_stack([few, few[root]]))
            if not ends:
                continue
            e = np.concatenate(ends)
            order = np.argsort(row, kind="stable")  # the least row of a tie names it
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row))
            root = order[local_roots(place[e[:, 0]], place[e[:, 1]], len(row))][place]
            tied = np.flatnonzero((links > 0) | (root != np.arange(len(row))))
            yield pa.RecordBatch.from_arrays([pa.array(row[tied]), pa.array(links[tied]), pa.array(row[root[tied]])], ["row", "links", "root"])

    keys = ["region", "nblock", "qblock"]
    return both.repartition(parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(meet, "row long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, target: float = 0.99, report: list | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Two rows link when they meet in the index and their cosine in double precision is `least` or more; vectors of each length
    have an index of their own, as none links with one of another length. n_links
    counts the other rows linked directly, component_id is the smallest vec_id that links reach, kept
    whether that is the row's own. A null, empty or zero vector, and one with a null or non-finite component, links
    with nothing. Repeated rows are rows of their own, so they link. A null vec_id names no
    component unless its component has no other id; kept is then true for all. Other columns are not read. An
    empty table gives none. target: the share of links that the number of visits is measured for, over
    vectors of equal weight and over neighbours drawn at the threshold. report: gets (length, rows, codewords a half, visits,
    share of the drawn neighbours met) for each length.
    """
    all_rows, kind = prepared(vectors)
    sizes = all_rows.where("x is not null").groupBy(F.octet_length("x").alias("n")).agg(F.count("*").alias("rows")).where("rows > 1").orderBy("n").collect()  # a row a length
    found = []
    for size in sizes:
        dims, live = size["n"] // np.dtype(kind).itemsize, all_rows.where(F.octet_length("x") == size["n"])
        grid = fitted(live, size["rows"], dims, kind)
        visits, share = visits_needed(live, grid, dims, kind, least, target)
        if report is not None:
            report.append((dims, size["rows"], grid.k, visits, share))
        found.append(materialise(meetings(live, grid, size["rows"], dims, kind, visits, least), "met"))
    if not found:  # nothing to compare
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = reduce(DataFrame.union, found)
    counts = met.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = groups.join(all_rows.select(F.col("row").alias("node"), "vec_id"), "node")
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    tied = named.select("node", "component").join(least_id, "component").select(F.col("node").alias("row"), "component_id")
    out = all_rows.select("row", "vec_id").join(counts, "row", "left").join(tied, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: All pairs, by brute force.
ORACLE = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and not list_contains(list_transform(embedding, lambda x: x is null or not isfinite(x)), true)),
w as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
pairs as (select a.vec_id as a, b.vec_id as b from w a join w b on a.vec_id <> b.vec_id and a.n > 0 and b.n > 0 and list_inner_product(a.e, b.e) / a.n / b.n >= 0.9),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a, min(b) as m from reach group by a),
links as (select a, count(*) as n from pairs group by a)
select e.vec_id, coalesce(k.n, 0)::bigint as n_links, least(e.vec_id, coalesce(l.m, e.vec_id))::bigint as component_id, e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) as kept
from embeddings e left join links k on e.vec_id = k.a left join least l on e.vec_id = l.a
"""
