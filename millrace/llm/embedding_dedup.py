"""Near-duplicate embeddings by an inverted multi-index: codebooks of vector halves, a product grid of cells, and exact checks."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import components, cut, lookup, table

THRESHOLD = 0.9
#: Cells hold about CELL vectors, codebooks at most MOST_CODES codewords, groups of cells about GROUP vectors.
CELL, MOST_CODES, GROUP = 64, 1024, 4096
#: Codebooks and the number of cells to visit are fitted on so many vectors at most, those with the smallest hashes.
SAMPLE, RECALL = 20_000, 0.995


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres of the rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy() if len(x) >= k else np.vstack([x, rng.normal(size=(k - len(x), x.shape[1]))])
    for _ in range(rounds):
        at = distances(x, centres).argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def nearest_cells(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """For each row, the cells i * k + j that a multi-sequence traversal visits first, nearest first.

    Codewords of each half are sorted by distance. A cell can only be among the nearest n if the pairs that precede it in
    both orders, (a + 1)(b + 1) counted with itself, are no more than n; the traversal's frontier never leaves those."""
    k = d1.shape[1]
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    a, b = np.divmod(np.arange(k * k), k)
    inside = (a + 1) * (b + 1) <= visits
    a, b = a[inside], b[inside]
    sums = np.take_along_axis(d1, o1, 1)[:, a] + np.take_along_axis(d2, o2, 1)[:, b]
    first = np.argsort(sums, 1, kind="stable")[:, :visits]
    return np.take_along_axis(o1, a[first], 1) * k + np.take_along_axis(o2, b[first], 1)


def visits_for(sample: np.ndarray, books: tuple, threshold: float, recall: float, seed: int = 11) -> int:
    """How many cells to visit so that a partner exactly at the threshold, in a random direction, is met with this recall
    from the one side or the other."""
    rng = np.random.default_rng(seed)
    x = sample[:2000]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    y = threshold * x + math.sqrt(1 - threshold**2) * noise / np.maximum(np.linalg.norm(noise, axis=1)[:, None], 1e-12)
    half, k = x.shape[1] // 2, len(books[0])
    dx = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    dy = distances(y[:, :half], books[0]), distances(y[:, half:], books[1])
    row = np.arange(len(x))

    def rank(near: tuple, to: tuple) -> np.ndarray:
        cell = to[0].argmin(1), to[1].argmin(1)
        at = near[0][row, cell[0]] + near[1][row, cell[1]]
        return np.array([(a[:, None] + b[None, :] <= t).sum() for a, b, t in zip(*near, at, strict=True)])

    ranks = np.sort(np.minimum(rank(dx, dy), rank(dy, dx)))
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) if len(ranks) else 1


def unit(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors at length 1, from the bytes of their floats or doubles."""
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int32)
    data = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(held) else np.zeros(0, np.uint8)
    x = data.view(np.float64 if len(data) == 8 * dim * len(held) else np.float32).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, initial=0)[:, None]  # so that no square is too large or too small
    return x / np.linalg.norm(x, axis=1)[:, None]


def usable(vectors: DataFrame) -> tuple[DataFrame, list[int]]:
    """(vec_id, embedding) that can be compared, and the lengths that they have: vectors compare with those of their length.

    Vectors that are null, empty, all zero, or hold null or non-finite components take no part. Components are floats where
    the column's are, else doubles."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    kept = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)).where(fine)
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"))
    return kept, sorted(r[0] for r in kept.select(F.size("embedding")).distinct().collect())  # a row per length


def links_and_edges(classes: DataFrame, dim: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rep, n) links of the classes (rep, w, v) of equal vectors, counted by weight w, and (a, b) edges that connect what is linked."""
    spark = classes.sparkSession
    number = classes.count()
    drawn = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()["v"]
    sample = unit(drawn, dim)
    half = dim // 2
    k = min(MOST_CODES, max(2, 1 << max(1, round(math.log2(max(4, number / CELL)) / 2))))
    books = codebook(sample[:, :half], k), codebook(sample[:, half:], k)
    visits = min(k * k, visits_for(sample, books, threshold, recall))

    def near(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :half], books[0]), distances(x[:, half:], books[1])

    def assign(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                d1, d2 = near(unit(part["v"], dim))
                cell = d1.argmin(1) * k + d2.argmin(1)
                yield pa.RecordBatch.from_arrays([part["rep"], part["w"], part["v"], pa.array(cell.astype(np.int32))], names=["rep", "w", "v", "cell"])

    placed = cut(classes.select("rep", "w", "v").mapInArrow(assign, "rep long, w long, v binary, cell int"))
    held = np.zeros(k * k, np.int64)
    for r in placed.groupBy("cell").count().collect():  # MOST_CODES squared rows at most
        held[r["cell"]] = r["count"]
    # neighbouring cells of a first codeword share a group until it is full; a cell beyond that is dealt out over tiles, and
    # those that visit it over as many, so that each pair of tiles is a task of its own
    group, tiles, now, filled = np.zeros(k * k, np.int32), [0], 0, 0
    for cell in range(k * k):
        if filled and (cell % k == 0 or filled + held[cell] > GROUP):
            now, filled = now + 1, 0
            tiles.append(0)
        group[cell] = now
        filled += held[cell]
        tiles[now] = max(1, -(-filled // GROUP))
    tiles = np.array(tiles, np.int64)
    names = ["g", "tile", "guest", "member", "rep", "w", "own", "cells", "v"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def deal(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                at = np.array([zlib.crc32(r.to_bytes(8, "little", signed=True)) for r in part["rep"].to_pylist()])  # ids may have a common stride
                own = group[part["cell"].to_numpy()]
                cells = nearest_cells(*near(unit(part["v"], dim)), visits)
                row, nth = np.nonzero(held[cells] > 0)
                seen = cells[row, nth].astype(np.int32)
                order = np.lexsort((seen, group[seen], row))
                row, seen = row[order], seen[order]
                of = group[seen]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (of[1:] != of[:-1])])) if len(row) else np.zeros(0, np.int64)
                ends = np.append(4 * first, 4 * len(seen)).astype(np.int32)
                listed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(seen))])
                for member, row_of, g in ((True, np.arange(part.num_rows), own), (False, row[first], of[first])):
                    n = tiles[g]
                    copy = np.repeat(np.arange(len(g)), n)
                    each = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                    hashed = at[row_of[copy]] % n[copy]
                    tile, guest = (hashed, each) if member else (each, hashed)
                    took = part.take(pa.array(row_of[copy]))
                    met_cells = pa.nulls(len(copy), pa.binary()) if member else listed.take(pa.array(copy))
                    out = [g[copy], tile, guest, np.full(len(copy), member), took["rep"], took["w"], took["cell"], met_cells, took["v"]]
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=names)

    def met(y: np.ndarray, x_cells: np.ndarray) -> np.ndarray:
        """Whether each y visits the cell beside it."""
        out = np.zeros(len(y), bool)
        for lo in range(0, len(y), 2000):
            cells = nearest_cells(*near(y[lo : lo + 2000]), visits)
            out[lo : lo + 2000] = (cells == x_cells[lo : lo + 2000, None]).any(1)
        return out

    def compare(t: pa.Table) -> pa.Table:
        is_member = t["member"].to_numpy(zero_copy_only=False)
        members, probes = t.filter(pa.array(is_member)), t.filter(pa.array(~is_member))
        counts: dict[int, int] = {}
        edges: set[tuple[int, int]] = set()
        if members.num_rows and probes.num_rows:
            my, mx = unit(members["v"], dim), unit(probes["v"], dim)
            ids_y, w_y, cell_y = (members[c].to_numpy() for c in ("rep", "w", "own"))
            ids_x, w_x, cell_x = (probes[c].to_numpy() for c in ("rep", "w", "own"))
            lists = [np.frombuffer(b, np.int32) for b in probes["cells"].to_pylist()]
            pair_x = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pair_c = np.concatenate(lists)
            by_x, by_y = np.argsort(pair_c, kind="stable"), np.argsort(cell_y, kind="stable")
            pair_x, pair_c, sorted_y = pair_x[by_x], pair_c[by_x], cell_y[by_y]
            for cell in np.unique(cell_y):
                ys, xs = (of[slice(*np.searchsorted(by, [cell, cell + 1]))] for of, by in ((by_y, sorted_y), (pair_x, pair_c)))
                label = ids_y[ys].copy()
                for lo in range(0, len(xs), 1024):
                    x = xs[lo : lo + 1024]
                    linked = (mx[x] @ my[ys].T >= threshold) & (ids_x[x][:, None] != ids_y[ys][None, :])
                    some = linked.any(1)
                    if not some.any():
                        continue
                    x, linked = x[some], linked[some]
                    for i, n in zip(ids_x[x].tolist(), (linked * w_y[ys]).sum(1).tolist(), strict=True):
                        counts[i] = counts.get(i, 0) + n
                    # where y does not visit x's cell, this is y's only meeting with x
                    for row in range(0, len(x), 64):
                        at_x, at_y = np.nonzero(linked[row : row + 64])
                        away = ~met(my[ys[at_y]], cell_x[x[row + at_x]]) if visits < k * k else np.zeros(len(at_x), bool)
                        for i, n in zip(ids_y[ys[at_y[away]]].tolist(), w_x[x[row + at_x[away]]].tolist(), strict=True):
                            counts[i] = counts.get(i, 0) + n
                    # a forest that spans what is linked here: everything points to the smallest id it reaches
                    least = np.iinfo(np.int64).max
                    before = label.copy()
                    mine = ids_x[x].copy()
                    while True:
                        new_x = np.minimum(mine, np.where(linked, label, least).min(1))
                        new_y = np.minimum(label, np.where(linked, new_x[:, None], least).min(0))
                        if (new_x == mine).all() and (new_y == label).all():
                            break
                        mine, label = new_x, new_y
                    edges.update(zip(ids_x[x].tolist(), mine.tolist(), strict=True))
                    edges.update(zip(before[before != label].tolist(), label[before != label].tolist(), strict=True))
                edges.update(zip(ids_y[ys].tolist(), label.tolist(), strict=True))
        rows = [(i, None, n) for i, n in counts.items()] + [(a, b, None) for a, b in edges if a != b]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [(), (), ()])], names=["a", "b", "n"])

    found = cut(placed.mapInArrow(deal, "g int, tile int, guest int, member boolean, rep long, w long, own int, cells binary, v binary").groupBy("g", "tile", "guest").applyInArrow(compare, "a long, b long, n long"))
    links = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    return links, found.where("b is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept, for links of cosine >= threshold in double precision.

    Equal vectors are one class with a weight, so that copies cost nothing; classes are compared only in the cells that the
    traversal visits, every comparison is exact, and each group emits a forest instead of its pairs. Vectors that cannot be
    compared (see usable) have no links and are their own component; a null vec_id has a null component and is kept. Vectors
    of different lengths never link. Rows that share a vec_id count as vectors of their own. An empty table gives no rows;
    other columns are not read."""
    fine, lengths = usable(vectors)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    nothing = fine.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).limit(0)
    found = [linked(fine.where(F.size("embedding") == n), n, threshold, recall) for n in lengths]
    by_id = reduce(DataFrame.unionByName, found, nothing).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return out.join(by_id, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def linked(fine: DataFrame, dim: int, threshold: float, recall: float) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors of one length; those of a single component link if their signs agree."""
    same = F.to_json(F.struct("embedding")) if dim > 1 else F.signum(F.element_at("embedding", 1)).cast("string")
    keyed = fine.withColumn("key", F.md5(same))
    number = np.float32 if isinstance(fine.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def bytes_of(it):
        for batch in it:
            flat = batch["embedding"].flatten().to_numpy(zero_copy_only=False).astype(number).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch["key"], batch["rep"], batch["w"], pa.array([r.tobytes() for r in flat], pa.binary())], names=["key", "rep", "w", "v"])

    grouped = keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("embedding").alias("embedding"))
    classes = cut(grouped.select("key", "rep", "w", "embedding").mapInArrow(bytes_of, "key string, rep long, w long, v binary"))
    by_class = classes.select("key", "rep", "w")
    if dim > 1:
        links, edges = links_and_edges(classes, dim, threshold, recall)
        by_class = by_class.join(links, "rep", "left").join(components(edges).withColumnRenamed("node", "rep"), "rep", "left")
    else:
        by_class = by_class.withColumn("n", F.lit(0).cast("long")).withColumn("component", F.col("rep"))
    by_class = by_class.select("key", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    return lookup(keyed.select("key", "vec_id"), by_class, "key").select("vec_id", "n_links", "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id and kept. Edge cases: see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
