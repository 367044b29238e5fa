"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Nearness is the largest inner product. Inside a shard it is made a distance: each vector gets one more component that
brings all to the same norm, each query a zero, so that the nearest vector is the one of the largest product."""

from __future__ import annotations

import heapq
import math
import pickle
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table
from millrace.llm.embedding_dedup import usable

#: Vectors in a shard; neighbours kept on upper layers (twice that on the lowest); breadth of the search when building and asking.
SHARD, LINKS, BUILD, BREADTH = 8192, 14, 56, 140
#: Queries that meet a copy of a shard's graph at once; of these, so many walk it in step, each from its WIDE best nodes at a time.
BLOCK, STEP, WIDE = 8192, 512, 8
#: Nodes are inserted in step too, at most STEP_BUILD and no more than a tenth of those that are there; each also meets MATES of its step.
STEP_BUILD, MATES = 256, 16
#: Tasks that groups are dealt over, at most: a group is little data and much work, which must not be coalesced.
TASKS = 2000


class Graph:
    """ids of equal vectors are one node. near[layer][row]: neighbours of the node in that row, -1 beyond the last;
    rows[layer]: each node's row on that layer, -1 if it isn't there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, links: int = LINKS, build: int = BUILD):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], vectors.dtype if vectors.dtype == np.float64 else np.float32)
        _, first, node = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by_node = np.argsort(node, kind="stable")
        self.ids, self.ends = ids[by_node], np.cumsum(np.bincount(node))
        self.vectors = vectors[first]
        x = self.vectors.astype(np.float64)
        norms = (x * x).sum(1)
        self.x = np.hstack([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)
        n = len(self.x)
        rng = np.random.default_rng(17)
        levels = np.minimum((-np.log(rng.random(n)) / math.log(links)).astype(int), 8)
        self.caps = [2 * links + 8 if layer == 0 else links + 6 for layer in range(levels.max() + 1)]
        self.rows, self.near = [], []
        for layer, cap in enumerate(self.caps):
            there = np.flatnonzero(levels >= layer)
            rows = np.full(n, -1, np.int32)
            rows[there] = np.arange(len(there))
            self.rows.append(rows)
            self.near.append(np.full((len(there), cap), -1, np.int32))
        self.used = [np.zeros(len(a), np.int32) for a in self.near]
        self.seen = np.zeros(n, np.int32)
        self.mark = 0
        self.entry = -1
        self.top = 0
        order, done = rng.permutation(n), 0
        while done < n:
            batch = order[done : done + max(1, min(STEP_BUILD, done // 10))]
            higher = np.flatnonzero(levels[batch] > self.top)
            if self.entry < 0 or len(higher) and higher[0] == 0:  # a new top goes alone
                batch = batch[:1]
                self._insert(int(batch[0]), int(levels[batch[0]]), links, build)
            else:
                batch = batch[: higher[0]] if len(higher) else batch
                self._insert_all(batch, levels[batch], links, build)
            done += len(batch)

    def _walk(self, q: np.ndarray, start: list[int], layer: int, breadth: int) -> list[tuple[float, int]]:
        """The nearest nodes found on a layer: (minus the product, node), best first."""
        self.mark += 1
        x, near, rows, used, seen, mark = self.x, self.near[layer], self.rows[layer], self.used[layer], self.seen, self.mark
        seen[start] = mark
        todo = [(-float(x[v] @ q), v) for v in start]
        best = [(-d, v) for d, v in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, v = heapq.heappop(todo)
            if len(best) >= breadth and d > -best[0][0]:
                break
            row = rows[v]
            new = near[row, : used[row]]
            new = new[seen[new] != mark]
            if not len(new):
                continue
            seen[new] = mark
            products = x[new] @ q
            if len(best) >= breadth:
                better = products > best[0][0]
                new, products = new[better], products[better]
            for p, u in zip(products.tolist(), new.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (p, u))
                elif p > best[0][0]:
                    heapq.heapreplace(best, (p, u))
                else:
                    continue
                heapq.heappush(todo, (-p, u))
        return sorted((-p, v) for p, v in best)

    def _walks(self, q: np.ndarray, start: np.ndarray, layer: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q what _walk finds from its row of start: (products, nodes), best first, -inf and -1 beyond the last."""
        x, near, rows = self.x, self.near[layer], self.rows[layer]
        m, n, cap = len(q), len(x), self.near[layer].shape[1]
        seen, place = np.zeros(m * n, bool), np.zeros(m * n, np.int32)
        best, found = np.full((m, breadth), -np.inf, np.float32), np.full((m, breadth), -1, np.int32)
        todo = np.zeros((m, breadth), bool)
        wide = min(WIDE, breadth)

        def meet(of: np.ndarray, nodes: np.ndarray) -> None:
            """Each of nodes to the row beside it, rows in order."""
            key = of * n + nodes
            place[key] = np.arange(len(key), dtype=np.int32)
            new = ~seen[key] & (place[key] == np.arange(len(key), dtype=np.int32))  # each once
            of, nodes, key = of[new], nodes[new], key[new]
            seen[key] = True
            products = np.einsum("ij,ij->i", x[nodes], q[of])
            better = products > best[of, -1]
            of, nodes, products = of[better], nodes[better], products[better]
            if not len(of):
                return
            hit, first, count = np.unique(of, return_index=True, return_counts=True)
            at = np.repeat(np.arange(len(hit)), count)
            column = breadth + np.arange(len(of)) - first[at]
            size = breadth + int(count.max())
            p, u, t = np.full((len(hit), size), -np.inf, np.float32), np.full((len(hit), size), -1, np.int32), np.zeros((len(hit), size), bool)
            p[:, :breadth], u[:, :breadth], t[:, :breadth] = best[hit], found[hit], todo[hit]
            p[at, column], u[at, column], t[at, column] = products, nodes, True
            top = np.argsort(-p, 1)[:, :breadth]
            best[hit], found[hit], todo[hit] = (np.take_along_axis(y, top, 1) for y in (p, u, t))

        meet(np.repeat(np.arange(m), start.shape[1])[start.ravel() >= 0], start.ravel()[start.ravel() >= 0].astype(np.int64))
        while True:
            ahead = todo & (np.cumsum(todo, 1) <= wide)  # rows are in order, so these are the best
            of, column = np.nonzero(ahead)
            if not len(of):
                return best, found
            todo[of, column] = False
            nodes = near[rows[found[of, column]]]
            there = nodes.ravel() >= 0
            meet(np.repeat(of, cap)[there], nodes.ravel()[there].astype(np.int64))

    def _insert_all(self, batch: np.ndarray, levels: np.ndarray, links: int, build: int) -> None:
        """Nodes whose levels are not above the top, in step: each meets the graph as it is, and the nearest of its own step."""
        q, start = self.x[batch], np.full((len(batch), 1), self.entry, np.int64)
        chosen = []
        for layer in range(self.top, -1, -1):
            goes, there = np.flatnonzero(levels < layer), np.flatnonzero(levels >= layer)
            after = np.full((len(batch), build), -1, np.int64)
            if len(goes):
                after[goes, :1] = self._walks(q[goes], start[goes], layer, 1)[1]
            if len(there):
                products, nodes = self._walks(q[there], start[there], layer, build)
                after[there] = nodes
                mates = q[there] @ q[there].T
                np.fill_diagonal(mates, -np.inf)
                top = np.argsort(-mates, 1)[:, : min(MATES, len(there) - 1)]
                p = np.hstack([products, np.take_along_axis(mates, top, 1)])
                u = np.hstack([nodes, batch[there][top]])
                order = np.argsort(-p, 1, kind="stable")
                p, u = np.take_along_axis(p, order, 1), np.take_along_axis(u, order, 1)
                for v, a, b in zip(batch[there].tolist(), p, u, strict=True):
                    chosen.append((v, layer, self._spread(v, b[a > -np.inf].tolist(), links)))
            start = after
        own = set(batch.tolist())
        for v, layer, others in chosen:
            for u in others:
                if u not in own:
                    self._link(v, u, layer)
                    self._link(u, v, layer)
                    continue
                for a, b in ((u, v), (v, u)):  # mates may have chosen each other
                    if b not in self.near[layer][self.rows[layer][a]]:
                        self._link(a, b, layer)

    def _spread(self, v: int, found: list[int], most: int) -> list[int]:
        """Of the nodes found, nearest first: those nearer to v than to any kept before; filled up with the nearest others."""
        if len(found) <= most:
            return found
        y = self.x[found]
        to_v, among = y @ self.x[v], y @ y.T
        kept: list[int] = []
        worst = np.full(len(found), -np.inf, np.float32)
        for i in range(len(found)):
            if worst[i] < to_v[i]:
                kept.append(i)
                if len(kept) == most:
                    break
                np.maximum(worst, among[i], out=worst)
        if len(kept) < most:
            chosen = set(kept)
            kept += [i for i in range(len(found)) if i not in chosen][: most - len(kept)]
        return [found[i] for i in kept]

    def _link(self, v: int, u: int, layer: int) -> None:
        row, near, used = self.rows[layer][v], self.near[layer], self.used[layer]
        if used[row] == near.shape[1]:
            held = near[row].tolist() + [u]
            products = self.x[held] @ self.x[v]
            held = [held[i] for i in np.argsort(-products, kind="stable").tolist()]
            kept = self._spread(v, held, near.shape[1] - 6)
            near[row, : len(kept)] = kept
            near[row, len(kept) :] = -1
            used[row] = len(kept)
        else:
            near[row, used[row]] = u
            used[row] += 1

    def _insert(self, v: int, level: int, links: int, build: int) -> None:
        if self.entry < 0:
            self.entry, self.top = v, level
            return
        q, start = self.x[v], [self.entry]
        for layer in range(self.top, level, -1):
            start = [self._walk(q, start, layer, 1)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            start = [u for _, u in self._walk(q, start, layer, build)]
            for u in self._spread(v, start, links):
                self._link(v, u, layer)
                self._link(u, v, layer)
        if level > self.top:
            self.entry, self.top = v, level

    def search(self, query: np.ndarray, k: int, breadth: int = BREADTH) -> list[tuple[float, int]]:
        """(product in double precision, id) of the k best found, ties to the smaller id; equal vectors count each."""
        return next(self.search_all(query[None, :], [k], breadth))

    def search_all(self, queries: np.ndarray, ks: list[int], breadth: int = BREADTH):
        """What search finds for each of the queries, each with its own k."""
        for lo in range(0, len(queries), STEP):
            part, most = queries[lo : lo + STEP], ks[lo : lo + STEP]
            q = np.hstack([part, np.zeros((len(part), 1))]).astype(np.float32)
            start = np.full((len(part), 1), self.entry, np.int64)
            for layer in range(self.top, 0, -1):
                start = self._walks(q, start, layer, 1)[1]
            for query, nodes, k in zip(part, self._walks(q, start, 0, max(breadth, *most))[1], most, strict=True):
                nodes = nodes[nodes >= 0]
                exact = self.vectors[nodes].astype(np.float64) @ query.astype(np.float64)
                out = []
                for v, score in zip(nodes.tolist(), exact.tolist(), strict=True):
                    ids = self.ids[self.ends[v - 1] if v else 0 : self.ends[v]][:k]
                    out += [(score, i) for i in ids.tolist()]
                yield heapq.nsmallest(k, out, key=lambda x: (-x[0], x[1]))

    def to_bytes(self) -> bytes:
        return pickle.dumps({k: v for k, v in self.__dict__.items() if k != "seen"}, protocol=5)

    @classmethod
    def from_bytes(cls, data: bytes) -> Graph:
        out = cls.__new__(cls)
        out.__dict__.update(pickle.loads(data))
        out.seen = np.zeros(len(out.x), np.int32)
        out.mark = 0
        return out


def build(vectors: DataFrame, shards: int) -> DataFrame:
    """(shard, graph) over (vec_id, embedding), dealt out by a hash of vec_id."""

    def of_shard(key, t):
        x = t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([Graph(t["vec_id"].to_numpy(), x).to_bytes()], pa.binary())], names=["shard", "graph"])

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(4 * shards, TASKS), "shard")
    return cut(dealt.groupBy("shard").applyInArrow(of_shard, "shard int, graph binary"))


def nearest(queries: DataFrame, graphs: DataFrame, shards: int, k: int = 20, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found over all shards, without the query's own id.

    Each block of queries meets each shard's graph in a group of its own; the shards' best are merged by a window per query,
    over at most k rows of each shard."""
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def ask(left, right):
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            graph = Graph.from_bytes(right["graph"][0].as_py())
            x = left["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(left.num_rows, -1)
            asking = left["vec_id"].to_numpy()
            ids = np.sort(graph.ids)
            own = np.searchsorted(ids, asking, "right") - np.searchsorted(ids, asking, "left")
            for query_id, found in zip(asking.tolist(), graph.search_all(x, (k + own).tolist(), breadth), strict=True):
                rows += [(query_id, i, s) for s, i in found if i != query_id][:k]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [(), (), ()], (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    tasks = min(4 * shards * blocks, TASKS)
    asked, copies = (x.repartition(tasks, "shard", "block") for x in (asked, copies))
    found = asked.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(ask, "query_id long, vec_id long, score double")
    return best_of(found, k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, breadth: int = BREADTH) -> DataFrame:
    """The k nearest found of each row whose vec_id is divisible by `every`, among all other rows.

    Vectors that cannot be compared (see embedding_dedup.usable) are neither queries nor candidates; the others are
    candidates for queries of their own length. Repeated vectors are candidates each; of rows that share a query's vec_id
    the least of each length asks and none is a candidate, and of candidates that share a vec_id each row counts. With fewer
    candidates than k all are returned; an empty table gives no rows; other columns are not read."""
    fine, lengths = usable(vectors)
    fine = cut(fine)
    found = []
    for n in lengths:
        of_length = fine.where(F.size("embedding") == n)
        shards = max(1, math.ceil(of_length.count() / shard))
        queries = of_length.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        found.append(nearest(queries, build(of_length, shards), shards, k, breadth))
    if len(found) == 1:
        return found[0]
    every_one = reduce(DataFrame.unionByName, found) if found else fine.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return best_of(every_one.drop("rank"), k)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query and rank: query_id, rank, vec_id and score. Edge cases: see search_all."""
    return search_all(table(spark, sf_dir, "embeddings"))
