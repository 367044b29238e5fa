"""Packing documents into as few training sequences as possible: dominance reduction, then best fit.

An instance is the number of pieces of each length, at most 2048 numbers whatever the size of the corpus. It is solved
exactly so, on the driver; the pieces then find their places by their rank among the pieces of their length."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowtext import batches, lean
from millrace.llm.common import cut, table
from millrace.llm.wordtokens import coder

CAPACITY, END, BUCKETS = 2048, 0, 256


class Instance:
    """Counts of each length; patterns taken from it: (times, [(length, how many), ...])."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.counts = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.counts[length] += n
        self.patterns: list[tuple[int, list[tuple[int, int]]]] = []

    def largest(self, most: int, without: tuple = ()) -> int:
        """The largest length of at most `most` that is left, besides those listed; 0 if none is."""
        for length in range(min(most, self.capacity), 0, -1):
            if self.counts[length] > without.count(length):
                return length
        return 0

    def fix(self, times: int, lengths: list[int]) -> None:
        held = defaultdict(int)
        for x in lengths:
            held[x] += 1
        for x, n in held.items():
            self.counts[x] -= n * times
        self.patterns.append((times, sorted(held.items(), reverse=True)))

    def times(self, lengths: list[int]) -> int:
        return min(int(self.counts[x]) // lengths.count(x) for x in set(lengths))

    def smallest(self, n: int, without: int) -> list[int]:
        """The n smallest lengths left besides one piece of length `without`."""
        out: list[int] = []
        for length in np.flatnonzero(self.counts):
            have = int(self.counts[length]) - (length == without)
            out += [int(length)] * min(have, n - len(out))
            if len(out) >= n:
                break
        return out

    def best_pair(self, room: int, without: int) -> tuple[int, int]:
        """Two lengths left, besides one piece of `without`, of the largest sum of at most room."""
        have = self.counts.copy()
        have[without] -= 1
        best = (0, 0)
        for x in np.flatnonzero(have > 0):
            x = int(x)
            if 2 * x > room:
                break
            for y in range(room - x, x - 1, -1):
                if y <= self.capacity and have[y] > (x == y):
                    if x + y > sum(best):
                        best = (y, x)
                    break
        return best

    def reduce(self) -> None:
        """Martello and Toth's reduction: from the longest piece down, the sets that dominate all others with that piece
        are fixed. Sets of up to three pieces are looked at; as many equal ones are fixed at once as there are."""
        for length in range(self.capacity, 0, -1):
            while self.counts[length] > 0:
                room = self.capacity - length
                mate = self.largest(room, (length,))
                if not mate:  # nothing goes with it
                    self.fix(1 if 2 * length <= self.capacity else int(self.counts[length]), [length])
                    continue
                few = self.smallest(3, length)
                k = sum(int(total <= room) for total in np.cumsum(few))  # how many more pieces fit at all
                if mate == room or k <= 1:
                    self.fix(max(1, self.times([length, mate])), [length, mate])
                    continue
                if k == 2:
                    a, b = self.best_pair(room, length)
                    if mate >= a + b:
                        self.fix(max(1, self.times([length, mate])), [length, mate])
                        continue
                    larger = [int(x) for x in np.flatnonzero(self.counts[b + 1 :])[:2] + b + 1]
                    larger = larger[:1] * 2 if larger and self.counts[larger[0]] - (larger[0] == length) > 1 else larger
                    if mate == a and (len(np.flatnonzero(self.counts[b : a + 1])) <= 2 or sum(larger) > room):
                        self.fix(max(1, self.times([length, a, b])), [length, a, b])
                        continue
                break

    def best_fit(self) -> None:
        """Best fit, longest first, of what is left; bins that hold the same are handled as one group."""
        groups: dict[int, list] = defaultdict(list)  # by room left: [times, contents]
        for length in range(self.capacity, 0, -1):
            n = int(self.counts[length])
            while n:
                room = next((r for r in range(length, self.capacity) if groups.get(r)), None)
                if room is None:
                    times, held, room = n, (), self.capacity
                else:
                    times, held = groups[room].pop()
                fit = room // length
                whole = min(times, n // fit)
                if whole:
                    groups[room - fit * length].append((whole, (*held, (length, fit))))
                    n -= whole * fit
                if whole < times and held:
                    rest = times - whole
                    if n and n < fit:
                        groups[room - n * length].append((1, (*held, (length, n))))
                        n, rest = 0, rest - 1
                    if rest:
                        groups[room].append((rest, held))
                elif not held and n and n < fit:
                    groups[room - n * length].append((1, ((length, n),)))
                    n = 0
            self.counts[length] = 0
        for of_room in groups.values():
            self.patterns += [(times, list(held)) for times, held in of_room]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the best over k of Martello and Toth's bound L2."""
    n = np.zeros(capacity + 1, np.int64)
    for length, times in counts.items():
        n[length] += times
    total, size = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    best = -(-int(size[capacity]) // capacity)
    for k in range(1, capacity // 2 + 1):
        big = int(total[capacity] - total[capacity - k])
        middle, middle_size = int(total[capacity - k] - total[capacity // 2]), int(size[capacity - k] - size[capacity // 2])
        small = int(size[capacity // 2] - size[k - 1])
        best = max(best, big + middle + max(0, -(-(small - (middle * capacity - middle_size)) // capacity)))
    return best


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, how many), ...]) that hold all pieces."""
    instance = Instance(counts, capacity)
    instance.reduce()
    instance.best_fit()
    return instance.patterns


def places(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, sorted by first rank: (first rank, pieces to a sequence, first sequence, offset there)."""
    rank: dict[int, int] = defaultdict(int)
    runs: dict[int, list] = defaultdict(list)
    sequence = 0
    for times, held in patterns:
        offset = 0
        for length, n in held:
            runs[length].append((rank[length], n, sequence, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond the capacity."""

    def run(it):
        tokens = coder(tokenizer)
        for batch in batches(it, 2000):
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.batch(batch["text"]), strict=True):
                ids = np.append(ids, end).astype("<u4")
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    out.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence.

    Ranks within a length come from counts by length and bucket and a window inside each, so that a length that a third of
    all pieces have is spread over BUCKETS groups. A null text is empty and has the end id only; a null doc_id is an id
    like others; repeated rows are packed each for itself, and equal pieces may change places; an empty table gives no
    rows. Other columns are not read."""
    cuts = cut(pieces(docs, tokenizer, capacity, end).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")))
    by_bucket = cut(cuts.groupBy("length", "bucket").agg(F.count("*").alias("n")))  # capacity * BUCKETS rows at most
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cuts.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).drop("base", "bucket")
    where = places(solve(counts, capacity))

    def place(it):
        for batch in it:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                first, n, base, start = where[int(length)]
                run = np.searchsorted(first, ranks[here], "right") - 1
                beyond = ranks[here] - first[run]
                sequence[here], offset[here] = base[run] + beyond // n[run], start[run] + beyond % n[run] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document goes. Nulls, repeated rows and empty tables: see pack."""
    return pack(docs, word_vocabulary())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: where it goes. Columns and edge cases: see pack."""
    return pack(table(spark, sf_dir, "documents"), word_vocabulary())
