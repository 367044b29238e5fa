"""Passages that repeat across documents, by MinHash banding of paragraphs and by windows of words.

Lines of LONG words or more are compared as sets of five-word shingles: bands tuned for recall give candidates, exact Jaccard
decides, components cluster. So that a passage is also met in the middle of lines, every run of RUN words that an earlier
document has too is removed, wherever it stands: each such window has the same least gram of GRAM words in both documents,
so that only windows whose least gram is shared need to be compared. The document with the smallest doc_id keeps each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowtext import batches, lean, slices
from millrace.llm.common import components, cut, discard, lookup, release, stored, table
from millrace.llm.textsets import STEPS, mix, powers, shingles, words

K, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.999, 32
#: Words of a line that is compared as a whole; words of a gram that can stand for a window; words of a window.
LONG, GRAM, RUN = 5, 8, 24
#: Up to so many ids of lines to verify are sent to all executors; more are joined by a shuffle.
SENT = 300_000
#: Bytes of shingles on either side of a comparison inside a bucket; shingles whose MinHashes are made at once.
TILE, CHUNK = 2 << 20, 1 << 14
#: Shingles in common that are counted at once.
MATCHES = 1 << 20


def tune(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) of the most selective banding with so many hashes that meets pairs at the threshold with this recall."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


BANDS, ROWS = tune()
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def span_hashes(hw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the words a to b - 1 of each span."""
    up, down = powers(len(hw) + 1)
    sums = np.zeros(len(hw) + 1, np.uint64)
    np.cumsum(hw * up[: len(hw)], out=sums[1:])
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * STEPS[2])


def windows(hw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of RUN words of one text, and that of the least gram in it."""
    n = len(hw)
    if n < RUN:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    least, width = span_hashes(hw, at, at + GRAM), 1
    while width < RUN - GRAM + 1:
        step = min(width, RUN - GRAM + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = at[: n - RUN + 1]
    return span_hashes(hw, at, at + RUN), least


def phrases(hw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, first window, window after the last, gram, hash) of the phrases of one text: runs of windows with one least gram.

    A phrase's hash is that of all its words, so that equal phrases have the same windows."""
    w, least = windows(hw)
    edges = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]])) if len(w) else np.zeros(1, np.int64)
    a, b = edges[:-1], edges[1:]
    return w, a, b, least[a], span_hashes(hw, a, b + RUN - 1) if len(a) else np.zeros(0, np.uint64)


def distinct_windows(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of each of some phrases a to b - 1, one phrase after the other, and how many each has."""
    n = b - a
    every = w[np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    if len(np.unique(every)) == len(every):  # as in most texts
        return every, n
    own = [np.unique(w[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    return np.concatenate(own), np.array([len(x) for x in own])


class Slice:
    """Words of some whole texts of a batch, rows lo to hi - 1, and their lines of LONG words or more: row, words a to b - 1, hash."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.offsets = lo, hi, offsets
        self.hw, self.start, self.end, self.first = words(data, offsets)
        line = np.cumsum(data == 10, dtype=np.int32)[self.start] if len(self.start) else np.zeros(0, np.int32)
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        new[self.first[self.first < len(line)]] = True
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(line))[: len(a)]
        long = b - a >= LONG
        self.a, self.b = a[long], b[long]
        self.row = lo + np.searchsorted(self.first, self.a, "right") - 1
        self.h = span_hashes(self.hw, self.a, self.b) if len(self.a) else np.zeros(0, np.uint64)

    def texts(self):
        """(row, hashes, starts and ends of its words in its own bytes) of each text."""
        for row in range(self.lo, self.hi):
            a, b = self.first[row - self.lo], self.first[row - self.lo + 1]
            base = self.offsets[row - self.lo]
            yield row, self.hw[a:b], self.start[a:b] - base, self.end[a:b] - base

    def bands(self) -> np.ndarray:
        """The bucket of each line in each band, from whole lines, CHUNK shingles at a time."""
        if not len(self.a):
            return np.zeros((0, BANDS), np.int64)
        n = len(self.hw) - K + 1
        sh = np.full(n, np.uint64(K), np.uint64)
        for j in range(K):
            sh += self.hw[j : n + j] * STEPS[j]
        sh = mix(sh)
        number = self.b - self.a - K + 1
        pieces = -(-number // CHUNK)  # of a line
        first = np.cumsum(pieces) - pieces
        of = np.repeat(np.arange(len(number)), pieces)
        begin = self.a[of] + (np.arange(len(of)) - first[of]) * CHUNK
        size = np.minimum(CHUNK, self.a[of] + number[of] - begin)
        least = np.empty((len(of), BANDS * ROWS), np.uint64)
        ends = np.cumsum(size)
        i = 0
        while i < len(of):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK, "right")))
            at = np.cumsum(size[i:j]) - size[i:j]
            where = np.repeat(begin[i:j] - at, size[i:j]) + np.arange(int(size[i:j].sum()))
            least[i:j] = np.minimum.reduceat(sh[where][:, None] * FACTORS, at, axis=0)
            i = j
        least = np.minimum.reduceat(least, first, axis=0).reshape(-1, BANDS, ROWS)
        return mix((least * STEPS[:ROWS]).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sliced(batch: pa.RecordBatch, column: str = "text"):
    for part in slices(batch[column]):
        yield Slice(*part)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def rows_of_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, bands) of all lines of LONG words or more."""

    def lines(it):
        for batch in it:
            ids = batch["doc_id"].to_numpy()
            for part in sliced(batch):
                bands = part.bands()
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.row]), signed(part.h), listed], names=["doc_id", "h", "bands"])

    return docs.mapInArrow(lean(lines), "doc_id long, h long, bands array<long>")


def rows_of_grams(docs: DataFrame) -> DataFrame:
    """(doc_id, g): the least grams of all windows of each document."""

    def run(it):
        for batch in it:
            ids = batch["doc_id"].to_numpy()
            for part in sliced(batch):
                found = [(row, np.unique(windows(hw)[1])) for row, hw, _, _ in part.texts()]
                doc = np.repeat(ids[[r for r, _ in found]], [len(g) for _, g in found])
                yield pa.RecordBatch.from_arrays([pa.array(doc), signed(np.concatenate([g for _, g in found]))], names=["doc_id", "g"])

    return docs.mapInArrow(lean(run), "doc_id long, g long")


def rows_of_phrases(docs: DataFrame) -> DataFrame:
    """(doc_id, g, p, windows) of the phrases whose gram is among the document's shared ones (doc_id, text, shared)."""

    def run(it):
        for batch in it:
            ids, shared = batch["doc_id"].to_numpy(), batch["shared"]
            doc, grams, hashes, held, sizes = [], [], [], [], []
            for part in sliced(batch):
                for row, hw, _, _ in part.texts():
                    w, a, b, g, p = phrases(hw)
                    some = np.flatnonzero(np.isin(g.view(np.int64), shared[row].values.to_numpy()))
                    _, once = np.unique(p[some], return_index=True)
                    own, n = distinct_windows(w, a[some[once]], b[some[once]])
                    held.append(own)
                    sizes.append(n)
                    doc.append(np.full(len(once), ids[row]))
                    grams.append(g[some[once]])
                    hashes.append(p[some[once]])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), signed(np.concatenate([np.zeros(0, np.uint64), *held])))
            joined = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((doc, np.int64), (grams, np.uint64), (hashes, np.uint64))]
            yield pa.RecordBatch.from_arrays([*[signed(x) for x in joined], listed], names=["doc_id", "g", "p", "windows"])

    return docs.mapInArrow(lean(run), "doc_id long, g long, p long, windows array<long>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, p, w): the phrases of each document that an earlier one has too, as p, and such single windows of others, as w.

    Equal windows have the same least gram; a gram of one document needs nothing more. Of the documents with one phrase the
    first speaks for its windows, and only where its gram has other phrases too: there windows are compared one by one."""
    grams, at = stored(rows_of_grams(docs), "grams")
    firsts = cut(grams.groupBy("g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("_n")).where("least < most").select("g", "_n"))
    own = cut(lookup(grams, firsts.hint("shuffle_hash"), "g", sized=True).groupBy("doc_id").agg(F.collect_set("g").alias("shared")))  # a document's own
    discard(docs.sparkSession, at)  # the last that reads grams
    release(docs.sparkSession)  # the grams that were dealt out for it
    rows, _ = stored(rows_of_phrases(docs.join(own, "doc_id")), "phrases")
    release(docs.sparkSession)  # the texts
    classes, at_classes = stored(rows.groupBy("p").agg(F.first("g").alias("g"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("_n"), F.first("windows").alias("windows")), "classes")
    again = classes.where("first < last").select("p", "first", "_n")
    whole = lookup(rows.select("doc_id", "p"), again.hint("shuffle_hash"), "p", sized=True).where("doc_id > first").select("doc_id", "p", F.lit(None).cast("long").alias("w"))
    several = classes.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1")
    single, at_single = stored(lookup(classes.select("g", "first", "windows"), several.hint("merge"), "g", sized=True).select("first", F.explode("windows").alias("w")), "single")
    least = single.groupBy("w").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("_n")).where("least < most").select("w", "least", "_n")
    parts = lookup(single, least.hint("merge"), "w", sized=True).where("first > least").select(F.col("first").alias("doc_id"), F.lit(None).cast("long").alias("p"), "w").distinct()
    out, _ = stored(whole.unionByName(parts), "repeated")
    for x in (at_classes, at_single):  # nothing reads them any more
        discard(docs.sparkSession, x)
    return out


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, set): the shingles of the lines with the hashes ids, from the texts, which are read once."""

    def lines(it):
        for batch in it:
            for part in sliced(batch):
                h, at = np.unique(part.h, return_index=True)
                a, n = part.a[at], part.b[at] - part.a[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                held = part.hw[np.repeat(a - ends[:-1], n) + np.arange(int(ends[-1]))]
                packed = pa.Array.from_buffers(pa.large_binary(), len(h), [None, pa.py_buffer((8 * ends).astype(np.int64)), pa.py_buffer(held)])
                yield pa.RecordBatch.from_arrays([signed(h), packed.cast(pa.binary())], names=["h", "words"])

    def sets(it):
        for batch in it:
            found = [np.unique(shingles(np.frombuffer(x.as_buffer(), np.uint64), K)).tobytes() for x in batch["words"]]
            yield pa.RecordBatch.from_arrays([batch["h"], pa.array(found, pa.binary())], names=["h", "set"])

    few = ids.count() <= SENT
    needed = docs.select("text").mapInArrow(lean(lines), "h long, words binary").join(F.broadcast(ids) if few else ids, "h")
    return cut(needed.groupBy("h").agg(F.first("words").alias("words")).mapInArrow(lean(sets), "h long, set binary"))  # equal lines have equal words


def verified(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines, by hash, whose shingles, in needed, have a Jaccard similarity of THRESHOLD or more."""
    both = lookup(pairs.join(needed.withColumnsRenamed({"h": "b", "set": "set_b"}), "b"), needed.withColumnsRenamed({"h": "a", "set": "set_a"}), "a", of=pairs)

    def check(it):
        for batch in it:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                o = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * o >= round(100 * THRESHOLD) * (len(x) + len(y) - o))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return cut(both.select("a", "b", "set_a", "set_b").mapInArrow(lean(check), "a long, b long"))


def links_inside(t: pa.Table) -> pa.Table:
    """(a, b) links between the probes and the members of some buckets or of a part of one, as few as connect what is linked.

    What a probe and a member of another component share is counted from one sorted list of all members' shingles, each with
    its bucket, for as many probes at once as give MATCHES matches."""
    probe = t["probe"].to_numpy(zero_copy_only=False)
    x, y = t.filter(pa.array(probe)), t.filter(pa.array(~probe))
    out: list[tuple[int, int]] = []
    if x.num_rows and y.num_rows:
        sets = [[np.frombuffer(s, np.uint64) for s in of["set"].to_pylist()] for of in (x, y)]
        nx, ny = (np.array([len(s) for s in of]) for of in sets)
        _, bucket = np.unique(np.concatenate([x["key"].to_numpy(), y["key"].to_numpy()]), return_inverse=True)
        kinds, rank = np.unique(np.concatenate([*sets[0], *sets[1]]), return_inverse=True)
        every = rank + np.repeat(bucket, np.concatenate([nx, ny])) * len(kinds)
        mine, others = every[: nx.sum()], every[nx.sum() :]
        order = np.argsort(others, kind="stable")
        others, owner = others[order], np.repeat(np.arange(len(ny)), ny)[order]
        hx, cx, hy, cy = x["h"].to_numpy(), x["component"].to_numpy(), y["h"].to_numpy(), y["component"].to_numpy()
        lo = np.searchsorted(others, mine, "left")
        n = np.searchsorted(others, mine, "right") - lo
        of = np.repeat(np.arange(len(nx)), nx)
        ends, last = np.cumsum(nx), np.cumsum(n)
        joined: set[tuple[int, int]] = set()
        i = 0
        while i < len(nx):
            begin = int(ends[i - 1]) if i else 0
            done = int(last[begin - 1]) if begin else 0
            stop = int(np.searchsorted(last, done + MATCHES, "right"))
            j = max(i + 1, int(np.searchsorted(ends, stop, "right")))
            part = slice(begin, int(ends[j - 1]))
            at = np.repeat(lo[part] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(int(n[part].sum()))
            b, a = owner[at], np.repeat(of[part], n[part])
            apart = cx[a] != cy[b]
            pair, o = np.unique(a[apart] * len(ny) + b[apart], return_counts=True)
            a, b = np.divmod(pair, len(ny))
            linked = (100 * o >= round(100 * THRESHOLD) * (nx[a] + ny[b] - o)) & (hx[a] != hy[b])
            a, b = a[linked], b[linked]
            _, once = np.unique(np.stack([np.minimum(cx[a], cy[b]), np.maximum(cx[a], cy[b])]), axis=1, return_index=True)
            for a1, b1 in zip(a[once].tolist(), b[once].tolist(), strict=True):
                both = (min(cx[a1], cy[b1]), max(cx[a1], cy[b1]))
                if both not in joined:
                    joined.add(both)
                    out.append((int(hx[a1]), int(hy[b1])))
            i = j
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [(), ()])], names=["a", "b"])


def line_links(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) links between lines (h, bands) that meet in a bucket, which connect exactly what the links of all pairs there connect.

    First all lines of a bucket are compared with its smallest. Where a bucket's lines are not all connected then, those
    outside the largest of its components are compared with all others, in tiles of bounded size. So any two lines of a
    bucket are compared or connected; no bucket is emitted in pairs, cut short, or met whole in a task."""
    distinct, at = stored(lines.groupBy("h").agg(F.first("bands").alias("bands")), "bands")  # equal lines have equal bands
    keyed = distinct.select("h", F.explode("bands").alias("key"))
    pivots = keyed.groupBy("key").agg(F.min("h").alias("pivot"), F.max("h").alias("most"), F.count("*").alias("_n")).where("pivot < most").select("key", "pivot", "_n")
    release(docs.sparkSession)  # the bands of all lines
    pivots = cut(pivots)  # takes the name of its plan, whose shuffle, of a row per line and band, stays as long as that is held
    release(docs.sparkSession)
    met = cut(lookup(keyed, pivots.hint("shuffle_hash"), "key", sized=True).select("key", "h", "pivot").distinct())
    discard(docs.sparkSession, at)  # the last that reads bands
    release(docs.sparkSession)
    needed = sets_of(cut(met.select("h").distinct()), docs)
    star = verified(cut(met.where("h != pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b")).distinct()), needed)
    roots = components(star).withColumnRenamed("node", "h")
    placed = met.select("key", "h").join(roots, "h", "left").withColumn("component", F.coalesce("component", "h"))
    mixed = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("parts"), F.sum("n").alias("_n"))
    mixed = cut(mixed.where("parts > 1").select("key", F.col("m.component").alias("largest"), "_n"))
    left = lookup(placed, mixed, "key", sized=True).join(needed, "h").withColumn("probe", F.col("component") != F.col("largest")).drop("largest")
    left = cut(left.select("key", "h", "component", "probe", "set"))
    del placed, met, needed
    release(docs.sparkSession)  # the sets of all candidates
    bytes_of = F.octet_length("set").cast("long")
    tiles = left.groupBy("key").agg(F.ceil(F.sum(bytes_of) / TILE).cast("int").alias("tiles"), F.ceil(F.sum(F.when(F.col("probe"), bytes_of)) / TILE).cast("int").alias("blocks"), F.count("*").alias("_n"))
    tiles = cut(tiles)
    slots = max(1, (tiles.agg(F.sum("tiles")).first()[0] or 0) // 4)
    # small buckets go many to a group
    small = (F.col("tiles") == 1) & (F.col("blocks") == 1)
    dealt = lookup(left, tiles, "key", sized=True).withColumn("slot", F.when(small, F.pmod(F.xxhash64("key"), F.lit(slots))).otherwise(F.col("key")))
    own = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt.withColumn("tile", own("tiles")).withColumn("block", upto("blocks")).withColumn("probe", F.lit(False))
    probes = dealt.where("probe").withColumn("block", own("blocks")).withColumn("tile", upto("tiles"))
    rows = members.unionByName(probes).select("slot", "tile", "block", "key", "h", "component", "probe", "set")
    return star.unionByName(cut(rows.groupBy("slot", "tile", "block").applyInArrow(links_inside, "a long, b long")))


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, p, w, l): hashes of phrases, windows and lines of each document that one of smaller doc_id has too, or nearly for lines."""
    again = repeated_windows(docs)
    lines, _ = stored(rows_of_lines(docs), "lines")
    classes = cut(lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("_n")))
    roots = components(line_links(lines.select("h", "bands"), docs)).withColumnRenamed("node", "h")
    of = cut(classes.join(roots, "h", "left").withColumn("component", F.coalesce("component", "h")))
    spans = of.groupBy("component").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most").select("component", "least")
    known = lookup(of.select("h", "component", "_n"), spans, "component").select("h", "least", "_n")
    near = lookup(lines.select("doc_id", "h"), cut(known).hint("shuffle_hash"), "h", sized=True).where("doc_id > least").select("doc_id", F.col("h").alias("l")).distinct()
    none = F.lit(None).cast("long")
    return again.withColumn("l", none).unionByName(near.select("doc_id", none.alias("p"), none.alias("w"), "l"))


def remove_passages(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed (words), spans (bytes removed) and text without them.

    A null text has no words and stays null; lines of fewer than LONG words go only as part of a longer run; a null doc_id keeps
    all and is not compared with; rows that share a doc_id are one document; texts are taken whole, however long; an empty
    table gives no rows; other columns are not read. Of equal texts only the first document's is compared with others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    there = rows.where("doc_id is not null and text is not null").withColumn("digest", F.md5("text"))
    digests = cut(there.select("doc_id", "digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("_n")).where("least < most").select("digest", "least", "_n")
    copies = cut(lookup(digests, cut(firsts), "digest", sized=True).where("doc_id > least").select("doc_id", "digest").distinct())
    if copies.count() <= SENT:
        known = there.join(F.broadcast(copies), ["doc_id", "digest"], "left_anti").select("doc_id", "text")
    else:  # the texts move once, not in each pass
        known, _ = stored(there.join(copies, ["doc_id", "digest"], "left_anti").select("doc_id", "text"), "texts")
    none = F.lit(None).cast("long")
    units = repeated_units(known).withColumn("d", F.lit(None).cast("string")).unionByName(copies.select("doc_id", none.alias("p"), none.alias("w"), none.alias("l"), F.col("digest").alias("d")))
    release(docs.sparkSession)  # what the units were made from; the texts are dealt out next
    of = units.groupBy("doc_id").agg(F.collect_list("p").alias("phrases"), F.collect_list("w").alias("windows"), F.collect_list("l").alias("lines"), F.collect_list("d").alias("copies"))  # a document's own units
    marked = rows.join(of, "doc_id", "left").withColumn("copy", F.array_contains("copies", F.md5("text")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(it):
        for batch in it:
            copied = batch["copy"].to_pylist()
            told = {c: batch[c] for c in ("phrases", "windows", "lines")}
            listed = lambda c, row: told[c][row].values.to_numpy() if told[c][row].is_valid else np.zeros(0, np.int64)  # noqa: B023, E731
            texts = batch["text"]
            n_words, n_removed, spans, kept = [], [], [], []
            for part in sliced(batch):
                gone_of = np.zeros(len(part.hw), bool)
                of_row = np.searchsorted(part.row, np.arange(part.lo, part.hi + 1))
                for row, hw, start, end in part.texts():
                    n, text = len(hw), texts[row].as_py()
                    base = part.first[row - part.lo]
                    gone = gone_of[base : base + n]
                    here = slice(of_row[row - part.lo], of_row[row - part.lo + 1])
                    h = part.h[here].view(np.int64)
                    hit = np.ones(len(h), bool) if copied[row] else np.isin(h, listed("lines", row))
                    for a, b in zip(part.a[here][hit], part.b[here][hit], strict=True):
                        gone[a - base : b - base] = True
                    single, several = listed("windows", row), listed("phrases", row)
                    if copied[row] and n >= RUN:
                        gone[:] = True
                    elif n >= RUN and len(single) + len(several):
                        w, a, b, _, p = phrases(hw)
                        hit = np.isin(w.view(np.int64), single) | np.repeat(np.isin(p.view(np.int64), several), b - a)
                        begun = np.concatenate([[0], np.cumsum(hit)])
                        i = np.arange(n)  # a word goes if one of the RUN windows that hold it is repeated
                        gone |= begun[np.minimum(i, n - RUN) + 1] > begun[np.maximum(i - RUN + 1, 0)]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    runs = [(int(start[a]), int(start[b]) if b < n else int(end[b - 1])) for a, b in zip(turns[::2], turns[1::2], strict=True)]
                    if runs:
                        data, parts, last = text.encode(), [], 0
                        for a, b in runs:
                            parts.append(data[last:a])
                            last = b
                        text = b"".join([*parts, data[last:]]).decode()
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    spans.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(text)
            arrays = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return marked.select("doc_id", "text", "copy", "phrases", "windows", "lines").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, n_spans and kept_md5. Edge cases: see remove_passages."""
    found = remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.md5("text").alias("kept_md5"))
