"""Exact Jaccard join of documents on their word 5-shingles, skipping by set relations.

Sets are reduced in three exact steps. Equal sets are one class. Prefix lists keep, for each shingle, the sets that have it
among their first fifth in one fixed order; a set and the first set of its lists are compared, and those that link form a
cluster around that centre. Then whole clusters are compared by their centres: Jaccard distance is a metric, so that from
the answers for two centres those for all their members follow, unless the centres are close; only then are members
compared, skipping by length, by position in the list, by the number of lists shared and by their distances to their centres."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowtext import batches, lean, slices
from millrace.llm.common import components, cut, discard, lookup, named, salted, snug, stored, table
from millrace.llm.textsets import shingles, words

K, PERCENT = 5, 80
#: Shingles that a sample of one document in EVERY shows at least SEEN times come last in the order, at most FREQUENT of them.
#: One fraction for all sizes, so that lists do not grow with the table. The order decides how much is compared, never what is found.
EVERY, SEEN, FREQUENT = 16, 2, 1 << 19
#: Up to so many ids of sets to compare are sent to all executors; more are joined by a shuffle.
SENT = 300_000


def sets_of(batch: pa.RecordBatch, column: str = "text"):
    """(row, sorted distinct shingle hashes) of every row of a batch."""
    for lo, hi, data, offsets in slices(batch[column]):
        hashes, _, _, first = words(data, offsets)
        for row in range(lo, hi):
            yield row, np.unique(shingles(hashes[first[row - lo] : first[row - lo + 1]], K))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles that are frequent in a sample, rarest first, as signed hashes."""

    def run(it):
        for batch in batches(it, 500):
            found = [s for _, s in sets_of(batch)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["s"])

    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(EVERY)) == 0).select("text").mapInArrow(lean(run), "s long")
    top = drawn.groupBy("s").count().where(F.col("count") >= SEEN).orderBy(F.desc("count"), "s").limit(FREQUENT)
    return top.toArrow()["s"].to_numpy()[::-1].copy()


def signatures(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(doc_id, n, fp, prefix): size, 128-bit fingerprint and first shingles, in the order, of each document's set."""
    held = docs.sparkSession.sparkContext.broadcast((np.sort(last.view(np.uint64)), np.argsort(last.view(np.uint64))))  # FREQUENT at most

    def run(it):
        keys, ranks = held.value
        for batch in batches(it, 1000):
            ns, fps, prefixes = [], [], []
            for _, s in sets_of(batch):
                n = len(s)
                ns.append(n)
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if n else None)
                length = n - (PERCENT * n + 99) // 100 + 1 if n else 0
                if len(keys) and n:
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    late = keys[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(ranks[at[late]])]])
                prefixes.append(s[:length].view(np.int64))
            values = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ns, pa.int32()), pa.array(fps, pa.string()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "n", "fp", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n int, fp string, prefix array<long>")


def shared_entries(classes: DataFrame, last: np.ndarray) -> tuple[DataFrame, str]:
    """(s, node, n, rest) of prefix entries whose shingle is in the prefixes of several sets; rest counts the set's shingles from there on; and where they are stored.

    Frequent shingles are shared anyway and stay where they are, so that no list of theirs meets in a task."""
    keys = np.sort(last)
    held = classes.sparkSession.sparkContext.broadcast(keys)
    entries = classes.select("node", "n", F.posexplode("prefix").alias("pos", "s")).select("s", "node", "n", (F.col("n") - F.col("pos")).alias("rest"))

    def split(frequent: bool):
        def run(it):
            for batch in it:
                s = batch["s"].to_numpy()
                known = held.value
                late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                yield batch.filter(pa.array(late == frequent))

        return run

    def shared(it):
        t = pa.Table.from_batches(list(it)) if (it := list(it)) else None
        if t is None or not t.num_rows:
            return
        s, node = t["s"].to_numpy(), t["node"].to_numpy()
        order = np.lexsort((node, s))
        s, node = s[order], node[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        run = np.cumsum(new) - 1
        several = np.zeros(run[-1] + 1, bool)
        several[run[1:][(s[1:] == s[:-1]) & (node[1:] != node[:-1])]] = True
        yield from t.take(pa.array(order[several[run]])).combine_chunks().to_batches(max_chunksize=50_000)

    schema = "s long, node long, n int, rest int"
    rare = entries.mapInArrow(lean(split(False)), schema).repartition(F.col("s")).mapInArrow(lean(shared), schema)
    return stored(rare.unionByName(entries.mapInArrow(lean(split(True)), schema)), "entries")


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with o, na and nb: sizes of the intersection and of the two documents' sets, from their whole texts.

    Up to SENT pairs are read by one task, before and after; their sets are spread in any case."""
    pairs, few = snug(cut(pairs), SENT)

    def run(it):
        for batch in batches(it, 1000):
            found = [s.tobytes() for _, s in sets_of(batch)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.binary())], names=["node", "set"])

    def sets(of: str) -> DataFrame:
        ids = pairs.select(F.col(of).alias("doc_id")).distinct()
        if not few:
            ids = cut(ids)
        ids = F.broadcast(ids) if few or ids.count() <= SENT else ids  # SENT ids at most
        return docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(lean(run), "node long, set binary").withColumnsRenamed({"node": of, "set": f"set_{of}"})

    # hot centres are found on the bare pairs, so that sets move only once
    spread, copies, on = salted(pairs, sets("a"), "a")
    both = spread.join(sets("b"), "b").join(copies, on)
    names = pairs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def count(it):
        for batch in batches(it, 2000):
            o, na, nb = [], [], []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                na.append(len(x))
                nb.append(len(y))
                at = np.searchsorted(x, y)
                o.append(int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], *[pa.array(v, pa.int32()) for v in (o, na, nb)]], names=[*names, "o", "na", "nb"])

    out = cut(both.select(*names, "set_a", "set_b").mapInArrow(lean(count), f"{types}, o int, na int, nb int"))
    return out.coalesce(1) if few else out


LINKED = "100L * o >= 80L * (na + nb - o)"


def enough(c: str, n: str, m: str) -> Column:
    """Whether sets of n and m shingles that share c in their prefixes can link at all.

    All shared shingles up to the smaller of the prefixes' last ones are in both prefixes; so one set's rest bounds the others."""
    rest = F.greatest(*[F.floor((PERCENT * F.col(x) + 99) / 100) - 1 for x in (n, m)])
    return 9 * (F.col(c) + rest) >= 4 * (F.col(n) + F.col(m))


def parted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose nodes are in different components by roots (node, component)."""
    out = pairs
    for of in ("a", "b"):
        out = lookup(out, roots.withColumnsRenamed({"node": of, "component": f"_{of}"}), of, "left")
    return out.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(*pairs.columns)


def links(classes: DataFrame, docs: DataFrame, last: np.ndarray) -> DataFrame:
    """(a, b) links that connect exactly what the links of all pairs of classes (node, n, prefix) connect."""
    spark = classes.sparkSession
    entries, at_entries = shared_entries(classes, last)
    # clusters: each set against the first set of its lists that it shares most with
    firsts = entries.groupBy("s").agg(F.min(F.struct("node", "n")).alias("f")).select("s", F.col("f.node").alias("first"), F.col("f.n").alias("nf"))
    met = lookup(entries, firsts.hint("merge"), "s").where("node != first").groupBy("node", "first").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("nf").alias("nf"))
    alike = (PERCENT * F.col("n") <= 100 * F.col("nf")) & (PERCENT * F.col("nf") <= 100 * F.col("n"))
    # a quarter of the shorter prefix: what misses it here is met as a cluster of its own below
    met = met.where(alike & enough("c", "n", "nf") & (4 * 100 * F.col("c") >= (100 - PERCENT) * F.least("n", "nf")))
    best = met.groupBy("node").agg(F.max(F.struct("c", (-F.col("first")).alias("k"))).alias("m")).select(F.col("node").alias("b"), (-F.col("m.k")).alias("a"))
    answers = compare(best, docs)
    close = answers.where(LINKED)
    known = close.select(F.col("b").alias("node"), F.col("a").alias("centre"), (1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).alias("d"))
    edges = close.select("a", "b")
    roots = components(edges, held=True)
    of = known.join(roots, "node", "full").select("node", F.coalesce("centre", "node").alias("centre"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("component"))
    placed = entries.join(of, "node", "left").select("s", "node", "n", "rest", F.coalesce("centre", "node").alias("centre"), F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("component"))
    shared = known.select("centre").distinct().withColumn("alone", F.lit(False))
    placed, at_placed = stored(placed.join(shared, "centre", "left").withColumn("alone", F.coalesce("alone", F.col("centre") == F.col("node"))), "placed")
    discard(spark, at_entries)
    # lists of clusters; only those that meet another component matter
    lists = placed.groupBy("s", "centre", "component").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.min("alone").alias("alone"))
    mixed = lists.groupBy("s").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("s")
    lists, at_lists = stored(lists.join(mixed.hint("merge"), "s", "left_semi"), "lists")
    x, y = lists.alias("x"), lists.alias("y")
    may = (
        (F.col("x.centre") < F.col("y.centre"))
        & (F.col("x.component") != F.col("y.component"))
        & (100 * F.col("x.most") >= PERCENT * F.col("y.least"))
        & (100 * F.col("y.most") >= PERCENT * F.col("x.least"))
    )
    early = 9 * F.least("x.rest", "y.rest") >= 4 * (F.col("x.least") + F.col("y.least"))  # in some list, if the sets link
    both = x.join(y.hint("merge"), (F.col("x.s") == F.col("y.s")) & may)
    counted = both.groupBy(F.col("x.centre").alias("a"), F.col("y.centre").alias("b")).agg(F.count("*").alias("c"), F.max("x.most").alias("n"), F.max("y.most").alias("m"), F.min(F.col("x.alone") & F.col("y.alone")).alias("alone"), F.max(early).alias("early"))
    centres, _ = snug(cut(counted.where(F.col("early") & (~F.col("alone") | enough("c", "n", "m"))).select("a", "b")), SENT)
    discard(spark, at_lists)
    told = answers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o", "na", "nb")
    fresh = compare(centres.join(told, ["a", "b"], "left_anti"), docs)
    answers, _ = snug(cut(fresh.unionByName(centres.join(told, ["a", "b"]).select("a", "b", "o", "na", "nb"))), SENT)
    edges = edges.unionByName(answers.where(LINKED).select("a", "b"))
    # members at d1 and d2 from centres that are gap apart can only link if gap - d1 - d2 <= 1 - PERCENT / 100, for d1, d2 <= 1 - PERCENT / 100
    near = answers.withColumn("gap", 1 - F.col("o") / (F.col("na") + F.col("nb") - F.col("o"))).where(F.col("gap") <= 3 * (1 - PERCENT / 100) + 1e-9).select("a", "b", "gap")
    joined = components(edges, held=True)
    # a member is linked to its centre and so in its component: centres that are connected by now have nothing left to find
    near, _ = snug(cut(parted(near, joined)), SENT)
    comp = F.coalesce("component", "node")
    now = placed.drop("component").join(joined, "node", "left").withColumn("component", comp)
    touched, _ = snug(cut(near.select(F.explode(F.array("a", "b")).alias("centre")).distinct()), SENT)
    now = now.join(touched, "centre", "left_semi")
    # two sets whose last shared shingles before this one are the same have met in that one's list: this block of places is skipped
    now, at_now = stored(now.withColumn("before", F.lag("s").over(Window.partitionBy("node").orderBy(F.desc("rest")))), "now")
    discard(spark, at_placed)
    # of two near clusters the one with fewer entries goes to the other's lists
    entries_of, _ = snug(cut(now.groupBy("centre").agg(F.count("*").alias("n"))), SENT)
    for of in ("a", "b"):
        near = lookup(near, entries_of.hint("merge").withColumnsRenamed({"centre": of, "n": f"n_{of}"}), of)
    turned = F.col("n_a") > F.col("n_b")
    near = near.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "gap")
    left = now.join(cut(near).hint("merge"), "centre")
    u, v = left.alias("u"), now.alias("v")
    on = (
        (F.col("u.s") == F.col("v.s"))
        & (F.col("u.b") == F.col("v.centre"))
        & (F.col("u.component") != F.col("v.component"))
        & (F.col("u.gap") - F.col("u.d") - F.col("v.d") <= 1 - PERCENT / 100 + 1e-9)
        & (9 * F.least("u.rest", "v.rest") >= 4 * (F.col("u.n") + F.col("v.n")))
        & ~F.coalesce(F.col("u.before") == F.col("v.before"), F.lit(False))
    )
    members = u.join(v.hint("merge"), on).select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct()
    more = compare(members.join(answers.select("a", "b"), ["a", "b"], "left_anti"), docs)
    discard(spark, at_now)
    return edges.unionByName(more.where(LINKED).select("a", "b"))


def join_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, class_id (smallest doc_id with the same set) and component_id (smallest doc_id reachable).

    Two documents link when 100 * intersection >= 80 * union of their sets; nothing but words in lower case counts. Null,
    empty and blank texts have no shingles, no links and are their own component. Rows that share a doc_id are linked; a
    null doc_id has a null component, though it is counted. An empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = frequent_shingles(rows)
    marked = cut(signatures(rows, last))
    full = marked.where("fp is not null and doc_id is not null")
    # the one shuffle that the prefixes make: to a row for each set
    nodes = cut(full.groupBy("fp").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("m")).select("fp", F.col("m.doc_id").alias("node"), F.col("m.n").alias("n"), F.col("m.prefix").alias("prefix")))
    classes = nodes.select("fp", "node")
    roots = components(links(nodes, rows, last), held=True)
    by_class = classes.join(roots, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component"))
    found = lookup(full.select("fp", "doc_id", "n"), by_class, "fp").select("doc_id", "n", "node", "component")
    rest = marked.where("fp is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    out = found.unionByName(rest)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("node").alias("class_id"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates the document with the smallest doc_id stays, with all its columns.

    Rows that share that doc_id all stay, and so do those with a null doc_id or without words. An empty table gives no rows."""
    gone = join_documents(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*named(docs.columns))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id and component_id. Edge cases: see join_documents."""
    return join_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "class_id", "component_id")
