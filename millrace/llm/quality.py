"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model that is trained on trusted text.

The n-grams are of ORDER characters, as they are. One pass over all texts gathers every n-gram of the corpus with its count
in the training texts; joins of these counts, sharded by n-gram, context and suffix, give each its probability, and a second
pass adds up the probabilities of each document's n-grams."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.arrowtext import lean
from millrace.llm.common import cut, named, packed, table
from millrace.llm.textsets import STEPS, mix

ORDER = 5
#: Stands before a text, as often as a context is long.
START = "\2"
#: Every labelled document of quality 1 that is not toxic is trusted. One in HELD of them is held out of the training; its
#: perplexities give the thresholds. Up to JOINED ids of trusted documents go to all executors; more meet the texts in a shuffle.
HELD, JOINED = 5, 200_000
#: Documents beyond these quantiles of their language's held-out documents are rejected: noise above, endless repetition below.
#: Languages with fewer than MIN_HELD held-out documents use the quantiles of all.
LOW, HIGH, MIN_HELD = 0.001, 0.999, 200
#: Each text counts as if so many characters of the held-out documents' mean cost went before it, so that short ones are judged by less.
PRIOR = 60
#: The least discount; characters handled at once; n-grams that may go to every executor (12 bytes each), beyond which
#: the texts go to their n-grams' probabilities batch by batch, BATCH characters each.
LEAST, PART, SENT, BATCH = 0.1, 1 << 18, 4_000_000, 1 << 20


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in a row, each with START before it, and where each text's own characters begin and end."""
    joined = "".join([START * (ORDER - 1) + t for t in texts]) if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[codes == 0] = 1
    ends = np.cumsum([len(t) + ORDER - 1 for t in texts]).astype(np.int64)
    return codes, np.stack([ends - [len(t) for t in texts], ends]) if texts else np.zeros((2, 0), np.int64)


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The 64-bit key of the n-gram that starts at each place."""
    n = len(codes) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(ORDER if n > 0 else 0):
        out += codes[j : n + j] * STEPS[j]
    return mix(out)


def parts(texts: list[str]):
    """(first, after the last, code points, bounds) of runs of texts of about PART characters; longer texts go alone."""
    lo = 0
    while lo < len(texts):
        hi, n = lo + 1, len(texts[lo])
        while hi < len(texts) and n + len(texts[hi]) <= PART:
            n += len(texts[hi])
            hi += 1
        yield lo, hi, *symbols(texts[lo:hi])
        lo = hi


def own_places(bounds: np.ndarray) -> np.ndarray:
    """Where the n-grams that end in the texts' own characters start."""
    n = bounds[1] - bounds[0]
    return np.repeat(bounds[0] - np.cumsum(n) + n, n) + np.arange(int(n.sum())) - (ORDER - 1)


def once(keys: np.ndarray) -> np.ndarray:
    """A place of each distinct key."""
    held = np.full(1 << 18, -1, np.int64)
    slot = (keys >> np.uint64(46)).astype(np.int64)
    held[slot] = np.arange(len(keys))
    rest = np.flatnonzero(keys[held[slot]] != keys)  # places that share a slot with another key
    _, first = np.unique(keys[rest], return_index=True)
    return np.concatenate([held[held >= 0], rest[first]])


def gather(rows: DataFrame) -> DataFrame:
    """(g, key, c) of every n-gram in the whole texts of rows (text, fold): c counts it in those with fold 1."""

    def run(it):
        known, counted = np.zeros(0, np.uint64), []
        for batch in it:
            texts = [t or "" for t in batch["text"].to_pylist()]
            train = batch["fold"].to_numpy(zero_copy_only=False) == 1
            for lo, hi, codes, bounds in parts(texts):
                keys = keys_of(codes)
                at = own_places(bounds)
                mine = keys[at]
                if not len(mine):
                    continue
                new = once(mine)
                where = np.minimum(np.searchsorted(known, mine[new]), max(len(known) - 1, 0))
                new = new[known[where] != mine[new]] if len(known) else new
                known = np.sort(np.concatenate([known, mine[new]]))
                rows = codes[at[new][:, None] + np.arange(ORDER)]
                grams = np.ascontiguousarray(rows).view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(mine[new].view(np.int64)), pa.array(np.zeros(len(new), np.int64))], names=["g", "key", "c"])
                taught = np.repeat(train[lo:hi], bounds[1] - bounds[0])
                if taught.any():
                    counted.append(np.unique(mine[taught], return_counts=True))
                    if len(counted) > 64:
                        counted = [added(counted)]
        if counted:
            keys, n = added(counted)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["g", "key", "c"])

    return rows.select("text", "fold").mapInArrow(lean(run), "g string, key long, c long").groupBy("key").agg(F.max("g").alias("g"), F.sum("c").alias("c")).select("g", "key", "c")


def added(counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([n for _, n in counted]))
    return keys, n


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many n-grams occur once to four times; fixed ones where that is too little to tell.

    Each is LEAST at least, so that every context leaves some probability to what it was never seen with."""
    if min(n) < 1:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [max(LEAST, min(i + 1.0, i + 1 - (i + 2) * y * n[i + 1] / n[i])) for i in range(3)]


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(key, bits) of all of grams (g, key, c): minus log2 of the interpolated probability of each one's last character.

    Lower orders count in how many contexts an n-gram stands; those that begin a text, which have one context only, how often.
    Characters that were never seen share what the lowest order leaves, with one place more than there are characters."""
    counts = cut(grams.where("c > 0").select("g", "c"))
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        g = F.substring("g", 2, k).alias("g")
        c = F.when(F.first("g").startswith(START * 2), F.sum("c")).otherwise(F.count("*"))
        levels[k] = cut(levels[k + 1].groupBy(g).agg(c.alias("c")))
    size = levels[1].count() + 1
    lower = None
    for k in range(1, ORDER + 1):
        t = levels[k].withColumn("h", F.substring("g", 1, k - 1))
        d = discounts([x or 0 for x in t.agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).first()])
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy("h").agg(F.sum("c").alias("total"), F.sum(off).alias("held"))
        wanted = grams.select("g", "key") if k == ORDER else grams.select(F.substring("g", ORDER + 1 - k, k).alias("g")).distinct()
        wanted = wanted.withColumn("h", F.substring("g", 1, k - 1)).join(contexts, "h", "left")
        wanted = wanted.join(t.select("g", "c", off.alias("off")), "g", "left")
        if lower is None:
            below = F.lit(1.0 / size)
        else:
            wanted = wanted.withColumn("suffix", F.substring("g", 2, k - 1)).join(lower.withColumnRenamed("g", "suffix"), "suffix")
            below = F.col("below")
        own = F.coalesce((F.col("c") - F.col("off")) / F.col("total"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), below).otherwise(own + F.col("held") / F.col("total") * below)
        if k == ORDER:
            return cut(wanted.select("key", (-F.log2(p)).cast("float").alias("bits")))
        lower = cut(wanted.select("g", p.alias("below")))
    raise AssertionError("unreachable")


class Costs:
    """Bits of n-grams by key, in an open hash table with linear steps; an n-gram that is not there costs `other`."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, other: float):
        self.shift = np.uint64(64 - max(8, math.ceil(math.log2(max(1, len(keys)) * 1.5))))
        size = 1 << (64 - int(self.shift))
        self.mask, self.other = size - 1, other
        self.keys, self.bits, used = np.zeros(size, np.uint64), np.zeros(size, np.float32), np.zeros(size, bool)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(~used[slot])
            at, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[at], self.bits[at], used[at] = keys[left[put]], bits[left[put]], True
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask
        self.bits[~used] = other

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> self.shift).astype(np.int64)
        out = self.bits[slot]
        rest = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & self.mask
            out[rest] = self.bits[slot]
            on = (self.keys[slot] != keys[rest]) & (self.keys[slot] != 0)
            rest, slot = rest[on], slot[on]
        return out


def costs(texts: list[str], model: Costs) -> tuple[np.ndarray, np.ndarray]:
    """(characters, bits) of each whole text."""
    n, bits = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for lo, hi, codes, bounds in parts(texts):
        at = own_places(bounds)
        sums = np.zeros(len(at) + 1)
        np.cumsum(model.of(keys_of(codes)[at]), out=sums[1:], dtype=np.float64)
        n[lo:hi] = bounds[1] - bounds[0]
        ends = np.cumsum(n[lo:hi])
        bits[lo:hi] = sums[ends] - sums[ends - n[lo:hi]]
    return n, bits


def scored(rows: DataFrame, grams: DataFrame, sent: int = SENT) -> DataFrame:
    """rows, with text, and n_symbols and bits of the whole text, from the (key, bits) of grams, which hold all n-grams of rows."""
    schema = T.StructType([*rows.schema.fields, T.StructField("n_symbols", T.LongType()), T.StructField("bits", T.DoubleType())])
    names, own = schema.names, rows.columns

    def added_to(batch, model: Costs) -> list:
        n, bits = costs([t or "" for t in batch["text"].to_pylist()], model)
        return [*[batch[c] for c in own], pa.array(n), pa.array(bits)]

    if grams.count() <= sent:
        held = grams.toArrow()  # 12 bytes each
        model = rows.sparkSession.sparkContext.broadcast(Costs(held["key"].to_numpy().view(np.uint64), held["bits"].to_numpy(), math.log2(1 << 20)))

        def run(it):
            for batch in it:
                yield pa.RecordBatch.from_arrays(added_to(batch, model.value), names=names)

        return rows.mapInArrow(lean(run), schema)
    # beyond that, batches of texts ask for their own n-grams: each distinct one once a batch
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = rows.withColumn("_batch", F.pmod(F.xxhash64("text"), F.lit(int(total // BATCH) + 1)))
    wanted = dealt.select("_batch", "text").mapInArrow(lean(asked), "_batch long, key long").distinct()
    answers = wanted.join(grams, "key")

    def meet(left, right):
        model = Costs(right["key"].to_numpy().view(np.uint64), right["bits"].to_numpy(), math.log2(1 << 20))
        return pa.table(added_to(left, model), names=names)

    return dealt.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(lambda left, right: meet(left.combine_chunks(), right), schema)


def asked(it):
    for batch in it:
        of = batch["_batch"].to_numpy()
        for lo, hi, codes, bounds in parts([t or "" for t in batch["text"].to_pylist()]):
            at = own_places(bounds)
            keys, home = keys_of(codes)[at], np.repeat(of[lo:hi], bounds[1] - bounds[0])
            for b in np.unique(home):
                found = np.unique(keys[home == b])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(found.view(np.int64))], names=["_batch", "key"])


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], low: float = LOW, high: float = HIGH, sent: int = SENT, joined: int = JOINED) -> DataFrame:
    """columns of docs with n_symbols, perplexity, lowest, highest and kept.

    Documents are kept if their perplexity is between the limits of their language, included. Null or empty texts have no
    perplexity of their own and are kept; a null or rare language takes the limits of all; without held-out documents
    everything is kept. Repeated rows are scored alike; an empty table gives no rows; texts are scored whole, however long.
    Columns named like the added ones are replaced; all others, whatever their names, are carried along."""
    new = ["n_symbols", "perplexity", "lowest", "highest", "kept"]
    judged = judge(docs, labels, low, high, sent, joined)
    return judged.select(*named([c for c in columns if c not in new], "row"), *new)


def quantiles(values: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(lang, n, a column for each of shares): exact quantiles of perplexity per lang, interpolated as by percentile.

    Values are counted by narrow ranges; only the ranges that hold a wanted rank are sorted, each for itself."""
    ranged = values.select("lang", "perplexity", F.floor(F.log2("perplexity") * 64).alias("range"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("size"))  # some hundred rows a language
    sizes = sizes.withColumns({"before": F.coalesce(F.sum("size").over(before), F.lit(0)), "n": F.sum("size").over(Window.partitionBy("lang"))})
    place = {c: (F.col("n") - 1) * F.lit(q) for c, q in shares.items()}
    ranks = {(c, f.__name__): f(x) for c, x in place.items() for f in (F.floor, F.ceil)}
    wanted = reduce(or_, [(F.col("before") <= r) & (r < F.col("before") + F.col("size")) for r in ranks.values()])
    met = ranged.withColumnsRenamed({"lang": "l", "range": "r"}).join(F.broadcast(cut(sizes.where(wanted))), F.col("l").eqNullSafe(F.col("lang")) & (F.col("r") == F.col("range")))
    met = met.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("lang", "range").orderBy("perplexity")) - 1)
    held = {c: [F.max(F.when(F.col("rank") == ranks[c, f], F.col("perplexity"))) for f in ("floor", "ceil")] for c in shares}
    share = {c: F.max(x - F.floor(x)) for c, x in place.items()}
    return met.groupBy("lang").agg(F.max("n").alias("n"), *[((1 - share[c]) * a + share[c] * b).alias(c) for c, (a, b) in held.items()])


def judge(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, sent: int = SENT, joined: int = JOINED) -> DataFrame:
    """row (all columns of docs), n_symbols, perplexity, lowest, highest and kept; see classify."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    fold = F.when(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(HELD)) == 0, 2).otherwise(1)
    trusted = cut(good.withColumn("fold", fold))
    base = packed(docs, docs.columns, F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    marked = base.join(F.broadcast(trusted) if trusted.count() <= joined else trusted, "id", "left")
    grams = kneser_ney(cut(gather(marked.select("text", F.coalesce("fold", F.lit(0)).alias("fold")))))
    held = cut(scored(marked.where("fold = 2").select("lang", "text"), grams, sent).drop("text").where("n_symbols > 0"))
    mean = held.agg(F.sum("bits") / F.sum("n_symbols")).first()[0] or 0.0
    perplexity = F.pow(F.lit(2.0), (F.col("bits") + PRIOR * mean) / (F.col("n_symbols") + PRIOR))
    held = held.withColumn("perplexity", perplexity)
    limits = cut(quantiles(held.select("lang", "perplexity").where("lang is not null").unionByName(held.select(F.lit(None).cast("string").alias("lang"), "perplexity")), {"lowest": low, "highest": high}))
    by_lang = limits.where(F.col("lang").isNotNull() & (F.col("n") >= MIN_HELD)).drop("n")
    every = limits.where("lang is null").select("lowest", "highest").first() or (None, None)
    out = scored(base.select("row", "lang", "text"), grams, sent).drop("text").withColumn("perplexity", perplexity)
    out = out.join(F.broadcast(by_lang), "lang", "left")  # a row per language of MIN_HELD held-out documents
    out = out.withColumn("lowest", F.coalesce("lowest", F.lit(every[0] or 0.0))).withColumn("highest", F.coalesce("highest", F.lit(math.inf if every[1] is None else every[1])))
    return out.withColumn("kept", (F.col("n_symbols") == 0) | F.col("perplexity").between(F.col("lowest"), F.col("highest")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, with all their columns. Edge cases: see classify."""
    return judge(docs, table(spark, sf_dir, "labels")).where("kept").select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, lang, n_symbols, perplexity, lowest, highest and kept. Edge cases: see classify."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels"), ["doc_id", "lang"])
