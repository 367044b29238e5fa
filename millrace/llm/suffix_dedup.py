"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash picks triggers so that every window of WIDTH bytes holds one: the leftmost of least hash among the window's
strings of TRIGGER bytes. Triggers cut a text into phrases; the phrases around a trigger, as far as the windows that it
decides reach, are the dictionary, and the triggers in a row the parse. Equal windows have equal triggers at equal places,
so that the suffixes of the dictionary need sorting only among those with the same trigger, and only to WIDTH bytes; the
parse tells which document has each phrase first. The parse alone, as short hashes, goes round first: a trigger that occurs
in one document only cannot be in a repeat. Every decision compares bytes; a clash of hashes only costs time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrowtext import lean, slices, trim
from millrace.llm.common import cut, lookup, release, stored, table
from millrace.llm.textsets import mix, powers

WIDTH, TRIGGER = 50, 24
SPAN = WIDTH - TRIGGER + 1  # strings of TRIGGER bytes in a window, and windows that one trigger can decide
CONTEXT = WIDTH + SPAN - 1
#: Bytes of text in a batch, and for each shard of the dictionary; documents from which on a trigger's windows are dealt out one by one.
BATCH, PER_SHARD, HOT = 2 << 20, 1 << 19, 512
#: Bytes parsed at once, and bytes whose triggers a task gathers before it sends them.
BLOCK, GATHER = 1 << 18, 4 << 20
FOLD = np.array([pow(0xA0761D6478BD642F, i + 1, 1 << 64) | 1 for i in range(-(-WIDTH // 8))], np.uint64)
SPREAD = np.array([pow(0xD1342543DE82EF95, i + 1, 1 << 64) | 1 for i in range(WIDTH)], np.uint64)


def parse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, trigger's hash) of each run of windows with one trigger; windows stay inside texts."""
    firsts, numbers, hashes = [], [], []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for lo in range(0, max(0, len(data) - WIDTH + 1), BLOCK):
        part = data[lo : lo + BLOCK + WIDTH - 1]
        n = len(part) - WIDTH + 1
        up, down = powers(len(part) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
        m = len(part) - TRIGGER + 1
        h = mix((sums[TRIGGER:] - sums[:-TRIGGER]) * down[:m])
        least = (h & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)  # hash, then place
        step = 1
        while 2 * step <= SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if SPAN > step:
            least = np.minimum(least[: step - SPAN], least[SPAN - step :])
        at = (least[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
        inside = lo + np.arange(n) + WIDTH <= ends[lo : lo + n]
        start = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
        stop = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
        firsts.append(start + lo)
        numbers.append(stop - start + 1)
        hashes.append(h[at[start]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(numbers), np.concatenate(hashes)


def planes(x: np.ndarray) -> bytes:
    """Little-endian values byte by byte: all lowest bytes first, so that equal high bytes compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def strings(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each place on as rows, zeros after the end; each is copied as one item."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    every = np.ndarray(len(data) + 1, f"V{width}", padded, strides=(1,))
    return every[at].view(np.uint8).reshape(len(at), width)


def squeezed(data: bytes) -> bytes:
    """Contexts overlap and repeat words: made smaller than the shuffle's own compression would."""
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True)


SHARED = "batch int, kind int, key long, data binary"
NAMES = ["batch", "kind", "key", "data"]


def rows_of(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)


KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def shared_triggers(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (batch, 1, shard, data): the triggers of a batch that occur in several documents, and which of those are hot.

    Each task sends, for each shard of hashes, every trigger once per batch of documents with a mark if several of its
    documents have it; so a trigger costs a shard no more than one entry for each task and batch."""

    def packed(h: np.ndarray, of: np.ndarray) -> pa.Table:
        """A row per shard: its distinct (trigger, batch), 40 bits of the hash and the batch with the mark."""
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
        several = np.diff(np.append(start, len(h))) > 1
        h, of = h[start], of[start]
        shard = (h >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        rows = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            low = (h[a:b] >> np.uint64(24 - bits)) & np.uint64((1 << 40) - 1)
            rows.append((int(shard[a]), planes(low)[: 5 * len(low)] + planes(of[a:b] << np.uint32(1) | several[a:b])))
        return rows_of(rows, ["shard", "data"], [pa.int32(), pa.binary()])

    def send(it):
        keys, batches, held = [], [], 0
        for batch in it:
            ids = batch["batch"].to_numpy()
            for lo, _, data, offsets in slices(batch["text"], 4 * BLOCK):
                first, _, h = parse(data, offsets)
                doc = np.searchsorted(offsets, first, "right") - 1 + lo
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
                keys.append(h[new])
                batches.append(ids[doc[new]].astype(np.uint32))
                held += len(data)
                if held > GATHER:
                    yield from packed(np.concatenate(keys), np.concatenate(batches)).to_batches()
                    keys, batches, held = [], [], 0
        if keys and sum(map(len, keys)):
            yield from packed(np.concatenate(keys), np.concatenate(batches)).to_batches()

    def meet(key, t):
        low, of, several = [], [], []
        for data in t["data"].to_pylist():
            n = len(data) // 9
            low.append(from_planes(data[: 5 * n] + bytes(3 * n), np.uint64))
            both = from_planes(data[5 * n :], np.uint32)
            of.append(both >> 1)
            several.append(both & 1)
        low, of, several = np.concatenate(low), np.concatenate(of), np.concatenate(several)
        order = np.lexsort((of, low))
        low, of, several = low[order], of[order], several[order]
        start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(start, len(low)))
        many = np.repeat(np.add.reduceat(1 + several.astype(np.int64), start), n)
        keep = many > 1
        pair = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])])
        keep &= pair
        low, of, hot = low[keep], of[keep], many[keep] >= HOT
        shard = key[0].as_py()
        order = np.argsort(of, kind="stable")
        low, of, hot = low[order], of[order], hot[order]
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(0, np.int64)
        rows = [(int(of[a]), 1, shard, planes(low[a:b] << np.uint64(1) | hot[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return rows_of(rows, NAMES, KINDS)

    return stored(docs.mapInArrow(lean(send), "shard int, data binary").groupBy("shard").applyInArrow(meet, SHARED), "triggers")[0]


class Batch:
    """The texts of one batch and the part of the dictionary they need.

    copies: texts that a smaller document has as a whole, which need no parsing. rows: the distinct contexts, 0-padded, with their numbers of windows; least: the smallest document with each; shard:
    where each is compared. At: for each context in the texts, its row, document and first window."""

    def __init__(self, t: pa.Table, bits: int):
        kind = t["kind"].to_numpy()
        texts = t.filter(pa.array(kind == 0)).sort_by([("key", "ascending"), ("data", "ascending")])
        named = t.filter(pa.array(kind == 3))
        copies = set(zip(named["key"].to_pylist(), named["data"].to_pylist(), strict=True))
        maybe = {k for k, _ in copies}
        ids, texts = texts["key"].to_numpy(), [np.frombuffer(x, np.uint8) for x in texts["data"].to_pylist()]
        copied = np.array([i in maybe and (i, hashlib.md5(x).digest()) in copies for i, x in zip(ids.tolist(), texts, strict=True)], bool)
        self.copies = [(i, x) for i, x, c in zip(ids.tolist(), texts, copied.tolist(), strict=True) if c]
        self.ids, self.texts = ids[~copied], [x for x, c in zip(texts, copied.tolist(), strict=True) if not c]
        lens = np.array([len(x) for x in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lens)])
        data = np.concatenate(self.texts) if len(self.texts) else np.zeros(0, np.uint8)
        shared = t.filter(pa.array(kind == 1))
        known, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for shard, packed in zip(shared["key"].to_pylist(), shared["data"].to_pylist(), strict=True):
            both = from_planes(packed, np.uint64)
            known.append(both >> np.uint64(1) | np.uint64(shard) << np.uint64(40))
            hot.append((both & np.uint64(1)).astype(bool))
        known, hot = np.concatenate(known), np.concatenate(hot)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        first, number, h = parse(data, self.offsets)
        short = h >> np.uint64(24 - bits)
        at = np.minimum(np.searchsorted(known, short), max(0, len(known) - 1))
        found = known[at] == short if len(known) else np.zeros(len(h), bool)
        first, number, at, h = first[found], number[found], at[found], h[found]
        single = hot[at] if len(known) else np.zeros(0, bool)
        spread = np.repeat(first[single], number[single]) + (np.arange(number[single].sum()) - np.repeat(np.cumsum(number[single]) - number[single], number[single]))
        first = np.concatenate([first[~single], spread])
        n_cold = int((~single).sum())
        number = np.concatenate([number[~single], np.ones(len(spread), np.int64)])
        rows = np.zeros((len(first), CONTEXT + 1), np.uint8)
        found = strings(data, first, CONTEXT)
        for lo in range(0, len(first), 8_000):
            held = np.arange(CONTEXT) < number[lo : lo + 8_000, None] + WIDTH - 1
            rows[lo : lo + 8_000, :CONTEXT] = found[lo : lo + 8_000] * held
        rows[:, CONTEXT] = number
        shard = np.zeros(len(first), np.int64)
        shard[:n_cold] = h[~single] >> np.uint64(64 - bits)
        for lo in range(n_cold, len(first), 8_000):
            shard[lo : lo + 8_000] = mix((rows[lo : lo + 8_000, :WIDTH].astype(np.uint64) * SPREAD).sum(1, dtype=np.uint64)) >> np.uint64(64 - bits)
        kept, one, self.row = np.unique(rows.view(np.dtype((np.void, CONTEXT + 1))).ravel(), return_index=True, return_inverse=True)
        self.rows, self.shard = rows[one], shard[one]
        self.first, self.number = first, number
        self.doc = np.searchsorted(self.offsets, first, "right") - 1
        self.least = np.full(len(kept), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.row, self.ids[self.doc] if len(first) else np.zeros(0, np.int64))
        self.data = data

    def in_shards(self):
        """(shard, the rows of the dictionary in it, ascending)."""
        order = np.argsort(self.shard, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(self.shard[order]) != 0, [True]])) if len(order) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.shard[order[a]]), order[a:b]


def sort_suffixes(rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a bit for each of its windows: a document smaller than the context's own has the same WIDTH bytes.

    The suffixes of all contexts that are a window long are sorted by a hash of their first WIDTH bytes, and neighbours of
    one hash compared; should two of them differ, all are sorted by the bytes themselves. In each run of equal ones the
    smallest document is found; a window that equals no other needs nothing more."""
    masks = np.zeros(len(rows), np.uint32)
    number = rows[:, CONTEXT].astype(np.int64)
    context = np.repeat(np.arange(len(rows)), number)
    start = np.arange(len(context)) - np.repeat(np.cumsum(number) - number, number)
    words = strings(rows.ravel(), context * (CONTEXT + 1) + start, len(FOLD) * 8)
    words[:, WIDTH:] = 0
    keys = words.view(np.uint64)
    hashes = np.zeros(len(keys), np.uint64)
    for k, factor in enumerate(FOLD):
        hashes += mix(keys[:, k] + factor) * factor
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    at = np.flatnonzero(same)
    if (keys[order[at]] != keys[order[at + 1]]).any():
        order = np.lexsort(tuple(keys.T))
        same = (keys[order[1:]] == keys[order[:-1]]).all(1)
    new = np.concatenate([[True], ~same])
    shared = ~new | np.concatenate([same, [False]])
    order, begin = order[shared], np.flatnonzero(new[shared])
    if not len(order):
        return masks
    own = docs[context[order]]
    least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(order))))
    smaller = order[least < own]
    np.bitwise_or.at(masks, context[smaller], (np.uint32(1) << start[smaller].astype(np.uint32)))
    return masks


def find_repeats(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, spans (removed runs of bytes) and kept, the remaining bytes.

    A byte is removed if some string of WIDTH bytes that covers it also starts in a document of smaller doc_id. A null text
    is empty; texts under WIDTH bytes keep all; a null doc_id keeps all and is not compared with; rows that share a doc_id
    are not compared with each other; an empty table gives no rows; other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_batches = int(total // BATCH) | 1
    bits = min(24, max(4, int(total // PER_SHARD).bit_length()))  # 24 and 40 make 64; shards grow beyond 8 TB
    in_batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch")  # ids of a stride spread too
    known = rows.where("doc_id is not null")
    shared = shared_triggers(known.select("text", in_batch), bits)
    release(docs.sparkSession)  # the triggers that were dealt out for it
    texts = known.select(in_batch, F.lit(0).alias("kind"), F.col("doc_id").alias("key"), F.encode("text", "UTF-8").alias("data"))

    # of equal texts only the first is parsed; the others are told to their batches by name
    digests = cut(known.select("doc_id", F.md5("text").alias("digest")))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = lookup(digests, cut(firsts), "digest").where("doc_id > first").select("doc_id", "digest").distinct()
    named = cut(copies.select(in_batch, F.lit(3).alias("kind"), F.col("doc_id").alias("key"), F.unhex("digest").alias("data")))
    shared = shared.unionByName(named)
    release(docs.sparkSession)

    def contexts(t: pa.Table) -> pa.Table:
        of = t["batch"][0].as_py()
        batch = Batch(t, bits)
        out = [(s, of, squeezed(batch.rows[at].tobytes()), planes(batch.least[at])) for s, at in batch.in_shards()]
        del batch
        trim()
        return rows_of(out, ["shard", "batch", "rows", "least"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    def judge(key, t):
        shard = key[0].as_py()
        parts = [np.frombuffer(unsqueezed(x), np.uint8).reshape(-1, CONTEXT + 1) for x in t["rows"].to_pylist()]
        least = [from_planes(x, np.int64) for x in t["least"].to_pylist()]
        masks = sort_suffixes(np.concatenate(parts), np.concatenate(least))
        ends = np.cumsum([len(p) for p in parts])
        trim()
        out = [(b, 2, shard, masks[e - len(p) : e].tobytes()) for b, p, e in zip(t["batch"].to_pylist(), parts, ends, strict=True)]
        return rows_of(out, NAMES, KINDS)

    sent = texts.unionByName(shared).groupBy("batch").applyInArrow(contexts, "shard int, batch int, rows binary, least binary")
    judged = stored(sent.groupBy("shard").applyInArrow(judge, SHARED), "verdicts")[0]
    del sent
    release(docs.sparkSession)  # the texts and contexts that were dealt out for it
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(t: pa.Table) -> pa.Table:
        batch = Batch(t, bits)
        masks = np.zeros(len(batch.rows), np.uint32)
        verdicts = t.filter(pa.array(t["kind"].to_numpy() == 2))
        told = dict(zip(verdicts["key"].to_pylist(), verdicts["data"].to_pylist(), strict=True))
        for s, at in batch.in_shards():
            masks[at] = np.frombuffer(told[s], np.uint32)
        own = batch.ids[batch.doc] if len(batch.doc) else np.zeros(0, np.int64)
        mask = np.where(own > batch.least[batch.row], np.uint32(0xFFFFFFFF), masks[batch.row]) if len(own) else np.zeros(0, np.uint32)
        cover = np.zeros(len(batch.data) + 1, np.int32)
        for k in range(SPAN):
            hit = (k < batch.number) & ((mask >> np.uint32(k)) & np.uint32(1)).astype(bool)
            at = batch.first[hit] + k
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WIDTH, -1)
        gone = np.cumsum(cover)[:-1] > 0
        out = []
        for doc_id, text in batch.copies:
            out.append((doc_id, len(text), [{"start": 0, "end": len(text)}] if len(text) >= WIDTH else [], b"" if len(text) >= WIDTH else text.tobytes()))
        for i, (doc_id, text) in enumerate(zip(batch.ids.tolist(), batch.texts, strict=True)):
            here = gone[batch.offsets[i] : batch.offsets[i + 1]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))
            out.append((doc_id, len(text), [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2], strict=True)], text[~here].tobytes()))
        del batch, cover, gone, mask
        trim()
        return rows_of(out, ["doc_id", "n_bytes", "spans", "kept"], [pa.int64(), pa.int64(), span, pa.binary()])

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    found = texts.unionByName(shared).unionByName(judged).groupBy("batch").applyInArrow(remove, schema)
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    rest = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return found.unionByName(rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256. Edge cases: see find_repeats."""
    found = find_repeats(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
