"""Token ids in wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

A file holds the magic, the length of a JSON header, the header, and zstd frames: the documents' ids and sizes, then a bit
plane per bit of the ids, highest first, each with its counts of ones up to every 512th bit."""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.arrowtext import batches
from millrace.llm.common import cut, shared_path, shuffle_partitions, table
from millrace.llm.wordtokens import coder

MAGIC, BLOCK = b"MWM1", 512
#: Ids in a file, beyond which only a single longer document goes.
SHARD = 1 << 20
END = 0
POPCOUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


class WaveletMatrix:
    """planes[k]: bits in MSB-first bytes; ranks[k][j]: ones among the first j * BLOCK bits; zeros[k]: zeros in all."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.planes = n, planes
        if ranks is None:
            ranks = []
            for plane in planes:
                full = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
                full[: len(plane)] = POPCOUNT[plane]
                ranks.append(np.concatenate([[0], np.cumsum(full.reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32))]).astype(np.uint32))
        self.ranks = ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for k in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << k)) != 0
            planes.append(np.packbits(ones))
            now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane's order is restored from the next one's."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            z = self.zeros[len(self.planes) - 1 - k]
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~ones)] = now[:z]  # places are far quicker than masks here
            before[np.flatnonzero(ones)] = now[z:] | kind(1 << k)
            now = before
        return now.astype(np.uint32)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, plane = i // BLOCK, self.planes[k]
        first, last = block * (BLOCK // 8), i // 8
        count = int(self.ranks[k][block]) + int(POPCOUNT[plane[first:last]].sum())
        return count + (int(POPCOUNT[plane[last] >> (8 - i % 8)]) if i % 8 else 0)

    def _find(self, k: int, one: bool, j: int) -> int:
        """Where the j-th one, or zero, of a plane stands, from 0."""
        marks = self.ranks[k].astype(np.int64)
        marks = marks if one else np.arange(len(marks)) * BLOCK - marks
        block = int(np.searchsorted(marks, j, "right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == one)[j - int(marks[block])])

    def access(self, i: int) -> int:
        out = 0
        for k, plane in enumerate(self.planes):
            bit = plane[i // 8] >> (7 - i % 8) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            out = out << 1 | int(bit)
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        last = len(self.planes) - 1
        if symbol >> last + 1:
            return 0, 0
        for k in range(last + 1):
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if symbol >> last - k & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """How often symbol occurs in positions lo to hi."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def select(self, symbol: int, j: int) -> int:
        """The position of the j-th occurrence of symbol, from 0."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(j)
        i, last = lo + j, len(self.planes) - 1
        for k in range(last, -1, -1):
            one = bool(symbol >> last - k & 1)
            i = self._find(k, one, i - self.zeros[k] if one else i)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, j) for j in range(self.count(symbol))]


def to_bytes(doc_ids: list, sizes: np.ndarray, matrix: WaveletMatrix) -> bytes:
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    known = np.array([x is not None for x in doc_ids], np.uint8)
    frames = [pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), pack(known.tobytes()), pack(np.asarray(sizes, "<i8").tobytes())]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        frames += [pack(plane.tobytes()), pack(ranks.astype("<u4").tobytes())]
    header = json.dumps({"n": matrix.n, "docs": len(doc_ids), "bits": len(matrix.planes), "frames": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """(document ids, their sizes, the matrix)."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    (size,) = struct.unpack_from("<I", data, 4)
    header, at, parts = json.loads(data[8 : 8 + size]), 8 + size, []
    unpack = zstandard.ZstdDecompressor().decompress
    for n in header["frames"]:
        parts.append(unpack(data[at : at + n]))
        at += n
    ids, known = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8)
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return [int(x) if k else None for x, k in zip(ids, known, strict=True)], np.frombuffer(parts[2], "<i8"), WaveletMatrix(header["n"], planes, ranks)


def store(uri: str):
    """(file system, path) of a folder or file in storage that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard: int = SHARD, end: int = END) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order, and returns the manifest: (part, number, before, n_docs,
    n_tokens, path), before being the ids of the same part in earlier files.

    Documents are dealt out by ranges of doc_id and sorted in each. Every attempt of a task writes files of its own names,
    and only the manifest, which is kept, says which count; so lost executors and repeated tasks leave no trace in it."""
    n = shuffle_partitions(docs.sparkSession)
    sorted_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    rows = sorted_docs.withColumn("part", F.spark_partition_id())

    def run(it):
        tokens, where = coder(tokenizer), store(folder)
        where[0].create_dir(where[1], recursive=True)
        number = before = 0
        part, doc_ids, texts = 0, [], []
        held = 0

        def flush():
            nonlocal number, before, doc_ids, texts, held
            ids = np.concatenate(texts)
            path = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.mwm"
            with where[0].open_output_stream(store(path)[1]) as f:
                f.write(to_bytes(doc_ids, np.array([len(t) for t in texts]), WaveletMatrix.build(ids)))
            row = [[part], [number], [before], [len(texts)], [len(ids)], [path]]
            number, before, doc_ids, texts, held = number + 1, before + len(ids), [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["part", "number", "before", "n_docs", "n_tokens", "path"])

        for batch in batches(it, 2000):
            part = batch["part"][0].as_py()
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), tokens.batch(batch["text"]), strict=True):
                if texts and held + len(ids) + 1 > shard:
                    yield flush()
                doc_ids.append(doc_id)
                texts.append(np.append(ids, np.uint32(end)))
                held += len(ids) + 1
        if texts:
            yield flush()

    return cut(rows.mapInArrow(run, "part int, number int, before long, n_docs long, n_tokens long, path string"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. The one table that meets in a task has a row per part."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    files = manifest.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "path")  # a row per shuffle partition

    def run(it):
        for batch in it:
            for start, path in zip(batch["start"].to_pylist(), batch["path"].to_pylist(), strict=True):
                system, at = store(path)
                with system.open_input_stream(at) as f:
                    doc_ids, sizes, matrix = from_bytes(f.read())
                ids, ends = matrix.decode(), np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s : e].astype("<u4").tobytes()) for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - sizes), pa.array(np.asarray(sizes)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.sparkSession.sparkContext.defaultParallelism) * 4
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Writes the shards and reads them back, per document: doc_id, start, n_tokens, ids_crc32.

    A null text is empty: its one id is the end id. Null doc_ids come first in order. Rows that share a doc_id stay rows of
    their own next to each other. An empty table gives no files and no rows. Other columns are not read."""
    return read_shards(write_shards(docs, tokenizer, folder or shared_path(docs.sparkSession, "tokens")))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32. Edge cases: see token_files."""
    return token_files(table(spark, sf_dir, "documents"), byte_vocabulary())
