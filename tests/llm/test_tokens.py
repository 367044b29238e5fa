import random
import zlib

import numpy as np
import pytest

from millrace.llm import packing, wavelet
from millrace.llm.wordtokens import Coder

VOCABULARIES = [wavelet.byte_vocabulary(), packing.word_vocabulary()]


@pytest.mark.parametrize("path", VOCABULARIES)
def test_pieces_equal_the_whole(path):
    coder, rng = Coder(path), random.Random(1)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", ".", "!!", ",", "\xa0", "ﬁ", "́", "1", "日本", "İ", "ς", "\x00", "😀", "²", " The", " and,"]
    texts = ["", " ", "x" * 1000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.direct
    assert [x.tolist() for x in coder.batch(texts)] == want


def ids_of(rows, path):
    tokenizer = Coder(path).tokenizer
    for r in rows:
        yield r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")


def test_wavelet_matrix():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 700, 5000).astype(np.uint32)
    _, _, m = wavelet.from_bytes(wavelet.to_bytes([1], np.array([5000]), wavelet.WaveletMatrix.build(ids)))
    assert (m.decode() == ids).all()
    assert [m.access(i) for i in (0, 1, 511, 512, 4999)] == ids[[0, 1, 511, 512, 4999]].tolist()
    for symbol in (int(ids[7]), 0, 699, 1 << 14):
        where = np.flatnonzero(ids == symbol)
        assert m.count(symbol) == len(where) and m.count(symbol, 100, 2000) == ((where >= 100) & (where < 2000)).sum()
        assert m.occurrences(symbol) == where.tolist()
    with pytest.raises(IndexError):
        m.select(1 << 14, 0)
    with pytest.raises(ValueError):
        wavelet.from_bytes(b"nonsense")


@pytest.mark.parametrize("shard", [50, 1 << 20])
def test_files_hold_all_ids(spark, odd_docs, tmp_path, shard):
    manifest = wavelet.write_shards(odd_docs, wavelet.byte_vocabulary(), f"file://{tmp_path}", shard)
    got = sorted(map(tuple, wavelet.read_shards(manifest).collect()), key=lambda r: r[1])
    want, start = [], 0
    order = sorted(odd_docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, ids in ids_of(order, wavelet.byte_vocabulary()):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_no_files_of_nothing(no_docs):
    assert wavelet.token_files(no_docs, wavelet.byte_vocabulary()).count() == 0


def test_packing_is_whole_and_gapless(odd_docs):
    capacity = 64
    rows = packing.pack(odd_docs, packing.word_vocabulary(), capacity).collect()
    want = []
    for i, ids in ids_of(odd_docs.collect(), packing.word_vocabulary()):
        want += [(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity


@pytest.mark.parametrize("seed", range(8))
def test_solver_against_bounds(seed):
    rng = random.Random(seed)
    capacity = 50
    counts = {x: rng.randint(1, 9) for x in rng.sample(range(1, capacity + 1), 20)}
    patterns = packing.solve(counts, capacity)
    held = {}
    for times, lengths in patterns:
        assert times > 0 and sum(x * n for x, n in lengths) <= capacity
        for x, n in lengths:
            held[x] = held.get(x, 0) + n * times
    assert held == counts
    used, bound = sum(t for t, _ in patterns), packing.lower_bound(counts, capacity)
    assert bound <= used <= bound + 1 + bound // 20


def test_reduction_fixes_dominating_sets():
    instance = packing.Instance({9: 2, 6: 3, 4: 3, 1: 2}, 10)
    instance.reduce()
    assert instance.counts.sum() == 0 and sum(t for t, _ in instance.patterns) == 5


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, packing.word_vocabulary()).count() == 0


def test_common_pieces_are_remembered(monkeypatch):
    """Beyond REMEMBER pieces the common ones stay; ids are those of whole texts all the same."""
    from millrace.llm import wordtokens

    monkeypatch.setattr(wordtokens, "REMEMBER", 300)
    tested = wordtokens.Coder(wavelet.byte_vocabulary())
    texts = [[f"the common{'&&&' * (i % 2)} word{'#$%*.'[j % 5]} {'abcdefgh'[j % 8] * (1 + j // 8 % 5)}{'ijklm'[i % 5]}" + chr(97 + i % 26) * 3 for j in range(40)] for i in range(40)]
    for batch in texts:
        assert [x.tolist() for x in tested.batch(batch)] == tested.encode(batch)
        assert len(tested.index) == tested.n <= 600
    assert tested.index.get("common", tested.n) < 40 and tested.index.get("common&&&", tested.n) < tested.n


@pytest.mark.parametrize("path", VOCABULARIES)
def test_words_between_line_feeds_are_learnt_once(path):
    """A line feed between two words ends a piece as a space does; the library gets each word once, with marks or without."""
    parts = ["Zug", "über", "naïve", "Ærø", "x1", "'s", "<|endoftext|>", "\n", "\n", "\n", " ", "\t", "\xa0", "...", "?!", "×", "é", "ß", "́", "\x85"]
    rng = random.Random(3)
    tested, whole = Coder(path), Coder(path).tokenizer
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    assert [x.tolist() for x in tested.batch(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    tested.clear()
    told = []
    of_words, tested.of_words = tested.of_words, lambda words: told.extend(words) or of_words(words)
    tested.batch(["one two.\nthree", "one, two!\nfour two."])
    assert sorted(told) == sorted(["one", " two", "\nthree", "\nfour"])
