"""Token ids of whole texts from a tokenizers file, with each distinct word encoded once per worker.

Both public vocabularies split a text before every single space that a non-space follows, whatever stands on either side, and
before a single line feed between two non-spaces, so the ids of a text are the ids of its pieces in a row. Texts where that is
not certain are encoded whole."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.arrowtext import slices

#: Pieces that a worker remembers; then it keeps the half that it met most often.
REMEMBER = 600_000
#: Longer pieces are not remembered; their texts are encoded whole.
LONGEST = 200
#: Bytes of text cut into pieces at once, and words that the library gets at once.
SLICE, AT_ONCE = 1 << 22, 5_000
#: Words of Latin-1 letters, and marks that may follow them. Letters and marks never share a token.
WORD, MARKS = "^[ \n]?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$", ".,;:!?&#$%*"
PROBE = ["the", "Über", "naïve", "ñandú", "ß", "Zug", "xqzvk", "Ærø"]
#: Bytes that surely are not white space, and that no combining mark begins with: ASCII, and what begins À to ÿ.
SURE = np.zeros(256, bool)
SURE[33:127] = SURE[0xC3] = True
_coders: dict[str, Coder] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def turned(pieces: list[str]) -> list[str]:
    """Pieces as the index names them, and back: without the space that most begin with; others begin with one there."""
    return [p[1:] if p[:1] == " " else f" {p}" for p in pieces]


class Index(dict):
    """Numbers of pieces; a new piece gets the next number and is noted as pending."""

    def __init__(self) -> None:
        self.pending: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        return n


class Coder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.spaced = self.tokenizer.normalizer is None  # a space before a word is part of its first token
        # the vocabulary's own model, on words that are told apart by spaces and written in the letters of bytes
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = np.array([ord(c) for c in byte_letters()], "<u4")
        self.letters[10] = ord(" ")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token.removesuffix(suffix) if suffix else token)
        self.line = self.encode(["\n"])[0]
        probe = [f"{head}{w}" for head in (" ", "\n", "") for w in PROBE]
        lens, ids = self.of_words(probe)
        self.direct = np.split(ids, np.cumsum(lens)[:-1]) if lens is not None else []
        self.direct = [x.tolist() for x in self.direct] == self.encode(probe)
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.ends: dict[str, list[int]] = {}
        self.lens, self.starts, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.hits = np.zeros(1 << 12, np.int64)
        self.n = self.end = 0

    def forget(self) -> None:
        """Keeps the half of the pieces that were met most often, so that common words are not learnt again."""
        kept = np.sort(np.argsort(-self.hits[: self.n], kind="stable")[: self.n // 2])
        pieces, old = list(self.index), self.index
        self.index = Index()
        self.index.update((pieces[i], j) for j, i in enumerate(kept.tolist()))
        del pieces, old
        lens = self.lens[kept]
        n, self.ids = self.row(kept)
        self.lens, self.starts, self.hits = lens, np.cumsum(n) - n, self.hits[kept] // 2
        self.n, self.end = len(kept), len(self.ids)

    def encode(self, texts: list[str], by=None) -> list[list[int]]:
        return [e.ids for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def of_words(self, words: list[str]) -> tuple[np.ndarray | None, np.ndarray]:
        """How many ids each word of Latin-1 letters has, with the space or line feed before it, and all ids in a row, from the
        vocabulary's model itself; None for the numbers if the tokens do not end where the words do."""
        lines = np.array([w[0] == "\n" for w in words], bool)
        bare = [w if w[0] not in " \n" or (w[0] == " " and self.spaced) else w[1:] for w in words]
        counts, found = [], []
        for lo in range(0, len(bare), AT_ONCE):
            joined = "\n".join(bare[lo : lo + AT_ONCE])
            raw = np.frombuffer((joined.lower() if self.lower else joined).encode(), np.uint8)
            ids = np.array(self.encode([self.letters[raw].tobytes().decode("utf-32-le")], self.words)[0], np.uint32)
            ends = np.append(np.flatnonzero(raw == 10), len(raw)) - np.arange(len(bare[lo : lo + AT_ONCE]))  # letters up to each word's end
            reached = np.cumsum(self.sizes[ids])
            at = np.searchsorted(reached, ends)
            if not len(ids) or reached[-1] != ends[-1] or (reached[at] != ends).any():
                return None, np.zeros(0, np.uint32)
            counts.append(np.diff(at, prepend=-1))
            found.append(ids)
        n, flat = np.concatenate(counts), np.concatenate(found)
        if self.line and lines.any():
            before = np.repeat((np.cumsum(n) - n)[lines], len(self.line))
            flat = np.insert(flat, before, np.tile(np.array(self.line, np.uint32), int(lines.sum())))
            n = n + lines * len(self.line)
        return n, flat

    def put(self, numbers: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Notes the ids of the pieces of these numbers, which stand in a row."""
        while self.end + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * max(1, len(self.ids)))
        self.lens[numbers] = lens
        self.starts[numbers] = self.end + np.cumsum(lens) - lens
        self.ids[self.end : self.end + len(ids)] = ids
        self.end += len(ids)

    def row(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each piece has, all of them in a row)."""
        lens = np.maximum(self.lens[numbers].astype(np.int64), 0)
        ends = np.cumsum(lens)
        return lens, self.ids[np.repeat(self.starts[numbers] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def learn(self) -> None:
        """The ids of the pending pieces. Words of letters go to the model, together with those that were only met with marks;
        a word with marks has the ids of both in a row. Other pieces are encoded as they are, as at a text's start. Pieces
        that could depend on their surroundings get a length of -1."""
        pieces = turned(self.index.pending)
        both = pa.array(pieces, pa.large_string())
        stems = pc.utf8_rtrim(both, characters=MARKS)
        known = pc.match_substring_regex(stems, WORD) if self.direct else pa.array(np.zeros(len(both), bool))
        known = known.to_numpy(zero_copy_only=False)
        cut = known & (pc.binary_length(stems).to_numpy() < pc.binary_length(both).to_numpy())
        of = stems.filter(pa.array(cut)).dictionary_encode()
        names = turned(of.dictionary.to_numpy(zero_copy_only=False).tolist())
        stem = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[of.indices.to_numpy()]
        added = len(pieces)
        pieces += turned(self.index.pending[added:])  # words that were not met alone
        words = np.concatenate([known & ~cut, np.ones(len(pieces) - added, bool)])
        while self.n + len(pieces) > len(self.lens):
            self.lens, self.starts = np.resize(self.lens, 2 * len(self.lens)), np.resize(self.starts, 2 * len(self.starts))
            self.hits = np.concatenate([self.hits, np.zeros(len(self.hits), np.int64)])
        here = np.flatnonzero(words)
        if len(here):
            lens, ids = self.of_words([pieces[i] for i in here.tolist()])
            if lens is None:
                each = self.encode([pieces[i] for i in here.tolist()])
                lens, ids = np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint32)
            self.put(self.n + here, lens, ids)
        rest, unsure = [], []
        for i in np.flatnonzero(~known).tolist():
            piece = pieces[i]
            body = piece[1:] if piece[0] == " " else piece
            bad = len(body) > LONGEST or (piece[0] == " " and (not body or body[0].isspace())) or any(m in body for m in self.marks)
            (unsure if bad else rest).append(i)
        each = self.encode([pieces[i] for i in rest])
        self.put(self.n + np.array(rest, np.int64), np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint32))
        self.put(self.n + np.array(unsure, np.int64), np.zeros(len(unsure), np.int64), np.zeros(0, np.uint32))
        self.lens[self.n + np.array(unsure, np.int64)] = -1
        if len(stem):
            lens, ids = self.row(stem)
            trimmed = pc.utf8_length(stems.filter(pa.array(cut))).to_numpy().tolist()
            ends = [pieces[i][k:] for i, k in zip(np.flatnonzero(cut).tolist(), trimmed, strict=True)]
            for end in set(ends) - self.ends.keys():
                self.ends[end] = self.encode([end])[0]
            ends = [self.ends[end] for end in ends]
            more = np.fromiter(map(len, ends), np.int64, len(ends))
            ids = np.insert(ids, np.repeat(np.cumsum(lens), more), np.fromiter(chain.from_iterable(ends), np.uint32))
            self.put(self.n + np.flatnonzero(cut), lens + more, ids)
        self.n += len(pieces)
        self.index.pending = []

    def batch(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        out: list[np.ndarray] = []
        for _, _, data, offsets in slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), SLICE):
            out += self.some(data, offsets)
        return out

    def some(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each of the texts in data."""
        out = [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        if not len(data):
            return out
        if self.n > REMEMBER:
            self.forget()
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        edge = data == 32
        line = np.flatnonzero(data == 10)
        line = line[~first[line] & ~first[line + 1]]  # inside a text, neither its first nor its last byte
        before, after = data[line - 1], data[line + 1]
        latin = (before >= 0x80) & (before < 0xC0) & (data[line - 2] == 0xC3)
        edge[line[SURE[after] & ((SURE[before] & (before < 0x80)) | latin)]] = True
        edge |= first[:-1]
        starts = np.flatnonzero(edge)
        bounds = np.append(starts, len(data))
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = turned(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        if self.index.pending:
            self.learn()
        at = numbers[found.indices.to_numpy()]
        self.hits[: self.n] += np.bincount(at, minlength=self.n)
        lens, flat = self.row(at)
        total = np.concatenate([[0], np.cumsum(lens)])
        place = np.searchsorted(starts, offsets)  # each text's first piece
        ends = total[place]
        unsure = np.concatenate([[0], np.cumsum(self.lens[at] < 0)])[place]
        for i in np.flatnonzero(np.diff(place)).tolist():
            out[i] = flat[ends[i] : ends[i + 1]]
        whole = np.flatnonzero(np.diff(unsure)).tolist()
        for i, ids in zip(whole, self.encode([data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole]), strict=True):
            out[i] = np.array(ids, np.uint32)
        return out


def coder(path: str) -> Coder:
    """This worker's coder for a vocabulary file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]
