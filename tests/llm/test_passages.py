"""Removal of repeated passages against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from millrace.llm import common, paragraph_dedup


def test_passages_inside_lines_go_whole(spark):
    """A shared run of 24 to 60 words goes up to both ends, wherever it stands; one of 23 words stays."""
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k, n in enumerate([23, 24, 25, 30, *[51, 55, 60] * 8]):
        passage = prose(n)
        for i in (2 * k, 2 * k + 1):
            before, after = prose(rng.randrange(40)), prose(rng.randrange(1, 40))
            rows.append((i, " ".join(before + passage + after)))
            want[i] = (n, " ".join(before + after)) if i % 2 and n >= 24 else (0, rows[-1][1])
    got = paragraph_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in got} == want


def test_near_copies_of_short_lines(spark):
    """Lines of five words and more are compared; of four they are not."""
    line = [f"w{i}" for i in range(15)]
    rows = [(1, "one two three four five\na b c d\n" + " ".join(line)), (2, "x\none two three four five\na b c d\n" + " ".join([*line[:14], "y"]))]
    got = {r["doc_id"]: r["text"] for r in paragraph_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x\na b c d\n"}


def test_followers_link_to_other_lines(spark):
    """Of p ~ x and x ~ c, where p is not near c, the link x ~ c is found too, whichever line comes first in the bucket."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[k : k + 80]) for k in (0, 8, 16)]  # Jaccard 68/84 for neighbours, 60/92 for the outer two
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = {r["doc_id"]: r["h"] for r in paragraph_dedup.rows_of_lines(docs).collect()}
    same = spark.createDataFrame([(h, [7]) for h in lines.values()], "h long, bands array<long>")
    links = {frozenset((r["a"], r["b"])) for r in paragraph_dedup.line_links(same, docs).collect()}
    assert links == {frozenset((lines[0], lines[1])), frozenset((lines[1], lines[2]))}


def shingle_set(words: list[str]) -> frozenset:
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def removed_by_rule(rows: list[tuple]) -> dict[int, int]:
    """Words removed from each document: near lines by all pairs of lines, runs of 24 words by comparison with all before."""
    split = {i: [line.lower().split() for line in t.split("\n")] for i, t in rows}
    lines = sorted({tuple(x) for of in split.values() for x in of if len(x) >= 5})
    sets = [shingle_set(x) for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                root[find(i)] = find(j)
    at = {x: find(i) for i, x in enumerate(lines)}
    first: dict[int, int] = {}
    for i in sorted(split):
        for x in split[i]:
            if len(x) >= 5:
                first.setdefault(at[tuple(x)], i)
    seen: dict[tuple, int] = {}
    out = {}
    for i in sorted(split):
        flat = [w for x in split[i] for w in x]
        gone, n = [False] * len(flat), 0
        for x in split[i]:
            if len(x) >= 5 and first[at[tuple(x)]] < i:
                gone[n : n + len(x)] = [True] * len(x)
            n += len(x)
        for k in range(len(flat) - 23):
            w = tuple(flat[k : k + 24])
            if seen.setdefault(w, i) < i:
                gone[k : k + 24] = [True] * 24
        out[i] = sum(gone)
    return out


def some_rows(seed: int) -> list[tuple]:
    """Documents that share passages in lines, chains of near lines, copies, and a line that is one word over and over."""
    rng = random.Random(seed)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, chain = [prose(rng.randrange(20, 70)) for _ in range(6)], prose(160)
    texts = []
    for k in range(60):
        lines = [prose(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]
        if k % 2:
            part = shared[k % 6]
            lines.insert(0, prose(rng.randrange(12)) + part[rng.randrange(4) :] + prose(rng.randrange(12)))
        if k % 3 == 0:
            near = list(shared[k % 6])
            near[rng.randrange(len(near))] = "edited"
            lines.append(near)
        if k % 5 == 0:
            start = 4 * (k // 5)
            lines.append(chain[start : start + 100])
        texts.append("\n".join(" ".join(x) for x in lines))
    texts += [texts[3], texts[3].upper(), "la " * 70, "x la " + "la " * 50, "", "\n"]
    return [(i * 37 % 101, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removal_against_brute_force(spark, seed):
    rows = some_rows(seed)
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == removed_by_rule(rows)


def test_chains_stay_together(spark):
    """Chains of five lines, each near the next only: every link between lines of a chain's ends is found through the others."""
    rng = random.Random(9)
    rows, at = [], {}
    for c in range(150):
        words = [f"c{c}x{rng.randrange(10**9)}" for _ in range(120)]
        order = list(range(5))
        rng.shuffle(order)
        for k in order:
            at[len(rows)] = c
            rows.append((len(rows), " ".join(words[8 * k : 8 * k + 80])))
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: 0 if i % 5 == 0 else 80 for i in got}
    assert got == want


def test_a_bucket_in_many_tiles(spark, monkeypatch):
    """Tiles of a few lines give the links that one tile gives."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:i], f"y{rng.randrange(10**6)}", *words[i + 1 :]]) for i in range(5, 55)]
    texts += [" ".join([*words[:20], *[f"z{rng.randrange(10**6)}" for _ in range(20)], *words[40:]]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = paragraph_dedup.rows_of_lines(docs).collect()
    same = spark.createDataFrame([(r["h"], [7]) for r in lines], "h long, bands array<long>")

    def found():
        roots = {r["node"]: r["component"] for r in paragraph_dedup.components(paragraph_dedup.line_links(same, docs)).collect()}
        return sorted(roots.get(r["h"], r["h"]) for r in lines)

    whole = found()
    monkeypatch.setattr(paragraph_dedup, "TILE", 1000)
    assert found() == whole and len(set(whole)) > 40


def test_grams_go_after_their_last_use(spark):
    """The table of grams, the largest that op8 writes, is deleted before the texts are cut; the rest of the lists is compressed."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(4)], "doc_id long, text string")
    before = set(shared.iterdir())
    got = {r["doc_id"]: r["n_removed"] for r in paragraph_dedup.remove_passages(docs).collect()}
    assert got[0] == 0 and all(got[i] >= 40 for i in (1, 2, 3))
    left = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert "grams" not in left and {"phrases", "lines"} <= left


def test_classes_of_phrases_go_after_their_last_use(spark):
    """The lists of classes and of their windows are deleted before lines are compared."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(3)], "doc_id long, text string")
    before = set(shared.iterdir())
    assert paragraph_dedup.repeated_windows(docs).where("doc_id > 0").count()
    left = {p.name.split("-")[0] for p in set(shared.iterdir()) - before}
    assert "repeated" in left and not {"grams", "classes", "single"} & left


def test_bands_go_after_their_last_use(spark, monkeypatch):
    """Once lines have met in buckets, neither their bands nor a shuffle of them are kept while they are compared."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join([*words[:i], f"y{rng.randrange(10**6)}", *words[i + 1 :]]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = spark.createDataFrame(paragraph_dedup.rows_of_lines(docs).select("h", "bands").collect(), "h long, bands array<long>")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    shuffles = lambda: {int(k) for k in tracker.shuffleStatuses().keySet().mkString(",").split(",") if k}
    before, gone, kept = shuffles(), [], []
    discard, verified = paragraph_dedup.discard, paragraph_dedup.verified

    def discarded(session, at):
        gone.append(Path(at).name.split("-")[0])
        discard(session, at)

    def compared(pairs, needed):
        held = shuffles() - before
        for _ in range(20):  # Spark deletes them in a thread of its own
            if held:
                common.release(spark)
                held &= shuffles()
        kept.append(held)
        assert "bands" in gone
        return verified(pairs, needed)

    monkeypatch.setattr(paragraph_dedup, "discard", discarded)
    monkeypatch.setattr(paragraph_dedup, "verified", compared)
    assert paragraph_dedup.line_links(lines, docs).count()
    assert kept == [set()]


def test_grams_go_before_texts_are_dealt_out(spark, tmp_path, monkeypatch):
    """The table of grams is deleted before the texts are dealt out beside their shared grams, not only after that."""
    monkeypatch.setattr(common, "shared_path", lambda session, label: f"{tmp_path}/{label}")
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(3)], "doc_id long, text string")
    there, rows_of_phrases = [], paragraph_dedup.rows_of_phrases

    def phrases(texts):
        there.extend(p.name for p in tmp_path.iterdir())
        return rows_of_phrases(texts)

    monkeypatch.setattr(paragraph_dedup, "rows_of_phrases", phrases)
    assert paragraph_dedup.repeated_windows(docs).where("doc_id > 0").count()
    assert there == []


def test_release_lets_go_of_the_last_step(spark):
    """What Python has let go of just before is gone after one release, not only after the bridge's next look."""
    held = []
    for _ in range(6):
        x = spark.sparkContext._jvm.java.util.ArrayList()
        weak = spark.sparkContext._jvm.java.lang.ref.WeakReference(x)
        del x
        common.release(spark)
        held.append(weak.get() is not None)
    assert held == [False] * 6


def test_distinct_windows_of_phrases():
    """Windows of many phrases at once are those of each alone, also where a text repeats itself."""
    rng = np.random.default_rng(4)
    for kinds in (1, 3, 10**9):
        w, edges = rng.integers(0, kinds, 200).astype(np.uint64), np.array([0, 1, 5, 60, 61, 199])
        for a, b in ((edges[:-1], edges[1:]), (edges[:0], edges[:0]), (edges[3:0:-2], edges[4:1:-2])):
            own, n = paragraph_dedup.distinct_windows(w, a, b)
            assert [sorted(x.tolist()) for x in np.split(own, np.cumsum(n))][: len(n)] == [np.unique(w[i:j]).tolist() for i, j in zip(a, b, strict=True)]
            assert len(own) == n.sum()
