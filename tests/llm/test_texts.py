import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from millrace.llm import ngram_join, paragraph_dedup, quality, suffix_dedup
from millrace.llm.common import components
from millrace.llm.textsets import words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def test_words_of_many_texts():
    texts = ["", " a  B\tab ", "b", "\n", "é A"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    h, start, end, first = words(np.frombuffer(data, np.uint8), offsets)
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == ["a", "B", "ab", "b", "é", "A"]
    assert first.tolist() == [0, 0, 3, 4, 4, 6]
    assert h[1] == h[3] and h[0] == h[5] and len(set(h.tolist())) == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3), (260, 9), (9, 8)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 7 for i in range(200, 260))
    assert got[260] == got[9] == got[8] == 8 and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(odd_docs):
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    sets = []
    for i, t in rows:
        w = word_list(t)
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    part = {i: i for i, _ in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for i, x in sets:
            for j, y in sets:
                if i is not None and j is not None and (i == j or x and 100 * len(x & y) >= 80 * len(x | y)):
                    least = min(part[i], part[j])
                    changed |= part[i] != least or part[j] != least
                    part[i] = part[j] = least
    got = sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in ngram_join.join_documents(odd_docs).collect())
    assert got == sorted(repr((i, len(x), part.get(i))) for i, x in sets)
    assert len(set(part.values())) < len(part)


def test_chain_of_near_copies(spark):
    """Each text links with the next only: the whole chain is one component."""
    words_ = [f"w{i}" for i in range(400)]
    texts = [(k, " ".join(words_[8 * k : 8 * k + 120])) for k in range(30)] + [(99, " ".join(words_[:300]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(30)) and got[99] == 99


def repeats(rows):
    """Per document: which bytes a string of 50 bytes of a smaller document covers."""
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if i is not None and first.get(b[p : p + 50], i) < i:
                gone[p : p + 50] = True
        yield i, b, gone


@pytest.mark.parametrize("hot", [2, 512])
def test_repeated_bytes(odd_docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = []
    for i, b, gone in repeats([(r[0], r[1]) for r in odd_docs.collect()]):
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        want.append(repr((i, len(b), list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), hashlib.sha256(b[:0] + bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())))
    got = [repr((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], hashlib.sha256(r["kept"]).hexdigest())) for r in suffix_dedup.find_repeats(odd_docs).collect()]
    assert sorted(got) == sorted(want)


def test_repeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abcd"), 3000))
    rows = [(1, text), (2, "z" + text[100:2900] + "z"), (3, text[::-1])]
    got = {r["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in suffix_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(g.sum()) for i, _, g in repeats(rows)} and got[2] == 2800


def test_passages_are_found(spark, odd_docs):
    rows = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    got = paragraph_dedup.remove_passages(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = dict(rows)
    carriers = sorted(i for i in ((7 * k) % 101 for k in range(11, 18)))
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by_id[i]["n_removed"] > 0 for i in carriers] == [False] + [True] * 6
    for i in carriers[1:]:
        assert 30 <= by_id[i]["n_removed"] <= 62 and len(by_id[i]["text"]) < len(texts[i])
    lone = [by_id[(7 * k) % 101] for k in range(48, 68)]
    assert sum(r["n_removed"] for r in lone) == 0
    for r in got:
        if r["doc_id"] is None or r["text"] is None:
            assert r["n_removed"] == 0


def test_near_lines_are_found(spark):
    line = [f"w{i}" for i in range(80)]
    edited = [*line[:40], "other", *line[41:]]
    rows = [(1, "intro\n" + " ".join(line)), (2, " ".join(edited) + "\nmore"), (3, " ".join(line[::-1]))]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in paragraph_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == got[3][0] == 0 and got[2] == (80, "more")


def test_tuning_reaches_recall():
    bands, n = paragraph_dedup.tune(0.8, 0.999, 32)
    assert 1 - (1 - 0.8**n) ** bands >= 0.999 and bands * n <= 32


def plain_model(texts: list[str]):
    """The probability of an n-gram's last character under the interpolated modified Kneser-Ney model of texts."""
    n, start = quality.ORDER, quality.START
    counts = {n: defaultdict(int)}
    for t in texts:
        s = start * (n - 1) + t
        for j in range(len(t)):
            counts[n][s[j : j + n]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = defaultdict(int)
        for g, c in counts[k + 1].items():
            counts[k][g[1:]] += c if g.startswith(start * 2) else 1
    ds = {k: quality.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    by = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            by[k][g[:-1]].append(v)

    def probability(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k = len(g)
        d, same, below = ds[k], by[k].get(g[:-1]), probability(g[1:])
        if not same:
            return below
        c = counts[k].get(g, 0)
        return (c - d[min(c, 3) - 1] if c else 0) / sum(same) + sum(d[min(v, 3) - 1] for v in same) / sum(same) * below

    return probability


def trained(spark, texts, train):
    rows = spark.createDataFrame([(t, int(i < train)) for i, t in enumerate(texts)], "text string, fold int").repartition(3)
    return quality.gather(rows)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("ab c"), 200)) for _ in range(20)]
    p = plain_model(texts)
    for h in ("abca", quality.START * 3 + "a", quality.START * 4, "xxxx", "xxab"):
        assert sum(p(h + c) for c in "ab c") + p(h + "?") == pytest.approx(1)


def test_kneser_ney_against_plain_python(spark):
    texts = ["abracadabra abracadabra", "cab bad dab", "Äb ra \U0001f600 cad\n", "", "abra unseen ztext \U0001f600"]
    grams = trained(spark, texts, 3)
    bits = {r["g"]: r["bits"] for r in grams.join(quality.kneser_ney(grams), "key").collect()}
    p = plain_model(texts[:3])
    s = [quality.START * 4 + t for t in texts]
    assert set(bits) == {x[j : j + 5] for x in s for j in range(len(x) - 4)}
    for g, b in bits.items():
        assert b == pytest.approx(-np.log2(p(g)), abs=1e-4)


@pytest.mark.parametrize("sent", [0, 10**6])
def test_classifier_against_plain_python(spark, sent):
    """perplexity, limits and kept of the query, from whole texts, whichever way the probabilities go."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 200))) for _ in range(150)] + ["#$%^&*" * 40, "aaaa " * 100, "", None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels, ["doc_id"], sent=sent).collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.when(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(quality.HELD)) == 0, 2).otherwise(1).alias("f")).collect()}
    p = plain_model([t for i, t in enumerate(texts[:140]) if fold[i] == 1])
    cost = {i: sum(-np.log2(p((quality.START * 4 + t)[j : j + 5])) for j in range(len(t))) for i, t in enumerate(t or "" for t in texts)}
    held = [i for i in range(140) if fold[i] == 2]
    mean = sum(cost[i] for i in held) / sum(len(texts[i]) for i in held)
    ppl = {i: 2 ** ((cost[i] + quality.PRIOR * mean) / (len(texts[i] or "") + quality.PRIOR)) for i in cost}
    low, high = np.quantile([ppl[i] for i in held], [quality.LOW, quality.HIGH])
    for i, r in got.items():
        assert r["n_symbols"] == len(texts[i] or "") and r["perplexity"] == pytest.approx(ppl[i], rel=1e-4)
        assert r["lowest"] == pytest.approx(low, rel=1e-4) and r["highest"] == pytest.approx(high, rel=1e-4)
        if min(abs(ppl[i] - low), abs(ppl[i] - high)) > 1e-3:
            assert r["kept"] == (not texts[i] or low <= ppl[i] <= high)
    assert not got[150]["kept"] and got[152]["kept"] and got[153]["kept"]


def test_classifier_tells_junk_from_prose(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels, ["doc_id"]).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["toxic"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.1


def test_classifier_keeps_what_it_cannot_judge(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd_docs, labels, ["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count() and all(r["kept"] for r in rows)
    known = spark.createDataFrame([(None, 1, 0), (6, 1, None), (7, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.classify(odd_docs, known, ["doc_id"]).collect()) == odd_docs.count()
    assert quality.classify(no_docs, labels, ["doc_id"]).count() == 0


@pytest.mark.parametrize("run", [ngram_join.join_documents, suffix_dedup.find_repeats, paragraph_dedup.remove_passages])
def test_nothing_in_nothing_out(run, no_docs):
    assert run(no_docs).count() == 0


def test_every_trusted_document_counts(spark, sf_dir):
    """More trusted documents than go to all executors: they still all train the model and give the thresholds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = ["doc_id", "n_symbols", "perplexity", "lowest", "highest", "kept"]
    sent, shuffled = (sorted((r[0], r[1], *(round(x, 6) for x in r[2:5]), r[5]) for r in quality.classify(docs, labels, ["doc_id"], joined=n).select(columns).collect()) for n in (10**6, 10))
    assert sent == shuffled and not hasattr(quality, "MAX_TRUSTED")


def test_quantiles_are_those_of_all_values(spark):
    rng = np.random.default_rng(5)
    values = [(lang, float(x)) for lang, n in (("a", 5000), ("b", 3), (None, 700), ("c", 1)) for x in np.round(np.exp(rng.normal(size=n)), 2) + 0.01]
    df = spark.createDataFrame(values, "lang string, perplexity double").repartition(5)
    got = {r["lang"]: r for r in quality.quantiles(df, {"low": 0.001, "mid": 0.5, "high": 0.999, "last": 1.0}).collect()}
    assert set(got) == {"a", "b", "c", None}
    for lang, r in got.items():
        mine = [x for k, x in values if k == lang]
        assert r["n"] == len(mine) and np.allclose([r["low"], r["mid"], r["high"], r["last"]], np.quantile(mine, [0.001, 0.5, 0.999, 1.0]), rtol=1e-12)


def test_few_pairs_take_few_tasks(spark, monkeypatch):
    """Few pairs of many partitions are handled by one task, with the same answers as by many."""
    from millrace.llm import common

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 30 + i))) for i in range(8)], "doc_id long, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long").repartition(40)
    one = ngram_join.compare(pairs, docs)
    assert one.rdd.getNumPartitions() == 1
    monkeypatch.setattr(ngram_join, "SENT", 0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, ngram_join.compare(pairs, docs).collect())) == [(i, i + 1, 25, 26, 26) for i in range(7)]
    monkeypatch.setattr(common, "contract", None)  # no forest of each partition is made
    assert {r["component"] for r in components(common.cut(pairs), held=True).collect()} == {0}


def test_equal_windows_whatever_their_hashes(monkeypatch):
    rng = np.random.default_rng(4)
    rows = np.zeros((300, suffix_dedup.CONTEXT + 1), np.uint8)
    rows[:, :-1] = rng.integers(0, 2, (300, 4))[:, rng.integers(0, 4, suffix_dedup.CONTEXT)]
    rows[:, -1] = rng.integers(1, suffix_dedup.SPAN + 1, 300)
    docs = rng.integers(0, 40, 300)
    least, want = {}, np.zeros(300, np.uint32)
    windows = [(i, k, rows[i, k : k + suffix_dedup.WIDTH].tobytes()) for i in range(300) for k in range(rows[i, -1])]
    for i, _, w in windows:
        least[w] = min(least.get(w, 99), docs[i])
    for i, k, w in windows:
        want[i] |= np.uint32(least[w] < docs[i]) << np.uint32(k)
    assert want.any() and (suffix_dedup.sort_suffixes(rows, docs) == want).all()
    monkeypatch.setattr(suffix_dedup, "FOLD", np.zeros(len(suffix_dedup.FOLD), np.uint64))  # all hashes clash
    assert (suffix_dedup.sort_suffixes(rows, docs) == want).all()
