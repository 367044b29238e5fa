"""The pipeline's stages on edge cases, and run() against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import line_dedup, mixing, packing, quality

#: Names that operators give to their working columns or to what they add.
NAMES = "size source_size target taken position source_before kind copy words src digest bucket base weight h site line gone row n_lines n_removed n_symbols perplexity lowest highest kept bits fold id component_id class_id node fp n s rest prefix centre _salt _n _range a.b".split()
KEEPING = [(name, stage) for name, stage in corpus_pipeline.STAGES[:-1]]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """A folder with labels for the edge cases' documents."""
    at = tmp_path_factory.mktemp("tables")
    spark.range(0, 101).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def clashing(odd_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    return plain.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(n) for n in NAMES]).cache()


@pytest.mark.parametrize(("name", "stage"), KEEPING)
def test_stages_carry_columns_of_any_name(name, stage, spark, clashing, folder):
    out = stage(spark, clashing, folder)
    assert out.columns == clashing.columns and out.schema["n_chars"].dataType == clashing.schema["n_chars"].dataType
    rows = out.collect()
    assert rows
    for r in rows:
        of = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[n] == f"{n}-{of}" for n in NAMES)
    known = {r["doc_id"]: r["text"] for r in clashing.select("doc_id", "text").collect()}
    if name in ("quality_classifier", "ngram_jaccard_join"):
        assert all(r["text"] == known[r["doc_id"]] for r in rows)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_of_nothing(name, stage, spark, no_docs, folder):
    assert stage(spark, no_docs, folder).count() == 0


def test_operators_carry_columns_of_any_name(clashing, folder, spark):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    for out, added in (
        (mixing.mix(clashing), mixing.ADDED),
        (line_dedup.remove_boilerplate(clashing), ["n_lines", "n_removed"]),
        (quality.classify(clashing, labels, clashing.columns), ["n_symbols", "perplexity", "lowest", "highest", "kept"]),
    ):
        assert sorted(out.columns) == sorted(set(clashing.columns) | set(added))
        for r in out.collect():
            of = "null" if r["doc_id"] is None else str(r["doc_id"])
            assert all(r[n] == f"{n}-{of}" for n in NAMES if n not in added)


def without_boilerplate(docs: dict) -> dict:
    sites, first = defaultdict(set), {}
    for i, (text, source) in sorted(docs.items()):
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites[line].add(source)
                first.setdefault(line, i)
    gone = {x for x in sites if len(sites[x]) >= line_dedup.MIN_SITES}
    out = {}
    for i, (text, source) in docs.items():
        if text is not None:
            left = [x for x in text.split("\n") if x not in gone or first[x] == i]
            if len(left) < len(text.split("\n")) and not "\n".join(left).strip(" "):
                continue
            text = "\n".join(left)
        out[i] = (text, source)
    return out


def one_of_each_group(docs: dict) -> dict:
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, (text, _) in docs.items():
        words = WORD.findall((text or "").translate(lower))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    part = {i: i for i in docs}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                ra, rb = root(a), root(b)
                part[max(ra, rb)] = min(ra, rb)
    return {i: d for i, d in docs.items() if root(i) == i}


def mixed(docs: dict) -> list:
    """(doc_id, text) of each copy."""
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in docs.items()}
    members = defaultdict(list)
    for i, (_, source) in docs.items():
        members[source].append(i)
    sources = sorted(members, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    held = {s: sum(size[i] for i in members[s]) for s in sources}
    target, left, open_ = {}, 1.5 * sum(held.values()), set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * held[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2 * held[s]
            left -= target[s]
            open_.discard(s)
    out = []
    for s in sources:
        goal, before = int(target[s] + 0.5), 0
        passes = goal // held[s] if held[s] else 0
        for i in sorted(members[s], key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            taken = passes * size[i] + min(max(goal - passes * held[s] - before, 0), size[i])
            before += size[i]
            if not size[i]:
                out.append((i, docs[i][0]))
            while taken > 0:
                out.append((i, docs[i][0] if taken >= size[i] else " ".join(WORD.findall(docs[i][0])[:taken])))
                taken -= size[i]
    return out


def test_run_against_plain_python(spark, sf_dir):
    from tokenizers import Tokenizer

    all_docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in all_docs.collect()}
    judged = quality.classify(all_docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"]).collect()  # test_texts.py holds the model
    assert all(r["kept"] == (r["n_symbols"] == 0 or r["lowest"] <= r["perplexity"] <= r["highest"]) for r in judged)
    kept = {r["doc_id"] for r in judged if r["kept"]}
    docs = one_of_each_group(without_boilerplate({i: d for i, d in rows.items() if i in kept}))
    tokenizer, want = Tokenizer.from_file(packing.word_vocabulary()), Counter()
    for i, text in mixed(docs):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
