from collections import defaultdict

import pytest

from millrace.llm import line_dedup, mixing


def test_targets_fill_to_limits(spark):
    sizes = spark.createDataFrame([("0a", 100), ("0b", 1000), ("0c", 10), ("1", 0)], "src string, source_size long")
    got = {r["src"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["0a"] == 200 and got["0c"] == 20 and got["1"] == 0
    assert got["0b"] == pytest.approx(1.5 * 1110 - 220)


def test_mix(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    again = sorted((r["doc_id"] or -1, r["taken"], r["position"] or -1) for r in mixing.mix(odd_docs.repartition(5)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"], r["position"] or -1) for r in rows)




def test_expand_orders_copies(edge_docs):
    rows = mixing.expand(mixing.mix(edge_docs)).collect()
    positions = [r["position"] for r in rows]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert all(0 <= r["words"] <= r["size"] for r in rows)


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).count() == 0


def spread(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, _, s, *_ in rows:
        for line in (t or "").split("\n"):
            if line.strip(" "):
                sites[line].add(s)
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    return {x: first[x] for x in sites if len(sites[x]) >= least}


def test_boilerplate_goes_everywhere_but_first(odd_docs):
    rows = [tuple(r) for r in odd_docs.collect()]
    bad = spread(rows, 10)
    assert "All rights reserved by all of them." in bad
    want = sorted(repr((i, t if t is None or i is None else "\n".join(x for x in t.split("\n") if x not in bad or bad[x] == i))) for i, t, *_ in rows)
    got = line_dedup.remove_boilerplate(odd_docs).collect()
    assert sorted(repr((r["doc_id"], r["text"])) for r in got) == want
    assert all(r["n_removed"] <= r["n_lines"] for r in got)


def test_lines_of_nothing(no_docs):
    assert line_dedup.remove_boilerplate(no_docs).count() == 0
