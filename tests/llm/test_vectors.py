import math

import numpy as np
import pytest

from millrace.llm import embedding_dedup, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rep long"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    rows = [(i, [float(v) for v in r], 0, "clash", 1) for i, r in enumerate(x)]
    for i in range(60):  # near copies at various distances
        y = x[i % 7] + rng.normal(size=16) * (0.05 + 0.15 * (i % 5)) * np.linalg.norm(x[i % 7]) / 4
        rows.append((300 + i, [float(v) for v in y], 1, "clash", 1))
    rows += [(400 + i, rows[3][1], 1, "clash", 1) for i in range(20)]
    rows += [(500, None, 0, None, None), (501, [0.0] * 16, 0, None, None), (502, [math.nan] + [1.0] * 15, 0, None, None), (503, [None] + [1.0] * 15, 0, None, None), (504, [math.inf] * 16, 0, None, None), (505, [], 0, None, None), (506, [1.0], 0, None, None), (None, rows[0][1], 0, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def usable(vectors):
    rows = [r for r in vectors.collect() if r[0] is not None and r[1] and len(r[1]) == 16 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)


def test_links_and_components(vectors):
    ids, x = usable(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    part = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(linked), strict=True):
            least = min(part[ids[a]], part[ids[b]])
            changed |= part[ids[a]] != least or part[ids[b]] != least
            part[ids[a]] = part[ids[b]] = least
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert len(got) == vectors.count()
    found = sum(got[i]["n_links"] for i in ids)
    assert 0.95 * linked.sum() <= found <= linked.sum() and found > 0
    assert np.mean([got[i]["component_id"] == part[i] for i in ids]) > 0.98
    for i in range(500, 507):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(1)
    d1, d2 = rng.random((20, 9)), rng.random((20, 9))
    for n in (1, 5, 40):
        want = np.argsort((d1[:, :, None] + d2[:, None, :]).reshape(20, -1), 1)[:, :n]
        assert (embedding_dedup.nearest_cells(d1, d2, n) == want).all()


def test_recall_of_neighbours(vectors):
    ids, x = usable(vectors)
    got = {}
    for r in hnsw.search_all(vectors, every=5, k=10, shard=150).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    assert set(got) == {i for i in ids if i % 5 == 0}
    for q, rows in got.items():
        rows.sort()
        scores = x @ x[ids.index(q)]
        best = sorted(((-s, i) for s, i in zip(scores, ids, strict=True) if i != q))[:10]
        hit += len({i for _, i in best} & {i for _, i, _ in rows})
        n += len(best)
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(abs(s - scores[ids.index(i)]) < 1e-9 for _, i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert hit / n >= 0.95


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"]) for r in hnsw.search_all(few, every=20).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(few).collect()) == [(0, 1, 0), (1, 0, 1), (2, 1, 0)]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    assert hnsw.search_all(none).count() == 0


def test_lengths_compare_among_themselves(spark):
    """Doubles that floats cannot tell apart, vectors of one, two and three components, and repeated ids."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 1e-12, 0.0]), (4, [0.0, 0.0, 5.0]), (5, [3.0]), (6, [7.0]), (7, [-1.0]), (8, [1e200, 1e200]), (9, [1e-200, 1e-200]), (9, [1e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 1, 0), (1, 1, 0), (2, 1, 2), (3, 1, 2), (4, 0, 4), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 2, 8), (9, 2, 8), (9, 2, 8)]
    near = hnsw.search_all(spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1e-12, 0.0]), *rows[1:5]], "vec_id long, embedding array<double>"), every=20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in near) == [(0, 1, 1, 2.0), (20, 1, 2, 1.0), (20, 2, 3, 1.0 + 1e-24), (20, 3, 4, 0.0)]


def test_planted_links_over_tiles(spark):
    """Ten thousand vectors, a third of them near one centre, so that a cell is dealt out over tiles; ids with a common stride."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8000, 16))
    x[:2600] = x[0] + rng.normal(size=(2600, 16)) * 0.02
    x[2600:3000] = x[3000:3400] + rng.normal(size=(400, 16)) * 0.05
    ids = np.arange(len(x)) * 64
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(8)
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    linked = y @ y.T >= 0.9
    want = linked.sum(1) - 1
    group = embedding_dedup.GROUP
    try:
        embedding_dedup.GROUP = 512
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    finally:
        embedding_dedup.GROUP = group
    found = np.array([got[int(i)]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    assert found[2600:3000].sum() >= 0.99 * want[2600:3000].sum()
    assert len({got[int(i)]["component_id"] for i in ids[:2600]}) == 1


def test_graphs_are_walked_in_step():
    """Queries that walk a graph together find what brute force finds, copies and an own k each included; built in step too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[1400:] = x[:100]
    ids = np.arange(1500)[::-1] * 3
    graph = hnsw.Graph(ids, x)
    for layer, near in enumerate(graph.near):
        nodes = np.flatnonzero(graph.rows[layer] >= 0)
        for v in nodes.tolist():
            held = near[graph.rows[layer][v]][: graph.used[layer][graph.rows[layer][v]]].tolist()
            assert len(set(held)) == len(held) and v not in held and min(held, default=0) >= 0 and set(held) <= set(nodes.tolist())
    ks = [5 + i % 3 for i in range(600)]
    got = list(graph.search_all(x[:600], ks))
    hit = n = 0
    for q, k, found in zip(x[:600].astype(float), ks, got, strict=True):
        best = sorted(zip(-(x.astype(float) @ q), ids.tolist(), strict=True))[:k]
        assert len(found) == k and found == sorted(found, key=lambda r: (-r[0], r[1]))
        hit += len({i for _, i in best} & {i for _, i in found})
        n += k
    assert hit / n >= 0.97 and got[7] == graph.search(x[7], ks[7])


def test_units_of_parts():
    """Vectors are read from the buffers of a part of a batch, of floats and of doubles."""
    import pyarrow as pa

    for kind in (np.float32, np.float64):
        x = np.arange(1, 41, dtype=kind).reshape(8, 5)
        held = pa.array([r.tobytes() for r in x], pa.binary())
        want = x[3:6].astype(float) / np.linalg.norm(x[3:6].astype(float), axis=1)[:, None]
        for part in (held.slice(3, 3), pa.chunked_array([held.slice(3, 1), held.slice(4, 2)])):
            assert np.allclose(embedding_dedup.unit(part, 5), want, rtol=1e-12)
    assert embedding_dedup.unit(held.slice(0, 0), 5).shape == (0, 5)
