"""Multi-index search: recall against brute force, traversal order, copies, edge rows."""

import numpy as np
import pytest

from iolens.llm import multi_index as M


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        out[q] = sorted((float(v), i) for v, i in zip(d, ids) if i != q)[:k]
    return out


def result(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    want = brute(ids, x, [i for i in ids if i % 100 == 0])
    got = result(M.op3_multi_index(spark, d).collect())
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hit = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    for q, near in got.items():  # scores are exact
        for s, i in near:
            assert s == pytest.approx(np.sqrt(((x[ids.index(i)] - x[ids.index(q)]) ** 2).sum()), abs=1e-12)


def test_traversal_is_in_order_of_the_sums():
    rng = np.random.default_rng(0)
    d1, d2, cells = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    got = M.traverse(d1, d2, cells, 10**9)
    assert set(got) == {tuple(map(int, c)) for c in np.argwhere(cells)}
    sums = [d1[i] + d2[j] for i, j in got]
    assert sums == sorted(sums)


def test_everything_found_when_everything_is_asked_for(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(230, 6)), 1)
    x[50:120] = x[50]  # one vector many times, queries among them
    x[100] = x[50]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, i int, score int")
    want = brute(list(range(230)), x, [0, 20, 40, 60, 80, 100, 120, 140, 160, 180, 200, 220])
    got = result(M.search(df, every=20, fraction=1.0, chunk_rows=9, block_queries=3, codes=4).collect())
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_chunks_hold_whole_or_split_centroids():
    first, split, n = M.deal([3, 4, 25, 0, 9, 2], 10)
    assert (first, split, n) == ([0, 0, 1, 4, 4, 5], [1, 1, 3, 1, 1, 1], 6)
    assert M.deal([], 10) == ([], [], 0) and M.deal([10], 10) == ([0], [1], 1)


def test_recall_where_not_all_entries_are_seen(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 16)) + 4 * rng.normal(size=(20, 16))[rng.integers(0, 20, 6000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = result(M.search(df, fraction=0.05, least=100, chunk_rows=1500).collect())
    want = brute(list(range(6000)), x, list(got))
    assert len(got) == 60
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in got]) >= 0.9


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]),
            (8, [1.0, 0.1]), (8, [1.0, 0.1]), (None, [1.0, 1.0]), (100, [0.5, 0.5]), (200, [nan, nan])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(M.search(df).collect())
    assert {q: [i for _, i in v] for q, v in got.items()} == {0: [1, 8, 100], 100: [1, 8, 0]}
    assert M.search(df.limit(0)).count() == 0
    assert M.search(df.filter("vec_id = 0")).count() == 0
