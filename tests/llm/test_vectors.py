"""Both vector searches against brute force, with ties, copies and unusable rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillweave.llm import posting_lists, segment_topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, score string, v string, dim string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)


def usable_rows(rows, zero_counts):
    out = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if not zero_counts and not any(v):
            continue
        out.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    return out


def brute(rows, measure, every, k, zero_counts):
    held = usable_rows(rows, zero_counts)
    found = {}
    for q in held:
        if q % every:
            continue
        scores = {}
        for i, vs in held.items():
            same = [measure(a, b) for a in held[q] for b in vs if len(a) == len(b)]
            if i != q and same:
                scores[i] = max(same)
        found[q] = sorted(((-s, i) for i, s in scores.items()))[:k]
    return {q: [(i, -s) for s, i in f] for q, f in found.items() if f}


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.fixture(scope="module")
def odd_rows():
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).round(2)) for i in range(60)]
    rows += [(100 + i, rows[10][1]) for i in range(15)] + [(10, rows[10][1]), (50, [0.5] * 6)]
    rows += [(200, None), (201, [NAN] * 6), (202, [INF, 0, 0, 0, 0, 0]), (203, [None, 1, 1, 1, 1, 1]), (250, [0] * 6), (None, [1] * 6)]
    return rows + [(300, [1, 2, 3]), (301, [3, 2, 1])]


def test_products_of_odd_rows(spark, odd_rows):
    rows = [(i, None if v is None else [x if x is None or not np.isfinite(x) else np.floor(256 * float(np.float32(x))) for x in v]) for i, v in odd_rows]
    got = as_lists(segment_topk.top_products(table(spark, rows), F.expr("vec_id % 10 = 0"), 5))
    assert got == brute(rows, lambda a, b: int(a @ b), 10, 5, True)


def test_statistics_bound_products():
    r = np.random.default_rng(2)
    a, b = r.normal(size=(40, 37)), r.normal(size=(50, 37))
    exact, before = a @ b.T, None
    for segments in (1, 4, 16, 64):
        bound = segment_topk.statistics(a, segments) @ segment_topk.statistics(b, segments).T
        assert (bound >= exact - 1e-9).all()
        before = bound


def test_most_candidates_are_excluded_early():
    """On vectors that vary by segment the coarse bound alone excludes nearly all."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)).repeat(8, axis=1) * 100
    rows = np.floor(centres[r.integers(40, size=4000)] + r.normal(size=(4000, 64)))
    queries = rows[:5]
    q, i, s = segment_topk.search_block(np.arange(5), queries, np.arange(4000), rows, 5)
    exact = queries @ rows.T
    for n in range(5):
        exact[n, n] = -np.inf
        assert s[q == n].tolist() == sorted(exact[n], reverse=True)[:5]
    bound = segment_topk.statistics(queries, 4) @ segment_topk.statistics(rows, 4).T
    least = np.sort(exact, axis=1)[:, -5][:, None]
    assert (bound >= least).mean() < 0.5


def test_products_beyond_doubles():
    rows = np.array([[2.0**40, 1], [2.0**20, 1], [2.0**22, 3], [2.0**22, 2]])
    _, ids, scores = segment_topk.search_block(np.array([0]), rows[:1], np.arange(4), rows, 3)
    assert ids.tolist() == [2, 3, 1] and scores.tolist() == [2**62 + 3, 2**62 + 2, 2**60 + 1]


def test_posting_lists_on_odd_rows(spark, odd_rows):
    """So few rows fill a few lists that every one is visited: the result is exact."""
    got = as_lists(posting_lists.nearest(table(spark, odd_rows), F.expr("vec_id % 10 = 0"), 5, reach=1e9, share=1.0))
    want = brute(odd_rows, lambda a, b: float(posting_lists.cosines(a, b[None, :])[0]), 10, 5, False)
    assert got.keys() == want.keys()
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall(spark):
    r = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(r.normal(size=(3000, 32)))]
    got = as_lists(posting_lists.nearest(table(spark, rows), F.expr("vec_id % 50 = 0"), 5))
    want = brute(rows, lambda a, b: float(posting_lists.cosines(a, b[None, :])[0]), 50, 5, False)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_graph_finds_near_centroids():
    r = np.random.default_rng(5)
    centroids = posting_lists.unit_rows(r.normal(size=(300, 16)))
    queries = posting_lists.unit_rows(r.normal(size=(100, 16)))
    ids, cos = posting_lists.CentroidGraph(centroids).nearest(queries, 20)
    exact = np.argsort(-(queries @ centroids.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids, exact)]) > 0.9
    assert (np.diff(cos, axis=1) <= 0).all()


def test_no_vectors(spark):
    empty = table(spark, [(1, None)]).filter("false")
    assert posting_lists.nearest(empty, F.lit(True)).collect() == []
    assert segment_topk.top_products(empty, F.lit(True)).collect() == []
    lone = table(spark, [(50, [1.0, 2.0])])
    assert posting_lists.nearest(lone, F.lit(True)).collect() == []
    assert segment_topk.top_products(lone, F.lit(True)).collect() == []


def test_best_counts_an_id_once():
    ids, scores = vectors.best(np.array([3, 3, 1, 2, 1]), np.array([5.0, 5, 5, 1, 0]), 2)
    assert ids.tolist() == [1, 3] and scores.tolist() == [5, 5]
