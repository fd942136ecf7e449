"""Operators 2 and 6 against all pairs."""

import numpy as np
import pytest

from linklens.llm import bit_search as B
from linklens.llm import pivot_search as P
from tests.llm import brute
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, pivot string, query string, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def hot():
    """Clusters, one vector that a third of the rows share, and every kind of unusable row."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 16)).astype(np.float32).tolist()) for i in range(900)]
    shared = np.round(rng.normal(size=16), 2).astype(np.float32).tolist()
    rows += [(i, shared) for i in range(900, 1350)]
    return rows + [(1350, None), (1400, [0.0] * 16), (1351, [float("nan")] * 16), (1352, [float("inf")] * 16), (1353, [None] * 16), (None, [1.0] * 16),
                   (1450, [1.0, -2.0, 0.5]), (1500, [])]


def padded(rows, width=16):
    return [(i, None if v is None else [*v, *[0.0] * (width - len(v))]) for i, v in rows]


def test_pivot_search_is_exact(spark, hot):
    got = answers(P.top_products(frame(spark, hot), every=50, k=5, pivots=6, rings=4, block=64))
    want = brute.top(padded(hot), 50, 5, True)
    assert got == want and len(want) == 30


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(4)
    vecs = rng.integers(-300, 300, (500, 8))
    index = P.Pivots(vecs[:100], float((vecs ** 2).sum(1).max()), 5, 4)
    pivot, away = index.nearest(index.lift(vecs))
    rings = [(int(p), 0, float(d), float(d)) for p, d in zip(pivot, away)]
    assert (index.bounds(vecs[:50], rings) >= vecs[:50] @ vecs.T).all()


@pytest.mark.parametrize("size", [1e5, 3e7, 2e9])
def test_large_components_are_exact(spark, size):
    """Products beyond 2^53, and components beyond 32 and 53 bits, against whole numbers of any length."""
    rng = np.random.default_rng(7)
    vecs = [(rng.integers(-1000, 1000, 3) / 512 + [0.0, 0.0, size * (i % 3 == 0)]).tolist() for i in range(120)]
    vecs[50] = [1.25, -3.5, size]
    vecs[100] = [0.003, 7.5, 2.0 ** 40 / size]
    whole = [[int(np.floor(256 * x)) for x in v] for v in vecs]
    rows = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    want = {q: sorted(((sum(a * b for a, b in zip(whole[q], whole[j])), -j) for j in range(120) if j != q), reverse=True)[:5] for q in (0, 50, 100)}
    if max(s for top in want.values() for s, _ in top) >= 2 ** 63:
        with pytest.raises(Exception, match="beyond 64 bits"):
            P.top_products(rows, block=32).collect()
        return
    assert answers(P.top_products(rows, block=32)) == {q: [(r, -j, s) for r, (s, j) in enumerate(top, 1)] for q, top in want.items()}


def test_products_of_any_length():
    big = np.array([[2.0 ** 70, 3.0], [-(2.0 ** 70), 5.0]])
    assert P.products(big, np.array([[1.0, 2.0 ** 60]])).tolist() == [[2 ** 70 + 3 * 2 ** 60], [-(2 ** 70) + 5 * 2 ** 60]]
    assert P.products(np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 28, 1.0]])).tolist() == [[2 ** 58 + 1]]


def test_scores_beyond_a_long_are_errors(spark):
    rows = [(50, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 3.0])]
    with pytest.raises(Exception, match="beyond 64 bits"):
        P.top_products(frame(spark, rows)).collect()
    with pytest.raises(Exception, match="beyond 64 bits"):
        P.top_products(frame(spark, [(50, [1e30, 1.0]), (2, [-1e30, 3.0])])).collect()
    far = [(50, [1e30, 1.0]), (3, [-1e30, 3.0]), *[(i, [0.0, float(i)]) for i in range(4, 10)]]
    assert [g[1] for g in answers(P.top_products(frame(spark, far)))[50]] == [9, 8, 7, 6, 5]  # what nobody asks for is no error


def test_bit_search_finds_the_nearest(spark, hot):
    got = answers(B.nearest(frame(spark, hot), every=50, k=20, block=200))
    want = brute.top(padded(hot), 50, 20, False)
    assert set(got) == set(want) and 1400 not in got
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in got[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21)) and sorted(found, key=lambda f: (-f[2], f[1])) == found
    shared = next(q for q in got if 900 <= q < 1350)
    assert [f[1] for f in got[shared]] == [f[1] for f in want[shared]]  # equal scores by the smaller id


def test_estimates_are_unbiased_and_their_spread_is_known():
    rng = np.random.default_rng(8)
    vecs, centre, bits = rng.normal(size=(3000, 64)), rng.normal(size=64) * 0.1, 256
    packed, scalars = B.encode(vecs, centre, bits)
    queries = rng.normal(size=(20, 64))
    value, spread = B.estimate(queries, centre, packed, scalars, bits)
    error = (value - queries @ vecs.T) / spread
    assert packed.shape == (3000, 32) and abs(error.mean()) < 0.05 and 0.8 < error.std() < 1.2 and (np.abs(error) > B.ERROR).mean() < 0.01


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute.top(rows, 20, 20, False), answers(B.nearest(table))
    hits = sum(len({x[1] for x in want[q]} & {x[1] for x in got[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert answers(P.top_products(table)) == brute.top(rows, 50, 5, True)


def test_few_and_no_vectors(spark):
    one, none = frame(spark, [(100, [1.0, 2.0])]), frame(spark, [(1, None)])
    for search in (P.top_products, B.nearest):
        assert search(one).count() == 0 and search(none).count() == 0 and search(none.where("false")).count() == 0
    two = frame(spark, [(100, [1.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0])])
    assert [(r.rank, r.vec_id, r.score) for r in P.top_products(two).orderBy("rank").collect()] == [(1, 7, 3 * 65536), (2, 7, 3 * 65536)]
    assert [(r.rank, r.vec_id, r.score) for r in B.nearest(two).orderBy("rank").collect()] == [(1, 7, 3.0), (2, 7, 3.0)]
