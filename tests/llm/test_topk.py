import numpy as np
import pytest

from tests.helpers import duck, same
from tidemark.llm import topk
from tidemark.llm.topk import OP4_SQL, op4_topk, search, top_k


def test_query_equals_sql(spark, sf_dir):
    same(op4_topk(spark, sf_dir), duck(sf_dir), OP4_SQL)


@pytest.mark.parametrize("k", [1, 5])
@pytest.mark.parametrize("spread", [3, 300, 10**12])
def test_search_equals_all_products(k, spread):
    """Small spreads tie often; the largest is beyond exact doubles."""
    rng = np.random.default_rng(k + spread % 97)
    n = 40 if spread > 10**9 else 400
    q, c = (rng.integers(-spread, spread + 1, (40, m)).astype(float) for m in (6, n))
    q_ids, c_ids = np.arange(6) * 2, rng.permutation(n)
    found = search(q, c, q_ids, c_ids, k, np.full(6, -np.inf))
    for i in range(6):
        exact = [sum(int(a) * int(b) for a, b in zip(q[:, i], c[:, j])) for j in range(n)]
        score = [min(max(s, topk.LOWEST), topk.HIGHEST) for s in exact]
        order = sorted((j for j in range(n) if c_ids[j] != q_ids[i]), key=lambda j: (-score[j], c_ids[j]))[:k]
        assert sorted(((j, s) for x, j, s in found if x == i)) == sorted((j, score[j]) for j in order)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (50, [-1.0, 2.0]), (1, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' rank", "1 dim", "2 ids")
    found = [tuple(r) for r in top_k(df, 5).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 1, 0)]
    assert top_k(df.limit(0)).isEmpty()


def test_several_vectors_of_an_id(spark):
    """Each distinct vector of an id is a query of its own."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted(tuple(r) for r in top_k(df, 2).collect())
    assert found == [(50, 1, 1, 65536), (50, 1, 2, 131072), (50, 2, 1, 0), (50, 2, 2, 0)]


@pytest.mark.parametrize("top", [3, 200, 40_000, 2**33])
def test_packed_blocks_open_to_the_same(top):
    columns = np.array([[0.0, -top], [top, 1.0]])
    kind, raw = topk.packed(columns)
    assert (topk.opened(kind, raw, 2, 2) == columns).all() and kind == {3: "<i1", 200: "<i2", 40_000: "<i4", 2**33: "<f8"}[top]
