import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import multi_index, toxicity, voronoi


@pytest.mark.parametrize("n", [15, 300, 900])
def test_index_recall_of_small_tables(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, df.where(F.col("vec_id") % 5 == 0), 20).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(j)) for q in range(0, n, 5) for j in np.argsort(-s[q])[: min(20, n - 1)]}
    assert len(found & want) >= 0.88 * len(want) and len(got) == len(want)


def test_clashing_columns_of_searches(spark):
    rng = np.random.default_rng(2)
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.integers(-5, 5, size=(80, 8)) / 4)], "vec_id long, embedding array<double>")
    more = plain.withColumns({c: F.lit("x") for c in ("grp", "cell", "v", "score", "rank", "query_id", "i", "j", "far")})
    for search in (voronoi.top_documents, multi_index.nearest_documents):
        assert sorted(map(tuple, search(more).collect())) == sorted(map(tuple, search(plain).collect()))


def test_every_category_is_in_the_chain():
    texts = [f"you are an idiot number {i}" if i % 2 else f"a quiet day by the river {i}" for i in range(60)]
    chain = toxicity.train(texts, np.arange(60) % 2)
    assert [x.category for x in chain.links] == toxicity.CATEGORIES
    p = chain.predict(["you are an idiot number 99", "the river", None, ""])
    assert p["toxic"][0] > 0.5 > p["toxic"][1:].max() and p["threat"].max() < 1e-6


def test_fit_is_that_of_dense_newton_steps():
    rng = np.random.default_rng(5)
    x = (rng.random((300, 40)) < 0.1).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - x[:, :5].sum(axis=1) * 3))).astype(float)
    marks = toxicity.Marks(*np.nonzero(x), *x.shape)
    dense = rng.random((300, 2))
    w, b = toxicity.logistic(marks, dense, y)
    full, ridge, v = np.column_stack([x, dense, np.ones(300)]), np.append(np.full(42, 0.5), 1e-6), np.zeros(43)
    for _ in range(60):
        p = 1 / (1 + np.exp(-full @ v))
        v += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(ridge), full.T @ (y - p) - ridge * v)
    assert np.allclose(np.append(w, b), v, atol=1e-5)
