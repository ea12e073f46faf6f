"""Trees, seasonal models and decompositions against plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from gridstone.functions import arima, semantic, trees


def random_tree(rng, features: int) -> trees.Tree:
    nodes: list[list] = []

    def grow(depth: int, cover: float) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, rng.normal(), cover])
        if depth < 4 and rng.random() < 0.9:
            share = rng.uniform(0.1, 0.9)
            nodes[at][:2] = int(rng.integers(features)), rng.normal()
            nodes[at][2], nodes[at][3] = grow(depth + 1, cover * share), grow(depth + 1, cover * (1 - share))
        return at

    grow(0, 100.0)
    return trees.Tree(*(np.array(c) for c in zip(*nodes)))


@pytest.mark.parametrize("seed", range(4))
def test_shapley_values_equal_all_coalitions(seed):
    rng = np.random.default_rng(seed)
    d = 4
    forest = trees.Trees([random_tree(rng, d) for _ in range(3)], [0.5, 1.0, 2.0])
    x = rng.normal(size=(5, d))

    def expected(tree, row, known, node=0):
        f, left, right = tree.feature[node], tree.left[node], tree.right[node]
        if f < 0:
            return tree.value[node]
        if f in known:
            return expected(tree, row, known, left if row[f] <= tree.edge[node] else right)
        return (tree.cover[left] * expected(tree, row, known, left) + tree.cover[right] * expected(tree, row, known, right)) / tree.cover[node]

    want = np.zeros(x.shape)
    for i, row in enumerate(x):
        for f in range(d):
            for k in range(d):
                for s in itertools.combinations([g for g in range(d) if g != f], k):
                    weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                    want[i, f] += weight * sum(w * (expected(t, row, {*s, f}) - expected(t, row, set(s))) for w, t in zip(forest.weights, forest.trees))
    got = forest.shapley(x)
    assert got == pytest.approx(want, abs=1e-12)
    assert got.sum(1) == pytest.approx(forest.predict(x) - forest.mean, abs=1e-12)


def test_trees_of_fitted_models_predict_as_they_do(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    rows = [(*map(float, v), float(v[0] + v[1] > 0)) for v in x]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, label double"))
    forest = RandomForestRegressor(numTrees=4, maxDepth=3, seed=1).fit(df)
    mine = trees.of_model(forest)
    assert mine.predict(x) == pytest.approx([r.prediction for r in forest.transform(df).collect()])
    assert mine.each(x).shape == (4, 300) and mine.mean == pytest.approx(np.mean([t.value[0] for t in mine.trees]), abs=1e-9)
    boosted = GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(df)
    raw = [r.rawPrediction[1] for r in boosted.transform(df).collect()]
    assert 2 * trees.of_model(boosted).predict(x) == pytest.approx(np.array(raw) * (2 * trees.of_model(boosted).predict(x)[0] / raw[0]))


@pytest.mark.parametrize(("phi", "seasonal", "theta"), [(0.5, -0.3, 0.4), (-0.7, 0.6, -0.8), (0.0, 0.0, 0.0)])
def test_likelihood_equals_a_dense_gaussian(phi, seasonal, theta):
    z = np.random.default_rng(3).normal(size=18)
    ar = arima.polynomial(phi, seasonal, 4)
    psi = [1.0]
    for j in range(1, 2500):
        psi.append((theta if j == 1 else 0.0) + sum(a * psi[j - k] for k, a in enumerate(ar, 1) if k <= j))
    psi = np.array(psi)
    cover = np.array([psi[: len(psi) - h] @ psi[h:] for h in range(len(z))])[np.abs(np.subtract.outer(range(len(z)), range(len(z))))]
    variance = z @ np.linalg.solve(cover, z) / len(z)
    want = -0.5 * (len(z) * (math.log(2 * math.pi * variance) + 1) + np.linalg.slogdet(cover)[1])
    got, found = arima.log_likelihood(z, ar, theta)
    assert got == pytest.approx(want, rel=1e-9) and found == pytest.approx(variance, rel=1e-9)


def test_fit_is_a_maximum_and_orders_criteria():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=40)) + np.tile([3.0, 1.0, -2.0, -1.0], 10) + 50
    model = arima.fit(y)
    z = arima.differenced(y, 4)
    for d in itertools.product((-0.02, 0.0, 0.02), repeat=3):
        at = np.clip(np.array([model.phi, model.seasonal, model.theta]) + d, -0.994, 0.994)
        assert arima.log_likelihood(z, arima.polynomial(at[0], at[1], 4), at[2])[0] <= model.likelihood + 0.05
    assert model.aic == pytest.approx(8 - 2 * model.likelihood) and model.bic == pytest.approx(4 * math.log(35) - 2 * model.likelihood)
    mean, error = model.forecast(8)
    assert (np.diff(error) > 0).all() and len(mean) == 8 and np.isnan(model.fitted()[:5]).all()


def test_dickey_fuller_tells_walks_from_noise():
    rng = np.random.default_rng(5)
    noise = [arima.dickey_fuller(rng.normal(size=80))[1] for _ in range(10)]
    walks = [arima.dickey_fuller(np.cumsum(rng.normal(size=80)))[1] for _ in range(20)]
    assert max(noise) < 0.01 and sum(p > 0.05 for p in walks) >= 15
    assert all(map(math.isnan, arima.dickey_fuller(np.ones(30)))) and all(map(math.isnan, arima.dickey_fuller(np.arange(3.0))))


def test_singular_values_equal_the_dense_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    _, rows = semantic.weighted_terms(docs, dims=512)
    rows = rows.cache()
    found = semantic.truncated_svd(rows, k=8, dims=512)
    a = np.array([r.terms.toArray() for r in rows.collect()])
    _, s, right = np.linalg.svd(a, full_matrices=False)
    assert found.values == pytest.approx(s[:8], abs=1e-6)
    dense = {r.doc_id: r.dense for r in semantic.dense(rows, found).collect()}
    ids = [r.doc_id for r in rows.collect()]
    gram = a @ right[:8].T
    mine = np.array([dense[i] for i in ids])
    assert mine @ mine.T == pytest.approx(gram @ gram.T, abs=1e-5)
    assert dense[-1] == [0.0] * 8
