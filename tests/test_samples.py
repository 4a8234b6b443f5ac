"""The queries of pairs with the reference's sizes against brute force over all rows, of which the tables have fewer."""

import numpy as np
import pytest

from tallywright.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    found = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect())
    assert 100 < len(found) <= 2000
    return np.array([k for k, _ in found]), np.array([e for _, e in found], np.float64)


def squared(x, y):
    return ((x[:, None] - y[None]) ** 2).sum(-1)


def one(spark, name):
    return catalogue.queries()[name](spark, DIR).collect()[0]


def test_mmd2(spark, vectors):
    x, y = (vectors[1][vectors[0] % 2 == side] for side in (0, 1))
    own = [np.exp(-0.01 * squared(z, z)[np.triu_indices(len(z), 1)]).mean() for z in (x, y)]
    assert abs(one(spark, "a26_mmd2_1500").mmd2 - (sum(own) - 2 * np.exp(-0.01 * squared(x, y)).mean())) < 2e-9


def test_median_gamma(spark, vectors):
    d2 = squared(vectors[1], vectors[1])[np.triu_indices(len(vectors[1]), 1)]
    assert abs(one(spark, "a27_median_gamma_2000").gamma - 1 / (np.median(d2) + 1e-12)) < 2e-9


def test_pair_kernel(spark, vectors):
    d2 = squared(vectors[1], vectors[1])[np.triu_indices(len(vectors[1]), 1)]
    got = one(spark, "j10_pair_kernel_2000")
    assert got.n == len(d2) and abs(got.k - np.exp(-0.01 * d2).sum()) < 2e-6
