"""Links between vectors against brute force, in few and many dimensions."""

import numpy as np
import pytest

from quarryline.llm import vector_cells
from quarryline.llm.simhash_gray import hook, settled


def planted(d, n, seed):
    """Vectors all over the sphere, and partners at cosines of 0.9 to 0.93."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n // 3, d))
    y -= (y * x[: n // 3]).sum(axis=1, keepdims=True) * x[: n // 3]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9005, 0.93, (n // 3, 1))
    return np.vstack([x, c * x[: n // 3] + np.sqrt(1 - c * c) * y])


def compared(spark, x, **options):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in vector_cells.near_vectors(frame, **options).collect()}
    unit = vector_cells.unit(x.tolist())
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    root = np.arange(len(x))
    hook(root, a, b)
    n = np.array([got[i].n_links for i in range(len(x))])
    return n, near.sum(axis=1), [got[i].component_id for i in range(len(x))], settled(root).tolist()


@pytest.mark.parametrize("d", [2, 4])
def test_few_dimensions_are_exact(spark, d):
    n, want, component, root = compared(spark, planted(d, 900, d))
    assert (n == want).all() and component == root


@pytest.mark.parametrize(("d", "least"), [(8, 0.99), (16, 0.97), (64, 0.97), (256, 0.97)])
def test_recall(spark, d, least):
    n, want, _, _ = compared(spark, planted(d, 2400, d))
    assert (n <= want).all() and n.sum() >= least * want.sum()


def test_infinite_reach_is_exact(spark):
    n, want, component, root = compared(spark, planted(12, 900, 1), reach=float("inf"))
    assert (n == want).all() and component == root
