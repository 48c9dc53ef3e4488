import numpy as np
import pytest

from gradlens.functions import linalg
from gradlens.operators.bootstrap import matrices_of, poisson_counts, ranges, replicate_counts
from gradlens.operators.moments import FrequentDirections, classic_frequent_directions


def gradients(shape, low=-1, high=1):
    np.random.seed(42)
    return np.random.uniform(low, high, shape)


def test_golden_eigenvalues():
    g = gradients(60).reshape(15, 4)
    values, vectors = linalg.sorted_eigenpairs(g.T @ g / 15)
    np.testing.assert_array_almost_equal(values[:, 0], [0.571596, 0.465819, 0.272198, 0.175012])
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert (vectors[0] >= 0).all()


def test_golden_eigenvalues_of_jacobians():
    g = gradients(180).reshape(15, 3, 4)
    c = matrices_of(g, np.full(15, 1 / 15), np.ones((1, 15)))[0]
    np.testing.assert_array_almost_equal(linalg.sorted_eigenpairs(c)[0][:, 0], [1.32606312, 1.20519582, 0.94811868, 0.68505712])


def test_golden_bootstrap():
    g = gradients(60).reshape(30, 2)
    w = np.full((30, 1), 1 / 30)
    _, reference = linalg.sorted_eigenpairs(g.T @ g / 30)
    counts = np.array([np.bincount(np.random.randint(30, size=30), minlength=30) for _ in range(100)])
    values, errors = ranges(matrices_of(g, w, counts), reference)
    np.testing.assert_array_almost_equal(values, [[0.3000497, 0.59008536], [0.17398718, 0.40959827]])
    np.testing.assert_array_almost_equal(errors, [[0.002618, 0.588639, 0.999984]])


def test_counts():
    assert (replicate_counts(20, 5, 1).sum(1) == 20).all()
    c = poisson_counts(np.arange(20000), 4, 3)
    assert abs(c.mean() - 1) < 0.02 and abs(c.var() - 1) < 0.05
    np.testing.assert_array_equal(c[:, :10], poisson_counts(np.arange(10), 4, 3))


def test_dimensions():
    g = np.array([[1, 1, 1], [2, -4.5, 2], [1, 1.1, 1]])
    values, _ = linalg.sorted_eigenpairs(g.T @ g)
    assert linalg.spectral_gap_dim(values) == 1
    assert linalg.residual_energy_index(values) == 1
    assert linalg.choose_dim(0, values) == 1 and linalg.choose_dim(2, None) == 2 and linalg.choose_dim(0.99, values) == 2
    for bad in (0.0, 2.0, -1, "1"):
        with pytest.raises(ValueError):
            linalg.choose_dim(bad, values)
    with pytest.raises(ValueError):
        linalg.choose_dim(0, None)
    assert linalg.cumulative_dim(np.array([3.0, 1, 1]), 3, 0.8) == 2
    assert linalg.gap_dim(np.array([3.0, 1, 0.9]), 2) == 1
    with pytest.raises(AssertionError):
        linalg.gap_dim(np.array([3.0, 1]), 2)


def test_split():
    with pytest.raises(TypeError):
        linalg.split(np.eye(3), 1.0)
    with pytest.raises(ValueError):
        linalg.split(np.eye(3), 4)
    with pytest.raises(ValueError):
        linalg.split(np.ones((2, 3)), 1)
    assert linalg.split(np.eye(3)[:, :2], 1)[1] is None
    w = linalg.complement(np.eye(4)[:, :2])
    assert w.shape == (4, 2) and abs(w[:2]).max() < 1e-12


def test_linear_program():
    np.testing.assert_allclose(linalg.linear_program([1, 1], [[1, 0], [0, 1], [1, 1]], [0.1, 0.1, 0.1]), [0.1, 0.1], atol=1e-9)
    with pytest.raises(RuntimeError):
        linalg.linear_program([1], [[1], [-1]], [1, 0])
    with pytest.raises(RuntimeError):
        linalg.linear_program([-1], [[1]], [0])
    rng = np.random.default_rng(0)
    for _ in range(20):  # against the best vertex
        a, b = np.vstack([np.eye(2), -np.eye(2), rng.normal(size=(3, 2))]), np.concatenate([-np.ones(4), -rng.random(3)])
        c = rng.normal(size=2)
        x = linalg.linear_program(c, a, b)
        vertices = [np.linalg.solve(a[[i, j]], b[[i, j]]) for i in range(7) for j in range(i) if abs(np.linalg.det(a[[i, j]])) > 1e-9]
        best = min(c @ v for v in vertices if (a @ v >= b - 1e-9).all())
        assert (a @ x >= b - 1e-8).all() and abs(c @ x - best) < 1e-8


def test_square_roots_and_random_svd():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    root, inverse = linalg.sqrt_pair(a @ a.T)
    np.testing.assert_allclose(root @ root, a @ a.T, atol=1e-9)
    np.testing.assert_allclose(root @ inverse, np.eye(5), atol=1e-6)
    m = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 40))
    np.testing.assert_allclose(linalg.randomized_svd(m, 5)[0], np.linalg.svd(m)[1][:5], rtol=1e-8)
    assert not linalg.prefers_randomized(100, 100, 5) and linalg.prefers_randomized(20_000, 500, 5)


def test_frequent_directions_bound_and_merge():
    rng = np.random.default_rng(2)
    g = rng.normal(size=(400, 20)) * np.linspace(3, 0.1, 20)
    parts = [FrequentDirections(8, 20).add(p) for p in np.array_split(g, 3)]
    for fd in (FrequentDirections(8, 20).add(g), parts[0].merge(parts[1]).merge(parts[2])):
        b = fd.rows()
        assert np.linalg.norm(g.T @ g - b.T @ b, 2) <= np.linalg.norm(g) ** 2 / 8


def test_classic_directions_leave_out_the_last_row():
    rows = np.zeros((4, 15))
    rows[:, 0] = [-0.50183952, -1.26638196, 0.43017941, 0.65008914]
    values, _ = classic_frequent_directions(rows, 2)
    np.testing.assert_array_almost_equal(values[:, 0], [2.040621, 0])
